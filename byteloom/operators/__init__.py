"""Relational operators: segmentation, entropy, words, pairs, combining, coding."""
