"""Streams of sequences."""

from byteloom.streaming.words import stream_word_counts, word_counts

__all__ = ["stream_word_counts", "word_counts"]
