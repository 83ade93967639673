"""Learning, combining, applying and inspecting byte-level BPE vocabularies on Spark."""

__version__ = "0.1.0"
