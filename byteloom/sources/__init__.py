"""Sources of byte sequences."""

from byteloom.sources.files import binary_files, chunked, export_texts, in_memory, list_paths, totals
from byteloom.sources.jsonl import extract_field, jsonl, parse_spec, token_lists

__all__ = ["binary_files", "chunked", "export_texts", "extract_field", "in_memory", "jsonl", "list_paths", "parse_spec", "token_lists", "totals"]
