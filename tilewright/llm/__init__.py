"""Operators for large text corpora: archives, packing, deduplication, scoring, rules, search and tokenizers."""
