"""Operators for preparing large text corpora: deduplication, filters, scans, tokens, packing."""
