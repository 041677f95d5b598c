"""Operators for preparing training data: quality, language, packing, deduplication, archives and token files."""
