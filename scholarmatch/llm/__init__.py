"""Operators for preparing training data: deduplication, scans, tokens, scores, search, archives and mixing."""
