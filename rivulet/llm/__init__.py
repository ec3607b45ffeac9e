"""Operators for preparing training data: search, dedup, token counts, packing, scans, classifiers, mixing."""
