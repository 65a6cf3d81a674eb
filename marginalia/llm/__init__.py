"""Operators for large text corpora: filters, classifiers, near-duplicates, fingerprints, search, packing."""
