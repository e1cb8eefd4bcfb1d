"""Operators for large text corpora: packing, cleaning, repeats, near duplicates, contamination, classifiers."""
