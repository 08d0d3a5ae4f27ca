"""Operators for preparing large text corpora: deduplication, filtering, scoring and mixing."""
