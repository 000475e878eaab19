"""Operators for training-data corpora: quality, scoring, deduplication, personal data, decontamination, mixing."""
