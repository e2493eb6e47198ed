"""Operators of a training-data pipeline: cleaning, scoring, near-duplicates, encoding and packing of documents."""
