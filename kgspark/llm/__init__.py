"""Operators of a training-data pipeline: filters, deduplication, packing, scans and search over a corpus."""
