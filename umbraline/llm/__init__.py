"""Operators for training-data pipelines: filters, duplicate search, scans, archives and tokens."""
