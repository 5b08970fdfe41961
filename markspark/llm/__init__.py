"""Operators for training-data pipelines: filters, duplicates, models, archives, packing."""
