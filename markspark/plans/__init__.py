"""Whole jobs put together from operators: build a dataset, fit, evaluate."""
