"""Operators: they take and return `DataFrame`."""
