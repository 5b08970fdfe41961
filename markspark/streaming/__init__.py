"""Structured Streaming forms of filtering, restoring and measuring."""
