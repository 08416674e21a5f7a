"""Operators for training data: text, near-duplicates, leaks, splits, tokens."""
