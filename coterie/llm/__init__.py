"""Operators for training data: identity groups, distinct counts and texts."""
