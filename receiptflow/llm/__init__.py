"""Operators for training-data pipelines (thirteen operators and their queries)."""
