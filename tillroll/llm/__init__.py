"""Operators for training-data pipelines (optional subpackage)."""
