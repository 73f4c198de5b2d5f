"""Scalar column functions (F1-F22): native Spark expressions only."""
