"""Scalar functions: text, identifiers and values, URLs."""
