"""Operators for large text, page and vector corpora."""
