"""Operators on event streams, labels and prediction records."""
