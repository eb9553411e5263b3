"""Continuous use of the row-local scoring functions."""
