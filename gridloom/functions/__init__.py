"""Scalar functions on columns, and units."""
