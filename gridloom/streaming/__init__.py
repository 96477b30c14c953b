"""Streaming forms of the time reductions."""
