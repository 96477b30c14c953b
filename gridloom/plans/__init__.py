"""Declarative analyses: configuration, mean-state programs, score roll-ups."""
