"""Iterative and staged plans."""
