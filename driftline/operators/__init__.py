"""Relational operators of the reporting engine."""
