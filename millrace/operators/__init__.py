"""Relational operators of the flow engine."""
