"""Subpackage of millrace."""
