"""Relational operators as DataFrame transformations."""
