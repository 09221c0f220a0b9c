"""Relational operators of the harmonization plans."""
