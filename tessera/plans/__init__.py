"""Whole plans: suggest and enrich."""
