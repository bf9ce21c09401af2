"""Composite analytics: whole jobs made of operators."""
