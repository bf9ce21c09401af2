"""Joins, aggregations, windows and filters over fact tables."""
