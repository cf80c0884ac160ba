"""Patterns, parsers and aggregations."""
