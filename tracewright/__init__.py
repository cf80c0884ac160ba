"""Spark-native extraction of structured, provenance-carrying events from operational text."""

__version__ = "0.1.0"
