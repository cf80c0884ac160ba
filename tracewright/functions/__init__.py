"""Text, JSON and time functions."""
