"""Reusable physical patterns that keep one heavy key from landing in one task."""
