"""Readers, parsers, record builders and writers."""
