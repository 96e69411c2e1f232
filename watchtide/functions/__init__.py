"""Scalar building blocks: every one takes and returns Spark columns."""
