"""Spark jobs that select and score regions of very large images."""
