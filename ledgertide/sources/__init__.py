"""Readers and the lifecycle view over the tables at hand."""
