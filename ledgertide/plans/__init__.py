"""Queries over the tables at hand, and what an independent SQL engine is asked to compare."""
