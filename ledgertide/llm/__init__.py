"""Training-data operators: ten components, their queries and the corpus pipeline's parts.

Nothing else in the library imports this subpackage.
"""
