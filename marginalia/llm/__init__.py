"""Training-data operators: the numbered operators and their queries.

Nothing else in the library imports this subpackage.
"""
