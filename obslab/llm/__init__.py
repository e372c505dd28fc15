"""Training-data operators: one module per operator, ``catalog`` registers their queries.

Nothing else in the library imports this package.
"""
