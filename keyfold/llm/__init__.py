"""Training-data operators: one module per operator, queries in ``catalogue``.

Nothing else in the library imports this subpackage.
"""
