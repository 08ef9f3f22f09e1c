"""Training-data operators: one module an operator, and their registered queries in ``queries``.

Nothing else in the library imports this subpackage.
"""
