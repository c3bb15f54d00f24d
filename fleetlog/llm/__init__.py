"""Operators for building training data from web-scale text.

One module per operator; ``queries`` and ``sql`` register them.  Nothing else
in the package imports this subpackage.
"""
