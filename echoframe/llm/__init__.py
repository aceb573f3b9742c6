"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general DataFrame interface; ``queries`` binds them to the
tables of the test data.
"""
