"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` registers the thin
``opN_<name>`` queries on top of them.
"""
