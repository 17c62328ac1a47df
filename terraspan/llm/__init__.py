"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it.  Each module holds one operator
with its own general interface; ``queries.py`` derives the registered
``opN_*`` queries from them.
"""
