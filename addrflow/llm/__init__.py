"""Operators for large training-data corpora.

Nothing else in the library imports this subpackage.  Each operator has a module of its own with a general interface;
``queries.py`` derives the registered queries from them; ``arrays``, ``shards``, ``components`` and ``workspace`` are
shared.
"""
