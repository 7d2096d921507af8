"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
contract queries, ``oracles.py`` the SQL that states the same results.
"""
