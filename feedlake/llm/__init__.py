"""Operators for preparing language-model training data.

Each module holds one operator with its general interface; ``queries``
registers the thin queries over the given tables and ``oracles`` their SQL.
Nothing outside this subpackage imports it.
"""
