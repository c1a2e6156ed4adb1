"""Operators for building language-model training corpora.

Nothing outside this folder imports it; ``queries`` and ``oracles`` hold its
registered queries and their SQL.
"""
