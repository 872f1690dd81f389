"""Operators for building language-model training corpora.

Nothing outside this subpackage imports it; see ``queries`` for the
registered queries and their SQL.
"""
