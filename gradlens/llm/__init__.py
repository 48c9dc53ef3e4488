"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it. ``queries()`` and ``oracle_sql()`` live in :mod:`gradlens.llm.registry`.
"""
