"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; the queries are in :mod:`weftline.llm.queries`.
"""
