"""Operators for large training-data pipelines.

One module per operator; :mod:`corpusmill.llm.queries` registers the queries
``op1_`` to ``op13_`` and ``pipeline`` with their oracle SQL.  Nothing outside
this subpackage imports it.
"""
