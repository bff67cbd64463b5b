"""Operators of a training-data pipeline (language ID ... near-dedup).

Nothing outside this package imports it.  ``registry.QUERIES`` /
``registry.ORACLE`` hold the queries that ``__spark_entry__`` adds.
"""
