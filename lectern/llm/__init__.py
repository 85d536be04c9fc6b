"""Operators of a training-data pipeline: filtering, deduplication, token files, search and scoring.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` maps the registered
query names to callables ``(spark, sf_dir) -> DataFrame`` and ``queries.ORACLES`` to SQL.
"""
