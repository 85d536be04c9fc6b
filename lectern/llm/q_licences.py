"""The query of the licence scan, with its SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return licences.scan(docs, licences.known_digests(spark)).select(F.col("id").alias("doc_id"), "scope", "licence_id")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_KNOWN = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in licences.KNOWN)
SQL = f"""
WITH known AS (
  SELECT DISTINCT licence_id, sha256(array_to_string({licences.canonical_lines("t", True)}, ' ')) AS digest FROM (VALUES {_KNOWN}) v(licence_id, t)
), lined AS (
  SELECT doc_id, {licences.canonical_lines("text", True)} AS lines FROM documents WHERE doc_id IS NOT NULL
), units AS (
  SELECT doc_id, 'text' AS scope, sha256(array_to_string(lines, ' ')) AS digest FROM lined WHERE len(lines) > 0
  UNION ALL
  SELECT doc_id, 'line', sha256(line) FROM (SELECT doc_id, unnest(list_distinct(lines)) AS line FROM lined)
)
SELECT DISTINCT doc_id, scope, licence_id FROM units JOIN known USING (digest)
"""

QUERIES = {"op7_licence_scan": op7_licence_scan}
ORACLES = {"op7_licence_scan": SQL}
