"""The query of the filter audit, with SQL."""

from pyspark.sql import DataFrame, SparkSession

from . import audit


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return audit.audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(documents.lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad
  FROM documents LEFT JOIN labels USING (doc_id)
), m AS (
  SELECT part, good, bad,
         (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
         || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM d
), h AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM m GROUP BY ALL
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), r AS (
  SELECT part, filter_order, fails, n, good, bad,
         list_min(list_filter(list_transform(range(1, 6), lambda i: CASE WHEN contains(fails, filter_order[i]) THEN i END), lambda i: i IS NOT NULL)) AS gone
  FROM h, o
), s AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f,
         sum(CASE WHEN gone IS NULL OR gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND contains(fails, filter_order[step]) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = filter_order[step] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN bad ELSE 0 END) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM s
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLES = {"op12_filter_audit": SQL}
