"""The query of the rollup operator, with SQL for its totals."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written
from .rollup import Rollup, deletes, inserts, revisions

WORDS, UNITS = r"[^\x20\x09-\x0D]+", r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents, one of them sent twice: all come in by words; copies of an earlier
    document go; the rest comes in by a second tokenizer; and their first counts are revised to leave out
    repeated lines."""
    text = F.coalesce("text", F.lit(""))
    once = F.array_join(F.array_distinct(F.split(text, "\n")), "\n")
    counts = written(
        spark.read.parquet(f"{sf_dir}/documents.parquet").select(
            "doc_id",
            "source",
            "lang",
            F.xxhash64(text).alias("copy1"),
            F.xxhash64(text, F.lit(1)).alias("copy2"),
            F.regexp_count(text, F.lit(WORDS)).alias("words"),
            F.regexp_count(text, F.lit(UNITS)).alias("units"),
            F.regexp_count(once, F.lit(WORDS)).alias("once"),
        ),
        "counts",
    )
    # a table of its own: the join then has no partitioning to keep, so a frequent text's rows can be split
    first = written(counts.groupBy("copy1", "copy2").agg(F.min("doc_id").alias("first")), "first")
    marked = written(counts.join(first, ["copy1", "copy2"]), "marked")
    stays = marked.where("doc_id = first")

    def by(rows: DataFrame, tokenizer: str, column: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(column).alias("n_tokens"))

    totals = Rollup(spark, new_path(spark, "rollup"))
    totals.commit("load", inserts(by(marked, "words-1", "words")))
    totals.commit("copies", deletes(by(marked.where("doc_id <> first"), "words-1", "words")))
    totals.commit("units", inserts(by(stays, "units-1", "units")))
    totals.commit("load", inserts(by(marked, "words-1", "words")))
    totals.commit("lines", revisions(by(stays, "words-1", "words"), by(stays, "words-1", "once")))
    return totals.totals()


SQL = rf"""
WITH stays AS (
  SELECT source, lang, coalesce(text, '') AS text FROM documents
  QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1
), counts AS (
  SELECT source, lang, 'words-1' AS tokenizer,
         len(regexp_extract_all(array_to_string(list_distinct(string_split(text, chr(10))), chr(10)), '{WORDS}')) AS n FROM stays
  UNION ALL
  SELECT source, lang, 'units-1', len(regexp_extract_all(text, '{UNITS}')) FROM stays
)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM counts GROUP BY ALL
"""

QUERIES = {"op2_token_rollup": op2_token_rollup}
ORACLES = {"op2_token_rollup": SQL}
