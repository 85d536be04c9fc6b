"""The query of the substring operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import substring

#: The kept words, one space between two.
KEPT = r"trim(both ' ' from regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' '))"


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = substring.remove_shared(docs, width=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.expr(KEPT), 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLES: dict[str, str] = {}
