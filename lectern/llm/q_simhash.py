"""The query of the SimHash operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simhash


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash.near_duplicates(docs, width=3, radius=2).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


QUERIES = {"op10_simhash_near_dedup": op10_simhash_near_dedup}
ORACLES: dict[str, str] = {}
