"""The query of the toxicity operator."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity


def remainder(k: int, column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % k


def model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.fit(docs, labels, remainder(5) != 0)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = toxicity.score(docs, model(spark, docs, sf_dir))
    return out.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
