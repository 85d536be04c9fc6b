"""The query of the decontamination operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import templates


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "matched", "windows", "same_values")


QUERIES = {"op3_template_decontamination": op3_template_decontamination}
ORACLES: dict[str, str] = {}
