"""The query of the nearest-neighbour operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import neighbours


def op8_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = neighbours.nearest(vectors, F.col("vec_id") % 100 == 0, k=10)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").alias("score"))


QUERIES = {"op8_projected_neighbours": op8_projected_neighbours}
ORACLES: dict[str, str] = {}
