"""The query of the importance-resampling operator."""

from pyspark.sql import DataFrame, SparkSession

from . import resample


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    gain = resample.gains(resample.bucket_counts(docs), resample.bucket_counts(target))
    out = resample.draw(resample.weights(docs, gain), percent=5, least_words=20)
    return out.selectExpr("id as doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_draw": op11_importance_draw}
ORACLES: dict[str, str] = {}
