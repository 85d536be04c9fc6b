"""The query of the byte-pair operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .records import session_tokenizer


def op13_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = session_tokenizer(spark, "word_bpe_49k.json")
    back = bpe.decode(bpe.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer), tokenizer)
    return back.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


QUERIES = {"op13_rank_array_bpe": op13_rank_array_bpe}
ORACLES: dict[str, str] = {}
