"""The query of the SentencePiece operator."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pieces
from .records import session_tokenizer

RATE, SEED = 0.1, 7


def coded(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Encoded with dropout and decoded again: doc_id, n_pieces, ids_sha256, text_sha256 of what was decoded, and the ids if asked for."""
    model = session_tokenizer(docs.sparkSession, "piece_bpe_32k.model")
    back = pieces.decode(pieces.encode(docs, model, RATE, SEED), model)
    return back.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("text_sha256"),
        *(["ids"] if with_ids else []),
    )


def op6_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_merge_dropout": op6_merge_dropout}
ORACLES: dict[str, str] = {}
