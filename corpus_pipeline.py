"""A training corpus from raw documents: five stages, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, and all but
the last keep the columns of ``documents``.  ``run`` writes each result as Parquet in the cluster's
shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import near, q_pieces, q_toxicity, substring, templates, toxicity
from lectern.llm.common import packed, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones outside the held-out fold, finds clean.

    Null, empty and blank texts are clean, rows of null id are scored like others, repeated rows go or stay alike.
    """
    labelled = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = q_toxicity.model(spark, labelled, sf_dir)
    rows = docs.select(F.struct(*packed(docs.columns)).alias("row"), "text")
    return toxicity.score(rows, model).where("predicted = 0").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near-duplicates (Jaccard similarity of five-word shingles 0.8 or more), and rows without an id."""
    groups = near.near_copies(docs, width=5, similarity=0.8)
    stays = groups.where("id = component_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(stays, "doc_id", "left_semi").select(*packed(docs.columns)).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of 50 words and more that an earlier one has; ``n_chars`` follows the text.

    Null and empty texts and rows of null id stay as they are; rows that share an id are not earlier than each other.
    """
    rows = docs.select(F.struct(*packed(docs.columns)).alias("row"), "doc_id", "text")
    out = substring.remove_shared(rows, width=50)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, exact or with other names and figures.

    Null and empty texts and rows of null id stay; all rows of a repeated id go if one of its texts holds a window.
    """
    found = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*packed(docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document, with digests of them and of the text that they decode to.

    A null text is empty and has no ids; rows of equal id and text get equal ids.
    """
    return q_pieces.coded(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("sentencepiece", encode_pieces),
]
#: No SQL: a trained classifier, fingerprints and piece merges.  tests/llm/test_queries.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
