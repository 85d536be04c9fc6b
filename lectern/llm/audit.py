"""Which filter removes what, under every order of the filters.

A document is a row of a mask matrix: 0 where a filter fails it, infinity where it passes.  The orders are the
columns of a position matrix (the inverse permutations).  Their product with minimum for sum and sum for
product is the step at which each order removes each document.  Documents of one part and mask share it, so
Spark counts them first (at most 32 masks by four label pairs a part) and the product runs over the counts of a part.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

FILTERS = "ABCDE"
CAPITALS, SYMBOL = bytes(range(0x41, 0x5B)), re.compile(rb"[#$%&*|]")
#: A null id stands after all others.
LAST = (1 << 63) - 1


def failures(texts: pa.Array) -> np.ndarray:
    """The bits of filters A to D that each text fails: under 100 words; under 80 % distinct words; over 10 % of the
    code points capitals A-Z; any of ``#$%&*|``.  A null text is empty and fails A alone."""
    texts = pc.fill_null(texts, "")
    points = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    out = np.zeros(len(texts), np.int32)
    for i, t in enumerate(texts.cast(pa.binary()).to_pylist()):
        words = t.split()  # at ASCII white space, as these are bytes
        capitals = len(t) - len(t.translate(None, CAPITALS))
        fails = len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * points[i], SYMBOL.search(t) is not None
        out[i] = sum(bit << k for k, bit in enumerate(fails))
    return out


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of each part and label pair fail which filters.

    Filter E fails a document whose text a smaller id has.  Texts are told apart by SHA-256; copies are folded
    to a row for each text, part and label pair before they meet, so a text that a third of all rows share is no
    burden.  Rows of equal id and text are no copies of each other; a null id stands after all others.  An id with
    several labels is good (toxic) if any is; labels of a null id count for nothing.
    """
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(2), "")
            digests = [hashlib.sha256(t).digest() for t in texts.cast(pa.binary()).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(failures(texts)), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "fails", "digest"])

    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text")
    ).mapInArrow(run, "id long, part string, fails int, digest binary")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    label = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    marked = rows.join(told, "id", "left").select("id", "part", "fails", "digest", *label)
    kind = ["part", "fails", "good", "toxic"]
    once = marked.groupBy("id", "digest", *kind).agg(F.count("*").alias("n"))
    folded = once.groupBy("digest", *kind).agg(F.min(F.struct("id", "n")).alias("least"), F.sum("n").alias("n"))
    first = folded.groupBy("digest").agg(F.min("least.id").alias("first"))
    both = folded.join(first, "digest")
    stays = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = F.array(F.struct(F.col("fails").alias("mask"), stays.alias("n")), F.struct((F.col("fails") + 16).alias("mask"), (F.col("n") - stays).alias("n")))
    each = both.select("part", "good", "toxic", F.explode(sides).alias("side")).select("part", "side.mask", "good", "toxic", "side.n")
    return each.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def removal_steps(failed: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """[document, order]: the step (from 1) that removes it, infinity if none does; the min-plus product of
    ``failed`` [document, filter] and the positions of the filters in ``orders`` [order, step]."""
    positions = np.argsort(orders, axis=1).T + 1.0  # the inverse permutations: [filter, order]
    mask = np.where(failed, 0.0, np.inf)
    out = np.full((len(failed), len(orders)), np.inf)
    for f in range(failed.shape[1]):
        np.minimum(out, mask[:, f, None] + positions[f], out=out)
    return out


def removals(part: str, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """The report of one part from its counted masks."""
    k = len(FILTERS)
    orders = np.array(list(itertools.permutations(range(k))))
    failed = (mask[:, None] >> np.arange(k) & 1).astype(bool)
    steps = removal_steps(failed, orders)
    place = np.where(np.isinf(steps), 0, steps).astype(np.int64)  # 0: kept

    def scattered(weight: np.ndarray) -> np.ndarray:
        """[order, step]: the weights of what is removed there."""
        cells = place + (k + 1) * np.arange(len(orders))
        total = np.bincount(cells.ravel(), weights=np.repeat(weight, len(orders)), minlength=(k + 1) * len(orders))
        return total.astype(np.int64).reshape(len(orders), k + 1)[:, 1:]

    removed = scattered(n)
    failing = (failed * n[:, None]).sum(axis=0)[orders]  # [order, step]: all that fail this step's filter
    alone = np.where(failed.sum(axis=1) == 1, n, 0)
    shapley = np.zeros(k, np.int64)
    np.add.at(shapley, orders.ravel(), removed.ravel())
    return pd.DataFrame(
        {
            "part": part,
            "filter_order": np.repeat(["".join(FILTERS[f] for f in o) for o in orders], k),
            "step": np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders)),
            "kept": (n.sum() - removed.cumsum(axis=1)).ravel(),
            "removed": removed.ravel(),
            "redundant": (failing - removed).ravel(),  # whoever fails a filter goes there or earlier
            "unique_fails": (failed * alone[:, None]).sum(axis=0)[orders].ravel(),
            "good_lost": scattered(n * good).ravel(),
            "toxic_lost": scattered(n * toxic).ravel(),
            "shapley": shapley[orders].ravel(),
        }
    )


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (``lang``, null: empty), order of the filters and step; none of an empty table.

    Other columns of either table, whatever their names, are not read.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return removals(key[0], *(rows[c].to_numpy().astype(np.int64) for c in ("mask", "good", "toxic", "n")))

    return masks(docs, labels).groupBy("part").applyInPandas(run, SCHEMA)
