"""SimHash fingerprints and near-duplicate groups by meet-in-the-middle ball hashing.

Fingerprints at most two bits apart have a common variant at most one bit from each.  Every
distinct fingerprint emits itself and its 64 one-bit variants; the variants are shuffled, and in
each variant's bucket (65 fingerprints at most, whatever the data) neighbours in sorted order are
linked, verified by their differing bits and deduplicated.  All of a bucket lie within two bits of
each other, so the chain reaches what all its pairs would.  Copies share a fingerprint and are
folded into one row before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batched, written
from .components import connected_components

RADIUS, SEED = 2, 42


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """The signed 64-bit fingerprint of each text."""
    words = Words(texts, lower=True)
    data, starts, stops = words.joined()
    counts = np.diff(words.offsets)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    firsts = np.concatenate(([0], np.cumsum(shingles)))
    begin = np.arange(firsts[-1]) + np.repeat(words.offsets[:-1] - firsts[:-1], shingles)
    end = begin + np.repeat(np.minimum(counts, width), shingles) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(starts[begin].tolist(), stops[end].tolist(), strict=True)),
        np.uint64,
        len(begin),
    )
    out = np.zeros(len(counts), np.uint64)
    filled = np.flatnonzero(shingles)
    for part in np.array_split(filled, max(1, len(hashes) // 200_000)):  # 64 bytes a shingle at a time
        if len(part):
            lo, hi = firsts[part[0]], firsts[part[-1] + 1]
            bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, firsts[part] - lo, axis=0, dtype=np.int32)
            over = (2 * ones > shingles[part][:, None]).astype(np.uint8)
            out[part] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the SimHash of every text over its shingles of ``width`` words, repeats included.

    A-Z count as a-z.  A text of fewer words is one shingle; without words (null, empty, blank)
    its fingerprint is 0.  A bit is 1 if set in over half the shingles' XXH64 (seed 42).
    """
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fingerprints_of(batch.column(1), width))], ["id", "fp"]
            )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "id long, fp long")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b), a < b: verified links between distinct fingerprints ``fps.fp``, enough to join whatever is within ``radius``.

    ``radius`` 0, 1 or 2; half of it, rounded up, is the radius of a ball.
    """
    if radius not in (0, 1, 2):
        raise ValueError("radius: 0, 1 or 2")
    one = "array(fp)" if radius == 0 else "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    variants = fps.select("fp").distinct().select("fp", F.expr(f"explode({one})").alias("variant"))
    in_bucket = Window.partitionBy("variant").orderBy("fp")
    return (
        variants.select(F.lag("fp").over(in_bucket).alias("a"), F.col("fp").alias("b"))
        .where(F.col("a").isNotNull() & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
        .distinct()
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every document; component_id: the least id reachable over links.

    Rows with a null id take no part.  A repeated id keeps a row for each of its texts.  Other
    columns of ``docs`` don't matter.
    """
    marked = written(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, width), "fingerprints")
    firsts = marked.groupBy("fp").agg(F.min("id").alias("first"))
    groups = connected_components(links(firsts, radius))
    by_group = firsts.join(groups, firsts.fp == groups.vertex).select("fp", "component", "first")
    least = by_group.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = by_group.join(least, "component").select("fp", "component_id")
    # a table of its own: the join below then has no partitioning to keep, so a frequent fingerprint's rows can be split
    own = written(firsts.join(joined, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "components")
    return marked.join(own, "fp").select("id", "fp", "component_id")
