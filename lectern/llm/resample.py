"""Importance resampling towards a target distribution, over hashed word n-grams.

The texts of a batch are joined with a separator that no word holds; one regex pass finds all words; the
offsets of the documents, searched for every word's start, tell its document, and an n-gram that starts and
ends in different ones is masked before the bins are counted.  An n-gram's bucket is the CRC-32
of its bytes: CRCs of words are combined by moving one over the other's length, so no n-gram is ever built.

Two counts of ``BUCKETS`` numbers at most (all documents, the target) make the gains that the second pass adds up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, written

BUCKETS, LONGEST = 10_000, 3
#: Bytes of text that are joined at once; a longer text is a batch of its own.
JOINED = 4 << 20
#: What stands between words: everything ASCII but digits and small letters, the separator included.
BETWEEN, SEPARATOR = re.compile(rb"([\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), b"\x00"


def _crc_moves(n: int) -> np.ndarray:
    """[m, j, b]: byte j of a CRC, if it is b, after m zero bytes more; from the rule of the polynomial."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, np.uint32(0xEDB88320) ^ (byte >> 1), byte >> 1).astype(np.uint32)
    out = np.empty((n, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for m in range(1, n):
        out[m] = (out[m - 1] >> 8) ^ byte[out[m - 1] & 255]
    return out


MOVES = _crc_moves(65)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each CRC after ``by`` zero bytes more."""

    def step(x: np.ndarray, m: np.ndarray) -> np.ndarray:
        return MOVES[m, 0, x & 255] ^ MOVES[m, 1, x >> 8 & 255] ^ MOVES[m, 2, x >> 16 & 255] ^ MOVES[m, 3, x >> 24]

    out = step(crc, by & 63)
    left = by >> 6
    while (far := np.flatnonzero(left > 0)).size:  # words of 64 bytes and more
        out[far] = step(out[far], np.full(far.size, 64))
        left[far] -= 1
    return out


def features(texts: list[bytes], buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts together: every feature's bucket, its text's number, and the number of words of each text."""
    joined = SEPARATOR.join(texts).lower()  # bytes: A-Z alone
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SEPARATOR)
    offsets = np.cumsum(sizes) - sizes
    parts = pa.array(BETWEEN.split(joined), pa.large_binary())  # words at even places
    ends = np.frombuffer(parts.buffers()[1], np.int64)[1::2]
    words = parts.take(pa.array(np.arange(0, len(parts), 2)))
    held = np.flatnonzero(pc.binary_length(words).to_numpy())  # all but an empty one at either end
    coded, ends = words.take(pa.array(held)).dictionary_encode(), ends[held]
    at, uniq = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    sizes_of = np.fromiter(map(len, uniq), np.int64, len(uniq))
    crcs = np.fromiter(map(zlib.crc32, uniq), np.uint32, len(uniq))
    crc, size, spaced = crcs[at], sizes_of[at], (crcs ^ moved(np.full(len(uniq), zlib.crc32(b" "), np.uint32), sizes_of))[at]
    doc = np.searchsorted(offsets, ends - size, side="right") - 1
    found, docs = [crc % np.uint32(buckets)], [doc]
    for n in range(2, longest + 1):
        crc = moved(crc[:-1], size[n - 1 :] + 1) ^ spaced[n - 1 :]
        within = doc[: len(crc)] == doc[n - 1 :]
        found.append(crc[within] % np.uint32(buckets))
        docs.append(doc[: len(crc)][within])
    return np.concatenate(found).astype(np.int64), np.concatenate(docs), np.bincount(doc, minlength=len(texts))


def _groups(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch in stretches of ``JOINED`` bytes, each with the number of its first text."""
    held, size, first = [], 0, 0
    for i, t in enumerate(column.cast(pa.binary()).to_pylist()):
        if held and size + len(t) > JOINED:
            yield first, held
            held, size, first = [], 0, i
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, text_col: str = "text") -> DataFrame:
    """(bucket, n) over all rows: each task sends a row for each bucket that it met.  Null and empty texts have no features."""
    batched(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, held in _groups(batch.column(0)):
                total += np.bincount(features(held, buckets, longest)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed target and raw shares, by bucket; at most ``buckets`` rows of each come to the driver."""
    counts = np.zeros((2, buckets))
    for k, side in enumerate((raw, target)):
        for r in side.collect():
            counts[k, r.bucket] = r.n
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of every row: the gains of its features added up, repeats counted, 0 without any."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, many, weight = batch.num_rows, [], [], []
            for _, held in _groups(batch.column(1)):
                bucket, doc, n_words = features(held, len(gain), longest)
                words.append(n_words)
                many.append(np.bincount(doc, minlength=len(held)))
                weight.append(np.bincount(doc, weights=gain[bucket], minlength=len(held)))  # whole numbers below 2**53
            columns = [np.concatenate(x).astype(np.int64) if n else np.zeros(0, np.int64) for x in (words, many, weight)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in columns)], ["id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = 42) -> Column:
    """floor(1000 g) of a standard Gumbel number that the seed and the id fix; a null id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(weighed: DataFrame, percent: int, least_words: int, seed: int = 42) -> DataFrame:
    """``weighed`` with score (weight and a Gumbel number) and rank: the draw without replacement of ``percent`` of
    the rows that have ``least_words``, highest score first, ties to the smaller id; null where not drawn.

    Rows are dealt by ranges of the order and numbered in each; the counts of the ranges (a row each) give what comes before.
    Rows of equal id, words and features are interchangeable.
    """
    spark = weighed.sparkSession
    scored = weighed.withColumn("score", F.col("weight") + gumbel("id", seed))
    key = [F.when(F.col("n_words") >= least_words, F.col("score")).desc_nulls_last(), F.col("id").asc_nulls_last()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(scored, "weighed").repartitionByRange(parts, *key).sortWithinPartitions(*key)
    numbered = written(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")  # range in the high bits, place in the low 33
    part = F.shiftright("at", 33)
    counted = numbered.groupBy(part.alias("part")).agg(F.count(F.when(F.col("n_words") >= least_words, 1)).alias("n"))
    order = Window.orderBy("part")  # a row a range
    before = counted.select("part", (F.sum("n").over(order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    drawn = (F.col("n_words") >= least_words) & (place <= F.expr(f"`all` * {int(percent)} div 100"))
    joined = numbered.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.select(*weighed.columns, "score", F.when(drawn, place).alias("rank"))
