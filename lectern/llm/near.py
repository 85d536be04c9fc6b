"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

Candidates come from two kinds of buckets, and each is then verified on the whole shingle sets:

* SimHash: fingerprints at most ``RADIUS`` (5) bits apart have a 32-bit half at most two bits apart,
  hence a common variant of that half at most one bit from each.  This ball is exact, but two texts
  of similarity 0.8 are some ten bits apart.
* MinHash: ``BANDS`` keys of ``ROWS`` minima each.  Two texts of similarity s share a key with
  probability 1 - (1 - s**5)**20: 0.9996 at 0.8, more above.

Texts of equal shingle sets are folded into one before.  In a bucket every member meets first the ``NEXT``
after it in an order that the bucket's key shuffles: all pairs of up to ``NEXT + 1`` members.  In larger buckets
every two members that the links so far leave in different groups meet then, if the sizes and the parities of their
sets allow the similarity at all.  A link inside a group changes no group, so the groups are those of all pairs of every bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batched, mixed, sliced, window_hashes, written
from .components import connected_components
from .simhash import fingerprints_of

BANDS, ROWS, NEXT, RADIUS = 20, 5, 3, 5
#: 64-bit words of a set's parity.
PARITY = 16
_DRAWN = np.random.default_rng(5).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64, endpoint=False)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): each text's distinct shingles of ``width`` words, ascending; A-Z count as a-z.

    A text of fewer words is one shingle, one without words has none.
    """
    words = Words(texts, lower=True)
    values = words.hashes(21)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    counts = np.diff(words.offsets)
    sets = []
    long = window_hashes(values, width)
    for a, n in zip(words.offsets[:-1].tolist(), counts.tolist(), strict=True):
        if n >= width:
            sets.append(np.unique(long[a : a + n - width + 1]))
        else:
            sets.append(np.array([xxhash.xxh64_intdigest(values[a : a + n].tobytes(), 22)] if n else [], np.uint64))
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64)))


def set_hashes(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One signed 64-bit hash of each set; 0 of an empty one."""
    return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes(), 23) if b > a else 0 for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64).view(np.int64)


def band_keys(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``BANDS`` signed 64-bit keys of each set that isn't empty, as rows of an array."""
    filled = np.flatnonzero(np.diff(offsets))
    least = np.empty((BANDS * ROWS, len(filled)), np.uint64)
    for i in range(BANDS * ROWS if len(filled) else 0):
        least[i] = np.minimum.reduceat((hashes ^ _XOR[i]) * _TIMES[i], offsets[:-1][filled])
    keys = np.empty((len(filled), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(filled), b + 1, np.uint64)
        for row in least[b * ROWS : (b + 1) * ROWS]:
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + row)
        keys[:, b] = key
    return keys.view(np.int64)


def _met(buckets: DataFrame, *more: str) -> DataFrame:
    """(key, place, x, near): members (``sig`` and ``more``) of each bucket ``key`` behind its first, and those up to ``NEXT`` before them."""
    order = Window.partitionBy("key").orderBy(F.xxhash64("sig", "key"), "sig")
    member = F.struct("sig", *more)
    near = F.array_compact(F.array(*(F.lag(member, i).over(order) for i in range(1, NEXT + 1))))
    return buckets.select("key", F.row_number().over(order).alias("place"), member.alias("x"), near.alias("near")).where("place > 1")


def _paired(met: DataFrame) -> DataFrame:
    """(a, b), a < b: a member and each of those before it."""
    pairs = met.select("x", F.explode("near").alias("y")).where("x.sig <> y.sig")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _pairs(buckets: DataFrame, *more: str) -> DataFrame:
    """(a, b) and ``more`` as a struct of each, a < b: members ``sig`` of one bucket ``key`` that meet."""
    return _paired(_met(buckets, *more))


def buckets(firsts: DataFrame) -> DataFrame:
    """(key, sig, fp): the buckets of the sets ``sig`` of ``firsts`` (sig, fp, keys); in those by MinHash fp is null, as it decides nothing there."""
    variants = "flatten(transform(array(fp & 4294967295L, shiftrightunsigned(fp, 32)), (h, k) -> transform(sequence(-1, 31), i -> xxhash64(k, if(i < 0, h, h ^ shiftleft(1L, i))))))"
    banded = firsts.select(F.explode("keys").alias("key"), "sig", F.lit(None).cast("long").alias("fp"))
    return banded.unionByName(firsts.where("size(keys) > 0").select(F.explode(F.expr(variants)).alias("key"), "sig", "fp"))


#: Two members of a bucket by SimHash are at most ``RADIUS`` bits apart; of one by MinHash nothing is asked.
WITHIN = f"coalesce(bit_count(a.fp ^ b.fp) <= {RADIUS}, true)"


def candidates(met: DataFrame) -> DataFrame:
    """(a, b), a < b: the sets that meet first in a bucket."""
    return _paired(met).where(WITHIN).select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b")).distinct()


def unmet(met: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, sig, fp, component): the members of buckets of more than ``NEXT + 1`` that are not all in one of the ``groups`` (vertex, component)."""
    large = met.where(F.col("place") > NEXT + 1).select("key").distinct()
    members = met.where("place > 2").select("key", "x").unionByName(met.where("place = 2").select("key", F.explode(F.array("x", F.col("near")[0])).alias("x")))
    members = members.join(large, "key", "left_semi").select("key", "x.*").distinct()
    placed = members.join(groups.withColumnRenamed("vertex", "sig"), "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    several = placed.groupBy("key").agg((F.min("component") < F.max("component")).alias("several")).where("several").select("key")
    return placed.join(several, "key", "left_semi").select("key", "sig", "fp", "component")


def shared_sizes(held: DataFrame) -> DataFrame:
    """(sig, n, k, p0, p1, ...): the size of each set of ``held`` (sig, hashes), how many of its hashes another of the sets has too, and its parity.

    Each hash names one of ``64 * PARITY`` bits; a bit of the parity is 1 if an odd number of the set's hashes name it.  A hash that two sets
    have turns the same bit in both, so their parities differ in no more bits than there are hashes that one of the two alone has.
    """
    counts = held.dropDuplicates(["sig"]).select("sig", F.explode("hashes").alias("hash"))
    often = counts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", F.lit(1).alias("often"))
    parity = [F.coalesce(F.expr(f"bit_xor(if(pmod(shiftright(hash, 6), {PARITY}) = {i}, shiftleft(1L, cast(hash & 63 as int)), 0L))"), F.lit(0).cast("long")).alias(f"p{i}") for i in range(PARITY)]
    return counts.join(often, "hash", "left").groupBy("sig").agg(F.count("*").alias("n"), F.count("often").alias("k"), *parity)


def others(members: DataFrame, sizes: DataFrame, tried: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a < b: the sets of one bucket of ``members`` that are in different components, were not ``tried`` and may be alike.

    Two sets have no more in common than the lesser ``k`` of ``sizes``, and no fewer hashes that one of them alone has than their parities
    have different bits, so a pair for which the one is too little or the other too much is left out.
    """
    placed = members.join(sizes.where(F.col("k") >= similarity * F.col("n")), "sig")
    most = F.least("a.k", "b.k")
    alike = most >= similarity * (F.col("a.n") + F.col("b.n") - most)
    differ = " + ".join(f"bit_count(a.p{i} ^ b.p{i})" for i in range(PARITY))
    alike &= F.expr(f"({differ}) * {1 + similarity}D <= {1 - similarity}D * (a.n + b.n) + 0.001D")  # verified exactly later
    apart = placed.alias("a").join(placed.alias("b"), (F.col("a.key") == F.col("b.key")) & F.expr(f"a.sig < b.sig and a.component <> b.component and {WITHIN}") & alike)
    return apart.select(F.col("a.sig").alias("a"), F.col("b.sig").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every document; component_id: the least id reachable over verified pairs.

    Rows with a null id take no part.  A repeated id keeps a row for each of its texts.  Texts without
    words (null, empty, blank) are copies of each other.
    """
    batched(docs.sparkSession)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes, offsets = shingle_sets(batch.column(1), width)
            filled = np.diff(offsets) > 0
            at = np.concatenate(([0], np.cumsum(filled * BANDS))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(at), pa.array(band_keys(hashes, offsets).ravel()))
            cols = [batch.column(0), pa.array(set_hashes(hashes, offsets)), pa.array(fingerprints_of(batch.column(1), width)), keys]
            yield pa.RecordBatch.from_arrays(cols, ["id", "sig", "fp", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes, offsets = shingle_sets(batch.column(1), width)
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(hashes.view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(set_hashes(hashes, offsets)), lists], ["sig", "hashes"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                held.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(held, pa.bool_())) for i in range(2)], ["a", "b"])

    def sets_of(members: DataFrame) -> DataFrame:
        """(sig, hashes) of the sets ``sig`` of ``members``."""
        needed = firsts.join(members.select("sig").distinct(), "sig", "left_semi").select(F.col("first").alias("id"))
        return written(rows.join(needed.distinct(), "id", "left_semi").select("id", "text").mapInArrow(sets, "sig long, hashes array<long>"), "sets")

    def linked(pairs: DataFrame, held: DataFrame) -> DataFrame:
        """The pairs that are alike, as verified on the whole sets."""
        sides = [held.select(F.col("sig").alias(s), F.col("hashes").alias(f"of_{s}")) for s in "ab"]
        return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "of_a", "of_b").mapInArrow(verified, "a long, b long")

    marked = written(rows.mapInArrow(sketch, "id long, sig long, fp long, keys array<long>"), "sketches")
    firsts = written(marked.groupBy("sig").agg(F.min("id").alias("first"), F.min_by("fp", "id").alias("fp"), F.min_by("keys", "id").alias("keys")), "firsts")
    met = written(_met(buckets(firsts), "fp"), "met")
    pairs = written(candidates(met), "candidates")
    links = written(linked(pairs, sets_of(pairs.select(F.explode(F.array("a", "b")).alias("sig")))), "links")
    groups = connected_components(links)
    members = written(unmet(met, groups), "unmet")
    if members.limit(1).count():
        held = sets_of(members)
        rest = written(others(members, written(shared_sizes(held), "sizes"), pairs, similarity), "others")
        if rest.limit(1).count():
            groups = connected_components(links.unionByName(written(linked(rest, held), "links")))
    by_group = firsts.join(groups, firsts.sig == groups.vertex).select("sig", "component", "first")
    least = by_group.groupBy("component").agg(F.min("first").alias("component_id"))
    joined = by_group.join(least, "component").select("sig", "component_id")
    # a table of its own: the join below then has no partitioning to keep, so a frequent text's rows can be split
    own = written(firsts.join(joined, "sig", "left").select("sig", F.coalesce("component_id", "first").alias("component_id")), "components")
    return marked.select("id", "sig").join(own, "sig").select("id", "component_id")
