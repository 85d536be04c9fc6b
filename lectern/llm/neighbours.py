"""Nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Vectors are projected on ``DIMS`` random normal directions: over their choice, the squared projected
distance of two vectors, divided by their true one, is chi-square with ``DIMS`` degrees.  A search
takes points in the order of their projected distance, verifies each by its true distance, and stops
when a point as near as the k-th found would have been met by now with probability ``SURE``.

The first splits of one kd-tree over a bounded sample's projections cut space into cells, more of them for
more vectors; each cell's rows, in blocks of bounded size, get kd-trees of their own in the tasks that hold
them.  A query first searches its own cell; the k-th distance it finds then rules out cells by the same test
on the distance to their box, and it goes to the others.  A block goes to as many tasks as the queries that come to its
cell need, ``QUERIES`` of them each; cells that no query comes to go nowhere.  Equal vectors are folded into one row first, which
keeps the ``k + 1`` least ids of them: more are never among the nearest.
"""

from __future__ import annotations

from heapq import heappop, heappush
from math import exp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, written

DIMS, SURE, SAMPLE, CELLS, BLOCK, LEAF, QUERIES = 8, 0.97, 16384, (64, 4096), 4096, 64, 2048


def chi_square(x: float) -> float:
    """P(chi-square of ``DIMS`` degrees <= x); ``DIMS`` is even."""
    half, term, total = x / 2, 1.0, 1.0
    if half > 700:
        return 1.0
    for i in range(1, DIMS // 2):
        term *= half / i
        total += term
    return 1 - exp(-half) * total


class Tree:
    """A kd-tree: splits, boxes and leaves over points [n, DIMS]."""

    def __init__(self, points: np.ndarray, leaf: int, depth: int = 60):
        self.leaf_rows: list[np.ndarray] = []
        self.root = self._grow(points, np.arange(len(points)), leaf, depth)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int, depth: int):
        here = points[rows]
        spread = np.ptp(here, axis=0) if len(rows) else np.zeros(1)
        if len(rows) <= leaf or depth == 0 or not spread.max() > 0:
            self.leaf_rows.append(rows)
            return len(self.leaf_rows) - 1
        axis = int(np.argmax(spread))
        cut = float(np.median(here[:, axis]))
        left = here[:, axis] < cut
        if not left.any():
            left = here[:, axis] <= cut
        return axis, cut, self._grow(points, rows[left], leaf, depth - 1), self._grow(points, rows[~left], leaf, depth - 1)

    def nearest_leaves(self, q: np.ndarray):
        """(squared projected distance of the box, leaf), nearest first."""
        heap, count = [(0.0, 0, self.root, np.zeros(len(q)))], 1
        while heap:
            far, _, node, off = heappop(heap)
            if isinstance(node, int):
                yield far, node
                continue
            axis, cut, low, high = node
            gap = q[axis] - cut
            near, other = (high, low) if gap >= 0 else (low, high)
            beyond = off.copy()
            beyond[axis] = max(beyond[axis], abs(gap))
            for child, o in ((near, off), (other, beyond)):
                heappush(heap, (float(o @ o), count, child, o))
                count += 1

    def find(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.empty(len(points), np.int64)

        def go(node, rows: np.ndarray) -> None:
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = points[rows, node[0]] < node[1]
                go(node[2], rows[left])
                go(node[3], rows[~left])

        go(self.root, np.arange(len(points)))
        return out


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    """Neither null nor zero, all components finite."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(x.isNotNull() & fine & F.exists(x, lambda c: c != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 1) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` nearest found of each query among all other rows.

    ``is_query``: a condition on columns of ``vectors``.  Distances are Euclidean, in double precision,
    ties go to smaller ids; fewer candidates than ``k`` are all returned.  Vectors that are null,
    zero or hold null or non-finite components take no part, nor do rows with a null id and vectors
    of another length than the commonest (ties: the shorter).  A repeated id counts once for each of
    its vectors.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    batched(spark)
    rows = vectors.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda c: c.cast("double") + 0.0).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    rows = rows.where(usable(F.col("x")))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    rows = rows.where(F.size("x") == dim)
    order = Window.partitionBy("x").orderBy("id")
    least = rows.select("x", "id").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    distinct = written(least.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("v"), "x", "ids"), "vectors")
    asked = rows.where("asks").select("x", F.col("id").alias("query_id")).distinct()
    sample = distinct.select("v", "x").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).select("x").collect()
    directions = np.random.default_rng(seed).standard_normal((dim, DIMS))
    many = min(CELLS[1], max(CELLS[0], distinct.count() // BLOCK))
    cells = Tree(np.array([r[0] for r in sample], float).reshape(-1, dim) @ directions, max(4, min(len(sample), SAMPLE) // many))
    shared = spark.sparkContext.broadcast((cells, directions))  # 2 * CELLS[1] splits at most, and DIMS directions

    def place(batches):
        cells, directions = shared.value
        for batch in batches:
            p = _matrix(pa.chunked_array([batch.column("x")]), dim) @ directions
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.find(p))], [*batch.schema.names, "cell"])

    placed = written(distinct.mapInArrow(place, "v long, x array<double>, ids array<long>, cell long"), "placed")
    blocks = written(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")  # a row a cell
    by_cell = {r["cell"] for r in blocks.collect()}
    in_blocks = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks"))).drop("blocks")
    queries = asked.join(placed.select("x", "v", "cell"), "x").select("v", "x", "cell").distinct()
    homes = queries.select(
        F.col("v").alias("q"), "x", F.lit(float("inf")).alias("bound"), F.array(F.struct(F.col("cell").alias("cell"), F.lit(0.0).alias("far"))).alias("cells"), "cell"
    )

    def search(asking: DataFrame) -> DataFrame:
        """(q, v, ids, d): of each query's cells and blocks what is nearest in each."""
        asking = written(asking.select("q", "x", "bound", F.explode("cells").alias("c")).select("q", "x", "bound", "c.cell"), "asking")
        parts = F.broadcast(asking.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).alias("parts")))  # a row a cell
        asking = asking.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts"))).join(F.broadcast(blocks), "cell")
        asking = asking.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        held = in_blocks.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

        def visit(left: pa.Table, right: pa.Table) -> pa.Table:
            _, directions = shared.value
            out = ([], [], [], [])
            if left.num_rows and right.num_rows:
                x, qs = _matrix(left["x"], dim), _matrix(right["x"], dim)
                points, asks = x @ directions, qs @ directions
                v, ids = left["v"].to_numpy(), left["ids"].to_pylist()
                tree = Tree(points, LEAF)
                for q, bound, full, p in zip(right["q"].to_pylist(), right["bound"].to_pylist(), qs, asks, strict=True):
                    best_d, best = np.zeros(0), np.zeros(0, np.int64)
                    for far, leaf in tree.nearest_leaves(p):
                        kth = min(bound, best_d[k] if len(best_d) > k else np.inf)
                        if kth < np.inf and far > 0 and (kth == 0 or chi_square(far / kth**2) >= SURE):
                            break
                        rows = tree.leaf_rows[leaf]
                        diff = x[rows] - full
                        d = np.sqrt((diff * diff).sum(1))
                        best_d, best = np.concatenate((best_d, d)), np.concatenate((best, rows))
                        keep = np.lexsort((v[best], best_d))[: k + 1]
                        best_d, best = best_d[keep], best[keep]
                    for column, value in zip(out, ([q] * len(best), v[best].tolist(), [ids[i] for i in best], best_d.tolist()), strict=True):
                        column += value
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64())
            return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["q", "v", "ids", "d"])

        keys = ["cell", "block", "part"]
        return held.select(*keys, "v", "x", "ids").groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInArrow(visit, "q long, v long, ids array<long>, d double")

    top = Window.partitionBy("q").orderBy("d", "v")
    found = written(search(homes), "near")
    kth = found.withColumn("n", F.row_number().over(top)).where(F.col("n") == k + 1).select("q", F.col("d").alias("bound"))
    bounded = homes.drop("bound", "cells").join(kth, "q", "left").select("q", "x", "cell", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))

    def others(batches):
        cells, directions = shared.value
        for batch in batches:
            out = []
            p = _matrix(pa.chunked_array([batch.column("x")]), dim) @ directions
            for at, home, bound in zip(p, batch.column("cell").to_pylist(), batch.column("bound").to_pylist(), strict=True):
                here = []
                for far, cell in cells.nearest_leaves(at):
                    if bound < np.inf and far > 0 and (bound == 0 or chi_square(far / bound**2) >= SURE):
                        break
                    if cell != home and cell in by_cell:
                        here.append({"cell": cell, "far": far})
                out.append(here)
            kind = pa.list_(pa.struct([("cell", pa.int64()), ("far", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("x"), batch.column("bound"), pa.array(out, kind)], ["q", "x", "bound", "cells"])

    further = bounded.mapInArrow(others, "q long, x array<double>, bound double, cells array<struct<cell:long,far:double>>")
    every = found.unionByName(search(further)).withColumn("n", F.row_number().over(top)).where(F.col("n") <= k + 1)
    answers = every.select("q", F.explode("ids").alias("id"), "d")
    named = asked.join(queries.select("x", F.col("v").alias("q")), "x").select("query_id", "q")
    by_rank = Window.partitionBy("query_id").orderBy("d", "id")
    ranked = named.join(answers, "q").where("id <> query_id").withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", F.col("d").alias("distance"))
