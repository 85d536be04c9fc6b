"""What the operators share: the written-table folder, and the words of a batch of texts."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; long texts make a batch smaller, never a text shorter.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only on a single machine that names none."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, name: str, keep_path: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    if keep_path is not None:
        keep_path.append(path)
    return spark.read.schema(df.schema).parquet(path)


def batched(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python functions get."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Gives memory that is free back to the system: a Python worker lives on after its task and would keep it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 400) -> Iterator[pa.RecordBatch]:
    """The batches in slices of ``rows``, for work that needs many times the memory of its texts; free memory goes back at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    give_back()


def columns_but(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but those of these names, in any case, as Spark tells names apart by default."""
    out = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in out]


def packed(names: list[str]) -> list[Column]:
    """The columns of these names, whatever signs they hold; a constant if there are none, as a struct needs a field."""
    return [F.col("`" + n.replace("`", "``") + "`").alias(n) for n in names] or [F.lit(0).alias("none")]


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts, each distinct word held once.

    ``uniq``: the distinct words (Arrow strings); ``ids``: for every word its index there;
    ``offsets``: text ``i`` has the words ``offsets[i]:offsets[i + 1]``.  A null text has none.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        if lower:
            texts = pc.ascii_lower(texts)
        lists = pc.ascii_split_whitespace(texts)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        at = lists.offsets.to_numpy()
        coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        self.uniq = coded.dictionary
        ids, at = coded.indices.to_numpy().astype(np.int64), at - at[0]
        empty = pc.index(self.uniq, pa.scalar("", self.uniq.type)).as_py() if len(self.uniq) else -1
        if empty >= 0:
            keep = ids != empty
            at = np.concatenate(([0], np.cumsum(keep)))[at]
            ids = ids[keep]
        self.ids, self.offsets = ids, at.astype(np.int64)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lengths(self) -> np.ndarray:
        """UTF-8 bytes of each distinct word."""
        return pc.binary_length(self.uniq).to_numpy().astype(np.int64)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """XXH64 of each distinct word."""
        digest = xxhash.xxh64_intdigest
        return np.fromiter((digest(w, seed) for w in self.uniq.to_pylist()), np.uint64, len(self.uniq))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts' words, one space between two of a text: the bytes, and where each word starts and ends."""
        n = self.lengths()[self.ids] if len(self.ids) else np.zeros(0, np.int64)
        step = n + 1
        filled = self.offsets[1:][np.diff(self.offsets) > 0]
        step[filled - 1] -= 1
        ends = np.cumsum(step)
        starts = ends - step
        last = np.zeros(len(n), bool)
        last[filled - 1] = True
        stops = np.where(last, ends, ends - 1)
        lists = pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), self.uniq.take(pa.array(self.ids)))
        flat = pc.binary_join(lists, pa.scalar(" ", self.uniq.type))
        buffers, first = flat.buffers(), flat.offset
        if buffers[2] is None:
            return b"", starts, stops
        at = np.frombuffer(buffers[1], np.int32)[first : first + len(flat) + 1]
        return buffers[2].slice(int(at[0]), int(at[-1] - at[0])).to_pybytes(), starts, stops


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd number and its inverse modulo 2**64, so that a window's hash doesn't depend on its place.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """For each place a 64-bit hash of the ``width`` values from there; the last ``width - 1`` places have none.

    Windows that run from one text into the next are hashed too: the caller leaves them out.
    """
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * _powers(_BASE, n), dtype=np.uint64)))
        return mixed((sums[width:] - sums[:-width]) * _powers(_INVERSE, n - width + 1))


def stretches(flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` from ``first`` on, of length ``n`` each, one after the other, and where each starts (one more at the end)."""
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    return flat[np.arange(ends[-1]) + np.repeat(first - ends[:-1], n)], ends


class PairTable:
    """The number of each of some pairs of ids (from 0), looked up for arrays of pairs in hash tables.

    What meets a full place goes to the next table; a pair that is in none has ``none``, and so has one with a negative id.
    """

    FREE = np.uint64((1 << 64) - 1)

    def __init__(self, left: np.ndarray, right: np.ndarray, numbers: np.ndarray, none: int, bits: int = 18):
        self.none, self.shift, self.tables = none, np.uint64(64 - bits), []
        keys, factor = self._keys(left, right), 0x9E3779B97F4A7C15
        while len(keys):
            place = keys * np.uint64(factor) >> self.shift
            _, first = np.unique(place, return_index=True)
            there, number = np.full(1 << bits, self.FREE), np.full(1 << bits, none, np.int32)
            there[place[first]], number[place[first]] = keys[first], numbers[first]
            self.tables.append((np.uint64(factor), there, number))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, numbers = keys[rest], numbers[rest]
            factor = (factor * 0xD1342543DE82EF95 & (1 << 64) - 1) | 1

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self._keys(left, right)
        shape, keys = keys.shape, keys.ravel()
        out, asked = np.full(len(keys), self.none, np.int32), None
        for factor, there, number in self.tables:
            place = keys * factor >> self.shift
            found = there[place]
            hit = found == keys
            if asked is None:
                np.copyto(out, number[place], where=hit)
                more = np.flatnonzero(~hit & (found != self.FREE))
                asked = more
            else:
                out[asked[hit]] = number[place[hit]]
                more = np.flatnonzero(~hit & (found != self.FREE))
                asked = asked[more]
            keys = keys[more]
            if not len(keys):
                break
        return out.reshape(shape)
