"""Token-id files: length-delimited binary records with masked checksums and a separate offset index.

A record is ``u64 length, u32 masked crc of the length, payload, u32 masked crc of the payload``,
all little-endian; the payload is the document's id (i64) and its token ids (u16 or u32).  Beside
``part-*.rec`` lies ``part-*.idx``: ``u64 offset, i64 document id, u32 ids`` for every record, which
lets a reader fetch records in any order.  The checksum is CRC-32, rotated and shifted ("masked") as
record files do, so that a checksum of data that holds checksums stays strong.

A task writes its own files, under a name that no other attempt uses, and reports them as one row
of the manifest; files of attempts that failed are in no manifest and are never read.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, batched, new_path, written

MANIFEST = "part long, path string, itemsize int, n_records long, n_tokens long"
_HEAD, _CRC, _ENTRY = struct.Struct("<QI"), struct.Struct("<I"), np.dtype([("offset", "<u8"), ("id", "<i8"), ("n", "<u4")])


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return length + _CRC.pack(masked_crc(length)) + payload + _CRC.pack(masked_crc(payload))


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the record at ``offset``, and where the next one starts; raises ValueError on damage."""
    if offset + 12 > len(data):
        raise ValueError(f"record at {offset}: cut short")
    length, crc = _HEAD.unpack_from(data, offset)
    if crc != masked_crc(data[offset : offset + 8]):
        raise ValueError(f"record at {offset}: its length is damaged")
    end = offset + 12 + length
    payload = data[offset + 12 : end]
    if len(data) < end + 4 or _CRC.unpack_from(data, end)[0] != masked_crc(payload):
        raise ValueError(f"record at {offset}: its payload is damaged")
    return payload, end + 4


def file_system(path: str):
    """pyarrow's file system for a URI of the shared store (file, hdfs, s3, gs, abfs), and the path there."""
    import pyarrow.fs as fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class ChunkEncoder:
    """``Tokenizer.encode`` of whole texts, each distinct run between ASCII white space encoded once.

    Exact where the tokenizer drops white space and no token spans it, as with ``word_bpe_49k.json``.
    The memo is emptied when it holds ``most`` runs.  New runs go to the library as one text with ``mark``, a special token, between two;
    where the tokenizer has none that parts texts, or a run holds it, they go one by one.
    """

    def __init__(self, path: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.memo = Tokenizer.from_file(path), most, {}
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.mark = self._mark()

    def _mark(self) -> tuple[str, int] | None:
        """The text and id of a special token that parts two texts: found as it stands, and in no text that another token's end or start and its own make."""
        added = self.tokenizer.get_added_tokens_decoder()
        apart = lambda a, b: not any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b) - 1) + 1))
        alone = lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        for number, t in added.items():
            plain = t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)
            if plain and all(apart(o.content, t.content) and apart(t.content, o.content) for o in added.values()):
                if all(alone(f"{x}{t.content}{y}") == [*alone(x), number, *alone(y)] for x in ("ab", ".", "é1") for y in ("ab", ".", "é1")):
                    return t.content, number
        return None

    def _coded(self, runs: list[str]) -> list[bytes]:
        """The ids of each run."""
        if self.mark:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark[0].join(runs)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(ids == self.mark[1])
            if len(at) == len(runs) - 1:
                flat, size = ids.tobytes(), self.dtype.itemsize
                ends = [*(at * size).tolist(), len(flat)]
                return [flat[a:b] for a, b in zip([0, *((at + 1) * size).tolist()], ends, strict=True)]
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more at the end)."""
        words = Words(texts)
        uniq = words.uniq.to_pylist()
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        new = [w for w in uniq if w not in memo]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            memo.update(zip(part, self._coded(part), strict=True))
        coded = [memo[w] for w in uniq]
        flat = np.frombuffer(b"".join(coded), self.dtype)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // self.dtype.itemsize
        first = np.cumsum(sizes) - sizes
        n = sizes[words.ids]
        ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
        ids = flat[np.arange(ends[-1]) + np.repeat(first[words.ids] - ends[:-1], n)]
        return ids, ends[words.offsets]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """A Python worker's encoder: the tasks that it runs one after the other share its memo."""
    return ChunkEncoder(path)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the ids of every text, ``end_id`` after each, in ascending id order; gives the manifest.

    A null text is empty: its record holds ``end_id`` alone.  Rows with a null id are left out;
    rows that share an id follow each other in the order of their texts.  An empty table gives an
    empty manifest.
    """
    spark = docs.sparkSession
    batched(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(tokenizer), TaskContext.get()
        store, folder = file_system(path)
        name = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}"
        out, index, at, tokens = None, [], 0, 0
        for batch in batches:
            if out is None:
                store.create_dir(folder, recursive=True)
                out = store.open_output_stream(f"{name}.rec")
            ids, starts = encoder.encode(batch.column(1))
            last = np.array([end_id], encoder.dtype).tobytes()
            for doc, a, b in zip(batch.column(0).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                record = frame(struct.pack("<q", doc) + ids[a:b].tobytes() + last)
                out.write(record)
                index.append((at, doc, b - a + 1))
                at += len(record)
                tokens += b - a + 1
        if out is not None:
            out.close()
            with store.open_output_stream(f"{name}.idx") as f:
                f.write(np.array(index, _ENTRY).tobytes())
            row = [task.partitionId()], [f"{name}.rec"], [encoder.dtype.itemsize], [len(index)], [tokens]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)],
                ["part", "path", "itemsize", "n_records", "n_tokens"],
            )

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .repartitionByRange(parts, "id")  # by id alone: the ranges are sampled to the driver
        .sortWithinPartitions("id", "text")
    )
    return written(ordered.mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """(id, start, ids) of every record, checksums verified; start: the ids of all records before it."""
    spark = manifest.sparkSession
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))  # a row per file
    batched(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(path)
        for batch in batches:
            for name, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                index = np.frombuffer(store.open_input_file(name.removesuffix("rec") + "idx").read(), _ENTRY)
                starts = start + np.cumsum(index["n"].astype(np.int64)) - index["n"]
                with store.open_input_file(name) as f:
                    lo = 0
                    while lo < len(index):  # some megabytes at a time
                        hi = max(lo + 1, int(np.searchsorted(index["offset"], int(index["offset"][lo]) + (8 << 20))))
                        stop = int(index["offset"][hi]) if hi < len(index) else f.size()
                        data, at, rows = f.read_at(stop - int(index["offset"][lo]), int(index["offset"][lo])), 0, []
                        for _ in range(lo, hi):
                            payload, at = unframe(data, at)
                            rows.append(payload)
                        flat = np.frombuffer(b"".join(r[8:] for r in rows), f"<u{size}").astype(np.int32 if size == 4 else np.uint16)
                        ends = np.concatenate(([0], np.cumsum(index["n"][lo:hi].astype(np.int64))))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([struct.unpack_from("<q", r)[0] for r in rows], pa.int64()),
                                pa.array(starts[lo:hi], pa.int64()),
                                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(np.int32))),
                            ],
                            ["id", "start", "ids"],
                        )
                        lo = hi

    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))
    return files.repartition(n).select("path", "itemsize", "before").mapInArrow(run, "id long, start long, ids array<int>")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1, **columns: str) -> tuple[DataFrame, DataFrame, str]:
    """Writes token files into the shared folder; gives the manifest, what is read back, and the path."""
    path = new_path(docs.sparkSession, "tokens")
    manifest = write_token_files(docs, tokenizer, end_id, path, **columns)
    return manifest, read_token_files(manifest, path), path


def session_tokenizer(spark: SparkSession, name: str) -> str:
    """Where a public tokenizer's file lies: below ``lectern.tokenizers.dir`` if the session sets it."""
    folder = spark.conf.get("lectern.tokenizers.dir", None)
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))
