"""Removal of word runs that an earlier document has too, by suffix automata of reference shards.

A *window* is ``width`` consecutive words of one document.  Its *anchor* is the least-hashed run of
``width // 2`` words in it, so equal windows have equal anchors at the same place, and a document's
consecutive windows mostly share one.  The windows of one anchor place are a *segment* of at most
``width + width // 2`` words.  Documents that share a window share its anchor, hence:

1. every document gives its anchors; those of a single document are done with;
2. segments of equal words are folded into one, held by its least document;
3. the segments of one anchor are a reference shard: in ascending order of document each streams
   through the suffix automaton of those before it, and its matching statistics tell which of its
   windows occur in a document before (a window ends where ``width`` or more words match);
4. the maximal covered runs of each document are cut out of its text.

A shard thus goes to the one task that streams it: to broadcast every shard to all documents would
read the corpus once a shard.  A shard holds at most ``SHARD`` segments.  An anchor with more (the edge
of a passage that very many documents hold) is split into longer anchors: its segments are cut at half
the reach of their windows, each half takes the words that all its windows share into its anchor, halves
of equal words are folded into one, and those whose anchor no other document has are done with.  After
five halvings a window is its own anchor, so every shard ends below the bound, each halving
costs two rows a segment, and nothing is compared pair by pair.  The owners of the segments that very many
documents hold (at most ``HOT`` of them, whatever the data) are broadcast; the others are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .common import Words, batched, columns_but, mixed, packed, window_hashes, written

WORD_SEED, TEXT_SEED = 11, 12
#: Segments of a reference shard; segments held by so many documents that there are at most ``HOT`` of them are broadcast.
SHARD, HOT = 256, 4096
#: Tells the texts of a repeated id apart.
MARK = "xxhash64(text)"


def anchors_of(words: Words, width: int) -> tuple[np.ndarray, ...]:
    """(text, start, n, at, anchor, content) for every segment of a batch.

    ``start``: the first of its ``n`` windows, as a place in the text; ``at``: the anchor's place from
    there; ``content``: a hash of all its words.
    """
    gram = width // 2
    span = width - gram + 1
    values = words.hashes(WORD_SEED)[words.ids] if len(words.ids) else np.zeros(0, np.uint64)
    counts = np.diff(words.offsets)
    many = np.maximum(counts - width + 1, 0)
    if not many.sum():
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    text = np.repeat(np.arange(len(counts)), many)
    start = np.arange(many.sum()) + np.repeat(words.offsets[:-1] - (np.cumsum(many) - many), many)
    grams = window_hashes(values, gram)
    best = np.empty(len(start), np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    for i in range(0, len(start), 100_000):
        part = start[i : i + 100_000]
        best[i : i + 100_000] = part + np.argmin(views[part], axis=1)
    new = np.ones(len(start), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(start)))
    begin = start[first]
    # the hash of a segment: of its first and last window, of how many it has, and of each between
    windows = window_hashes(mixed(values + np.uint64(TEXT_SEED)), width)[start]
    with np.errstate(over="ignore"):
        content = mixed(np.add.reduceat(mixed(windows * np.uint64(2 * TEXT_SEED + 1)), first) + n.astype(np.uint64))
    return text[first], begin - words.offsets[text[first]], n, best[first] - begin, grams[best[first]], content


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def halves(words: list[str], at: int, width: int, size: int) -> Iterator[tuple[int, int, str, str]]:
    """(first window, its anchor's place, anchor, run) of the parts of a segment that reach ``size`` lengths of words left of its anchor.

    A window that starts k words before the anchor place goes to part k // size.  All windows of a part share the
    words from the least reach on the left to the least reach on the right: these are its longer anchor.
    """
    gram = width // 2
    n, last = len(words) - width + 1, at // size
    for part in range((at - n + 1) // size, last + 1):
        near, far = part * size, part * size + size - 1  # reach to the left of the part's windows
        first, stop = max(0, at - far), min(n - 1, at - near)
        fixed = words[at - near : max(at + gram, at + width - far)]
        yield first, at - first, f"{size} {part} {' '.join(fixed)}", " ".join(words[first : stop + width])


def _split(rows: DataFrame, width: int, size: int) -> DataFrame:
    """The parts of the segments ``rows``, as rows of the same form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in batch.schema.names]
            for a, c, d, lo, at, text in zip(*(batch.column(n).to_pylist() for n in ("anchor", "content", "owner", "lo", "at", "run")), strict=True):
                for first, place, anchor, part in halves(text.split(" "), at, width, size):
                    key, sub = (xxhash.xxh64_intdigest(x, TEXT_SEED) - (1 << 63) for x in (anchor, part))
                    for column, value in zip(out, (a, c, d, key, sub, lo + first, place, part), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, batch.schema, strict=True)], batch.schema.names)

    return rows.select(*SEGMENT_COLUMNS).mapInArrow(run, SEGMENT)


SEGMENT = "anchor long, content long, owner long, key long, sub long, lo int, at int, run string"
SEGMENT_COLUMNS = [c.split()[0] for c in SEGMENT.split(", ")]


def _streamed(rows: DataFrame, width: int) -> DataFrame:
    """(anchor, content, mask): windows of each segment that an earlier document has, found by the automaton of its shard ``key``."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, then owner."""
        shard, held, waiting, key, owner = None, False, [], None, None
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for a, c, d, k, lo, run in zip(*(batch.column(n).to_pylist() for n in ("anchor", "content", "owner", "key", "lo", "run")), strict=True):
                if k != key:
                    shard, held, waiting, key, owner = SuffixAutomaton(), False, [], k, d
                elif d != owner:  # segments of the same document aren't before each other
                    for w in waiting:
                        shard.add(w)
                    held, waiting, owner = True, [], d
                words = run.split(" ")
                waiting.append(words)
                if held:
                    mask = 0
                    for i, matched in enumerate(shard.matching(words)[width - 1 :]):
                        mask |= (matched >= width) << i
                    if mask:
                        for column, value in zip(out, (a, c, mask << lo), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["anchor", "content", "mask"])

    return rows.repartition("key").sortWithinPartitions("key", "owner", "sub", "lo").mapInArrow(stream, "anchor long, content long, mask long")


def shared_windows(docs: DataFrame, width: int = 50, shard: int = SHARD) -> DataFrame:
    """(id, mark, start, bits): bit i is set if the window of ``width`` words at place start + i starts in a document of smaller id too.

    ``docs`` has ``id`` (long, not null) and ``text``; ``mark`` is the text's ``MARK``, as an id may have
    several texts.
    """
    if not 2 <= width <= 124:
        raise ValueError("width: from 2 to 124 words")
    batched(docs.sparkSession)
    docs = docs.select("id", "text", F.expr(MARK).alias("mark"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, start, n, at, anchor, content = anchors_of(Words(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(text)),
                    batch.column(2).take(pa.array(text)),
                    pa.array(start, pa.int32()),
                    pa.array(n, pa.int32()),
                    pa.array(at, pa.int32()),
                    _signed(anchor),
                    _signed(content),
                ],
                ["id", "mark", "start", "n", "at", "anchor", "content"],
            )

    every = written(docs.mapInArrow(segments, "id long, mark long, start int, n int, at int, anchor long, content long"), "segments")
    # tables of their own: the joins then need no partitioning that a count left, so a frequent key's rows can be split
    met = written(every.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor"), "met")
    shared = written(every.join(met, "anchor", "left_semi"), "shared")
    owned = shared.groupBy("anchor", "content").agg(F.min(F.struct("id", "mark", "start", "n", "at")).alias("least"), F.count("*").alias("copies"))
    owned = written(owned.select("anchor", "content", F.col("least.id").alias("owner"), "least.mark", "least.start", "least.n", "least.at", "copies"), "owned")
    several = written(owned.groupBy("anchor").agg(F.count("*").alias("segments")).where("segments > 1").select("anchor"), "several")

    # one text for each segment that has to be compared with others
    spot = F.struct("anchor", "content", "start", "n", "at")
    wanted = owned.join(several, "anchor", "left_semi").groupBy(F.col("owner").alias("id"), "mark").agg(F.collect_list(spot).alias("places"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            data, starts, stops = words.joined()
            out: list[list] = [[] for _ in SEGMENT_COLUMNS]
            for doc, base, spots in zip(batch.column(0).to_pylist(), words.offsets[:-1].tolist(), batch.column(2).to_pylist(), strict=True):
                for s in spots:
                    a = base + s["start"]
                    run = data[starts[a] : stops[a + s["n"] + width - 2]].decode()
                    for column, value in zip(out, (s["anchor"], s["content"], doc, s["anchor"], s["content"], 0, s["at"], run), strict=True):
                        column.append(value)
            kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], SEGMENT_COLUMNS)

    rows = written(docs.join(wanted, ["id", "mark"]).select("id", "text", "places").mapInArrow(texts, SEGMENT), "runs")
    masks, size = [], width - width // 2 + 1
    while size > 1:
        big = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard).select("key"), "big")
        if big.isEmpty():
            break
        masks.append(_streamed(rows.join(big, "key", "left_anti"), width))
        size = -(-size // 2)
        parts = written(_split(rows.join(big, "key", "left_semi"), width, size), "parts")
        least = written(parts.groupBy("key", "sub").agg(F.min("owner").alias("least")), "least")
        more = written(least.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "more")
        joined = parts.join(least, ["key", "sub"])
        equal = joined.where("owner > least").withColumn("n", F.size(F.split("run", " ")) - (width - 1))
        masks.append(equal.select("anchor", "content", F.expr("shiftleft(shiftleft(1L, n) - 1, lo)").alias("mask")))
        rows = written(joined.where("owner = least").join(more, "key", "left_semi").select(*SEGMENT_COLUMNS), "rows")
    masks.append(_streamed(rows, width))
    found = masks[0]
    for more_masks in masks[1:]:
        found = found.unionByName(more_masks)
    found = written(found.groupBy("anchor", "content").agg(F.bit_or("mask").alias("bits")), "masks")

    own = owned.join(found, ["anchor", "content"]).select("anchor", "content", F.col("owner").alias("id"), "bits")
    own = shared.join(own, ["anchor", "content", "id"]).select("id", "mark", "start", "bits")
    copies = owned.where("copies > 1").select("anchor", "content", "owner", "copies")
    often = max(2, shared.count() // HOT + 1)
    hot = F.broadcast(copies.where(F.col("copies") >= often).drop("copies"))  # HOT rows at most
    rest = shared.join(hot, ["anchor", "content"], "left_anti").join(copies.where(F.col("copies") < often).drop("copies"), ["anchor", "content"])
    whole = shared.join(hot, ["anchor", "content"]).unionByName(rest).where("id <> owner")
    return own.unionByName(whole.select("id", "mark", "start", F.expr("shiftleft(1L, n) - 1").alias("bits")))


def cut(texts: pa.Array, spans: pa.Array, width: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The texts without the words covered by their windows (start, bits): new texts, words, words removed.

    What stands between a removed word and the next kept one goes too; texts of which nothing is
    removed stay as they are, to the byte.
    """
    words = Words(texts)
    counts = np.diff(words.offsets)
    edge = np.zeros(len(words.ids) + 1, np.int64)
    at = spans.offsets.to_numpy()
    base = np.repeat(words.offsets[:-1], np.diff(at))
    start, bits = (spans.values.field(i).to_numpy(zero_copy_only=False)[at[0] : at[-1]] for i in range(2))
    row, shift = np.nonzero(bits[:, None] >> np.arange(width - width // 2 + 1) & 1)
    first = start[row] + base[row] + shift
    np.add.at(edge, first, 1)
    np.add.at(edge, first + width, -1)
    gone = np.cumsum(edge)[:-1] > 0
    sums = np.concatenate(([0], np.cumsum(gone)))
    removed = sums[words.offsets[1:]] - sums[words.offsets[:-1]]
    out = texts.to_pylist()
    for i in np.flatnonzero(removed):
        drop, kept, keep_from, here = gone[words.offsets[i] : words.offsets[i + 1]], [], 0, _places(out[i])
        for j in np.flatnonzero(np.diff(np.concatenate(([0], drop.view(np.int8), [0])))).reshape(-1, 2).tolist():
            kept.append(out[i][keep_from : here[j[0]]])
            keep_from = here[j[1]] if j[1] < len(here) else len(out[i])
        out[i] = "".join(kept) + out[i][keep_from:]
    return pa.array(out, pa.string()), counts, removed


def _places(text: str) -> list[int]:
    import re

    return [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def remove_shared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50, shard: int = SHARD) -> DataFrame:
    """``docs`` with ``text_col`` cut, and ``n_words`` and ``n_removed`` (long) before and by that.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  Each word covered by a window whose words also
    start in a document of a smaller id goes; windows are judged on the input.  A null text has no
    words and stays null; rows with a null id stay as they are; rows that share an id don't
    count as before each other, and each loses what earlier ids have of its own text.  Columns
    ``n_words`` and ``n_removed`` that the table has already, in any case, are replaced.
    """
    spark = docs.sparkSession
    batched(spark)
    one, text = packed([id_col])[0].cast("long").alias("id"), packed([text_col])[0].cast("string").alias("text")
    rest = columns_but(docs, text_col, "n_words", "n_removed")
    spans = shared_windows(docs.select(one, text).where("id is not null"), width, shard).groupBy("id", "mark").agg(F.collect_set(F.struct("start", "bits")).alias("spans"))
    inner = docs.select(F.struct(*packed(rest)).alias("row"), one, text).withColumn("mark", F.expr(MARK))
    none = F.array().cast("array<struct<start:int,bits:bigint>>")
    joined = inner.join(spans, ["id", "mark"], "left").select("row", "text", F.coalesce("spans", none).alias("spans"))
    schema = joined.select("row", "text").schema.add("n_words", "long").add("n_removed", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, counts, removed = cut(batch.column(1), batch.column(2), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), text, pa.array(counts), pa.array(removed)], ["row", "text", "n_words", "n_removed"]
            )

    out = joined.mapInArrow(run, schema)
    kept = [c for c in docs.columns if c in rest or c == text_col]
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept), "n_words", "n_removed")
