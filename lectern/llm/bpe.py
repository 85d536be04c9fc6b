"""Byte-pair encoding with a contiguous rank array, and its decoding.

A short word is a row of parts with the merge rank of each part and the next beside it.  The row is scanned for
the least rank, the boundary between its two parts is deleted, and the ranks of the two neighbours are looked up
anew, until nothing merges.  Many words are rows of one array, and each round does one merge in all of them.
Words of over 64 bytes keep an agenda (a heap) of the same ranks, as a scan a merge is quadratic.
Tokenizer files are JSON with a vocabulary, ordered merges, word ends and byte-level signs, such as ``word_bpe_49k.json``.

Texts meet the same steps as in the tokenizers library: added tokens are found in the raw text, the rest is
normalised (NFC, white space, lower case sign by sign), cut by the pattern, and spelled in byte signs.
None of these steps looks across white space, so the distinct runs between ASCII white space are cut together, once a batch.
Signs that Unicode assigned after the version of ``unicodedata`` are cut as signs that are no letters.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PairTable, Words, batched, stretches

#: A word of so many bytes at most is a row of that width; longer ones take the agenda.
WIDTHS = (4, 8, 12, 16, 24, 32, 64)
#: What the library takes for white space.
BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: No pair has this rank, no part this id.
NEVER, NO_ID = np.int32((1 << 31) - 1), np.int64(-1)
#: Texts of signs below this one have a pattern of their own, with short classes.
LATIN = "\u0250"


def word_pattern(below: int = 0x110000) -> re.Pattern:
    """The file's pattern after the sign that stands between runs: its endings, letters, one number, other signs, for texts of signs below ``below``.  Letters and
    numbers are those of ``unicodedata``."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(below))
    letters, numbers = ("".join(f"\\U{m.start():08x}-\\U{m.end() - 1:08x}" for m in re.finditer(f"{k}+", kinds)) for k in "LN")
    return re.compile(f"\n|'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{BLANK.pattern[1:-2]}{letters}{numbers}]+")


def byte_signs() -> list[str]:
    """The sign of every byte: itself where it is printed, else the next one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


class RankEncoder:
    """Encodes whole texts; the memo of words is emptied when it holds ``most``."""

    def __init__(self, path: str, most: int = 300_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = np.array([(vocab[a], vocab[b]) for a, b in model["merges"]], np.int64)
        self.ranks, self.merged = PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs)), int(NEVER)), np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.single = {(a, b): r for r, (a, b) in enumerate(pairs.tolist())}
        signs = byte_signs()
        self.inner, self.last = (np.array([vocab[c + e] for c in signs], np.int64) for e in ("", end))
        self.added = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.latin, self.pattern = word_pattern(ord(LATIN)), word_pattern()
        self.most, self.words = most, {"\n": b""}

    def short(self, words: list[bytes], width: int) -> list[bytes]:
        """The ids of each word (four bytes each), all of 1 to ``width`` bytes: a row of parts and one of ranks for each word."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        parts = np.full((len(words), width), NO_ID)
        within = np.arange(width) < n[:, None]
        signs = np.frombuffer(b"".join(words), np.uint8)
        parts[within] = self.inner[signs]
        parts[np.arange(len(words)), n - 1] = self.last[signs[np.cumsum(n) - 1]]
        ranks = np.full(parts.shape, NEVER)
        ranks[:, :-1] = self.ranks(parts[:, :-1], parts[:, 1:])
        done: list = [None] * len(words)
        who = np.arange(len(words))
        while len(who):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            row = np.arange(len(who))
            least = ranks[row, at]
            ends = least == NEVER
            if ends.any():
                rows = parts[ends].astype("<i4").tobytes()
                for k, (i, size) in enumerate(zip(who[ends].tolist(), n[who[ends]].tolist(), strict=True)):
                    done[i] = rows[4 * width * k : 4 * (width * k + size)]
                goes = ~ends
                who, at, least, parts, ranks = who[goes], at[goes], least[goes], parts[goes], ranks[goes]
                if not len(who):
                    break
                row = row[: len(who)]
            parts[row, at] = self.merged[least]
            n[who] -= 1
            from_ = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)  # the boundary after `at` goes
            parts, ranks = np.take_along_axis(parts, from_, 1), np.take_along_axis(ranks, from_, 1)
            parts[row, n[who]], ranks[row, n[who] - 1] = NO_ID, NEVER
            after = parts[row, np.minimum(at + 1, width - 1)]
            ranks[row, at] = np.where(at + 1 < n[who], self.ranks(parts[row, at], after), NEVER)
            back = np.flatnonzero(at > 0)
            ranks[back, at[back] - 1] = self.ranks(parts[back, at[back] - 1], parts[back, at[back]])
        return done

    def long(self, word: bytes) -> bytes:
        """The ids of one word of any length: the same merges in the same order (least rank, then leftmost) from an agenda."""
        ids = [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.last[word[-1]])]
        n, ranks = len(ids), self.single
        before, after, lives, agenda = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n, []

        def put(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get((ids[i], ids[j]))) is not None:
                heapq.heappush(agenda, (r, i, ids[i], ids[j]))

        for i in range(n):
            put(i)
        while agenda:
            r, i, a, b = heapq.heappop(agenda)
            j = after[i]
            if lives[i] and j < n and ids[i] == a and ids[j] == b:
                ids[i], lives[j], after[i] = int(self.merged[r]), False, after[j]
                if after[i] < n:
                    before[after[i]] = i
                put(i)
                if before[i] >= 0:
                    put(before[i])
        return np.array([x for x, live in zip(ids, lives, strict=True) if live], "<i4").tobytes()

    def plain(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without added tokens, and how many each has: all runs are cut in one pass, each distinct word is encoded once."""
        text = "\n".join(runs)
        if text.isascii():
            low, pattern = text.lower(), self.latin
        else:
            text = unicodedata.normalize("NFC", text)
            low = text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)
            pattern = self.latin if max(low) < LATIN else self.pattern
        cut = pa.array(pattern.findall(low), pa.large_string()).dictionary_encode()
        words, order = cut.dictionary.to_pylist(), cut.indices.to_numpy()
        self.learn([w for w in words if w not in self.words])
        coded = [self.words[w] for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids, _ = stretches(np.frombuffer(b"".join(coded), "<i4"), (np.cumsum(sizes) - sizes)[order], sizes[order])
        ends = np.fromiter((w == "\n" for w in words), bool, len(words))[order]  # the sign between runs
        return ids, np.bincount(np.cumsum(ends), weights=sizes[order], minlength=len(runs)).astype(np.int64)

    def marked(self, run: str) -> np.ndarray:
        """The ids of a run with added tokens, which are found in the raw text."""
        return np.concatenate([np.array([self.added[p]], "<i4") if k % 2 else self.plain([p])[0] for k, p in enumerate(self.split.split(run)) if p])

    def runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all runs, and where those of each run start and how many they are."""
        first, sizes = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        there = self.split is not None and self.split.search("\n".join(runs)) is not None
        marked = [i for i, r in enumerate(runs) if self.split.search(r)] if there else []
        rest = [i for i, r in enumerate(runs) if not self.split.search(r)] if there else range(len(runs))
        groups = [[i for i in rest if runs[i].isascii()], [i for i in rest if not runs[i].isascii()]]
        flat, at = [np.zeros(0, "<i4")], 0
        for group in groups:
            if group:
                ids, n = self.plain([runs[i] for i in group])
                sizes[group], first[group] = n, at + np.cumsum(n) - n
                flat.append(ids)
                at += len(ids)
        for i in marked:
            ids = self.marked(runs[i])
            sizes[i], first[i] = len(ids), at
            flat.append(ids)
            at += len(ids)
        return np.concatenate(flat), first, sizes

    def learn(self, new: list[str]) -> None:
        """Puts the ids of these words into the memo."""
        spelt = [w.encode() for w in new]
        kind = np.searchsorted(WIDTHS, np.fromiter(map(len, spelt), np.int64, len(spelt)))
        for k in np.unique(kind).tolist():
            at = np.flatnonzero(kind == k).tolist()
            for i in range(0, len(at), 8192):
                part = at[i : i + 8192]
                words = [spelt[j] for j in part]
                ids = self.short(words, WIDTHS[k]) if k < len(WIDTHS) else map(self.long, words)
                self.words.update(zip([new[j] for j in part], ids, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's start (one more at the end)."""
        if len(self.words) > self.most:
            self.words = {"\n": b""}
        words = Words(texts)
        flat, first, sizes = self.runs(words.uniq.to_pylist())
        ids, ends = stretches(flat, first[words.ids], sizes[words.ids])
        return ids, ends[words.offsets]


class Decoder:
    """The library's decoding of a file that names no decoder: the tokens as the vocabulary spells them, one space between."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        tokens = {i: t for t, i in told["model"]["vocab"].items()} | {t["id"]: t["content"] for t in told["added_tokens"]}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.large_string())

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list; ids that the vocabulary lacks are left out, a null list gives an empty text."""
        flat, at = ids.values.to_numpy(), ids.offsets.to_numpy()
        known = (flat >= 0) & (flat < len(self.tokens))
        known[known] = self.tokens.take(pa.array(flat[known])).is_valid().to_numpy(zero_copy_only=False)
        if not known.all():
            at, flat = np.concatenate((np.zeros(1, np.int64), np.cumsum(known)))[at], flat[known]
        lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), self.tokens.take(pa.array(flat)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


@lru_cache(maxsize=1)
def _encoder(path: str) -> RankEncoder:
    return RankEncoder(path)


@lru_cache(maxsize=1)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids) of every row.  A null text is empty and has no ids; rows may repeat and ids be null; other columns are dropped."""
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            ids, starts = encoder.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, tokenizer: str) -> DataFrame:
    """``coded`` (id, ids) with the text that the ids decode to; null ids decode to an empty text."""
    batched(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoder.decode(batch.column(1))], ["id", "ids", "text"])

    return coded.select("id", "ids").mapInArrow(run, f"id {coded.schema['id'].dataType.simpleString()}, ids array<int>, text string")
