"""SentencePiece (BPE) encoding with seeded merge-dropout, and decoding.

Merges are taken from an agenda ordered by piece score, then place.  Each candidate taken is skipped
if a hash of (seed, document id, place of its run, place in the run, piece) falls below the dropout
rate, so a segmentation depends on its key alone: any task, retry or cluster gives the same ids, and a
word that repeats in a document is cut in varied ways.  With rate 0 the ids are the library's own.
Each task remembers how the runs it has met are segmented without a skip, and which candidates that
takes, some hundred thousand at most; where one of them is skipped, the run is segmented anew.

No piece of a BPE model with split white space spans the start of a white-space run, nor, where the
vocabulary shows it, the place between a letter and a mark after it, so the text is segmented run by
run.  Decoding gives the text back exactly, the sign U+2581 and control characters
included: what the model has no piece for, and U+2581 itself, is spelled in byte pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PairTable, batched, give_back, mixed, stretches

SPACE = "▁"
MARKS = ",.;:!?$%&*#|"
_MASK, _NONE = (1 << 32) - 1, (1 << 31) - 1


def _place_keys(text_keys: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The key of each run: below 2**32, by its text's key and its place there."""
    with np.errstate(over="ignore"):
        return mixed(text_keys + place * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(_MASK)


def _drawn(key: np.ndarray, place: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """A number below 2**32 for each candidate: skipped if it is below the limit."""
    with np.errstate(over="ignore"):
        x = (key + place * np.uint64(0x9E3779B1) ^ rank * np.uint64(0x85EBCA6B)) & np.uint64(_MASK)
        x = (x ^ x >> np.uint64(15)) * np.uint64(0xC2B2AE35) & np.uint64(_MASK)
        return x ^ x >> np.uint64(13)


def spellings(model) -> list[bytes]:
    """The bytes of every piece of a loaded model; none of control pieces."""
    n = range(model.get_piece_size())
    quiet = {i for i in n if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else b"" if i in quiet else model.id_to_piece(i).replace(SPACE, " ").encode() for i in n]


def spelled_out(ids: list[int], spelled: list[bytes]) -> str:
    """The text of ids; ids of control pieces give nothing."""
    out = b"".join(map(spelled.__getitem__, ids))
    return (out[1:] if out[:1] == b" " else out).decode("utf-8", "surrogatepass")


class PieceCodec:
    """A SentencePiece BPE model with byte pieces; ``rate`` in [0, 1): the share of candidate merges skipped."""

    def __init__(self, path: str, rate: float = 0.0, most: int = 200_000):
        import sentencepiece

        if not 0 <= rate < 1:
            raise ValueError("rate: from 0 to below 1")
        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.limit, self.most, self.memo, self.older = int(rate * (1 << 32)), most, {}, {}
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {i: bytes([int(self.pieces[i][3:5], 16)]) for i in range(n) if model.is_byte(i)}
        self.byte_ids = {b[0]: i for i, b in self.bytes.items()}
        odd = set(self.bytes) | {i for i in range(n) if model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        self.spelled = spellings(model)
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in odd}
        self.names = sorted(self.ids, key=lambda p: (-model.get_score(self.ids[p]), self.ids[p]))  # by rank
        joins = {p[i - 1 : i + 1] for p in self.ids for i in range(1, len(p))}
        marks, before = set(MARKS), None
        while marks != before:
            before = marks
            marks = {c for c in before if not any(j[1] == c and j[0] not in before and j[0] != SPACE for j in joins)}
        own = "".join(map(re.escape, sorted(marks)))
        rest = rf"[^ \n{own}]"
        #: A run: white space of one kind and what follows it, or marks that no piece joins to what is before them.
        self.runs = re.compile(rf" +[{own}]*{rest}*|\n+{rest}*|[{own}]+{rest}*|{rest}+" if own else rf" +{rest}*|\n+{rest}*|{rest}+")
        self.rank = {p: r for r, p in enumerate(self.names)}

    def _spell(self, symbol: str) -> list[int]:
        return [self.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def segment(self, run: str, key: int = 0, tried: list[int] | None = None) -> list[int]:
        """The ids of one run, whose spaces are U+2581 (a literal U+2581 is U+0000 U+2581 here).

        ``key``: of this place of this text, below 2**32; ``tried`` gets the candidates taken, as place << 32 | rank.
        """
        symbols = re.findall("\0?.", run, re.DOTALL) if "\0" in run else list(run)
        rank, names, limit, n = self.rank, self.names, 0 if tried is not None else self.limit, len(symbols)
        agenda, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            r = rank.get(left + right)
            if r is not None:
                agenda.append(r << 32 | i - 1)
            left = right
        if agenda:
            heapify(agenda)
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            while agenda:
                item = heappop(agenda)
                i = item & _MASK
                j = after[i]
                if j >= n:
                    continue
                r = item >> 32
                if symbols[i] + symbols[j] != names[r] or not symbols[i]:
                    continue  # a part was merged elsewhere
                if tried is not None:
                    tried.append(i << 32 | r)
                if limit:
                    x = (key + i * 0x9E3779B1 ^ r * 0x85EBCA6B) & _MASK
                    x = (x ^ x >> 15) * 0xC2B2AE35 & _MASK
                    if x ^ x >> 13 < limit:
                        continue
                symbols[i] = here = names[r]
                symbols[j] = ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    r = rank.get(here + symbols[k])
                    if r is not None:
                        heappush(agenda, r << 32 | i)
                h = before[i]
                if h >= 0:
                    r = rank.get(symbols[h] + here)
                    if r is not None:
                        heappush(agenda, r << 32 | h)
        ids, out = self.ids, []
        for s in symbols:
            if s:
                known = ids.get(s)
                if known is None:
                    out += self._spell(s[1:] if len(s) == 2 and s[0] == "\0" else s)
                else:
                    out.append(known)
        return out

    def _pairs(self) -> None:
        """The ranks of the merges by their pairs of ids, and the ids of single characters (below zero if there is none)."""
        ids = self.ids
        found = [(ids[p[:i]] << 32 | ids[p[i:]], r) for p, r in self.rank.items() for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        keys, ranks = (np.array(x) for x in zip(*found, strict=True))
        self._ranks = PairTable(keys >> 32, keys & _MASK, ranks, _NONE)
        self.rank_ids = np.array([ids[p] for p in self.names])
        self.chars = -10 - np.arange(0x110000)
        for p, i in ids.items():
            if len(p) == 1:
                self.chars[ord(p)] = i
        self.chars[ord(" ")] = self.chars[ord(SPACE)]

    def segment_many(self, runs: list[str], keys: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """``segment`` of many short runs at once: their agendas advance step by step together.  Spaces may stand as they are.

        Gives all ids, and where those of each run start and how many they are.  ``keys``: one a run; without them nothing
        is skipped, and the candidates taken follow in the same way.
        """
        if not hasattr(self, "_ranks"):
            self._pairs()
        size = -(-np.fromiter(map(len, runs), np.int64, len(runs)) // 4) * 4
        size[[i for i, r in enumerate(runs) if "\0" in r]] = 1000
        parts = []
        for width in np.unique(size).tolist():
            where = np.flatnonzero(size == width)
            if width > 48:
                for i in where.tolist():
                    mine: list[int] | None = None if keys is not None else []
                    ids = self.segment(runs[i].replace(" ", SPACE), 0 if keys is None else int(keys[i]), mine)
                    parts.append(([i], np.array(ids, np.int32), [len(ids)], np.array(mine or [], np.uint64), [len(mine or [])]))
                continue
            for k in range(0, len(where), 20_000):
                part = where[k : k + 20_000]
                parts.append((part, *self._advance([runs[i] for i in part.tolist()], width, None if keys is None else keys[part])))
        if not parts:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        order, flat, n, codes, n_codes = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = []
        for data, many in ((flat, n),) if keys is not None else ((flat, n), (codes, n_codes)):
            first, sizes = np.empty(len(runs), np.int64), np.empty(len(runs), np.int64)
            first[order], sizes[order] = np.cumsum(many) - many, many
            out += [data, first, sizes]
        return tuple(out)

    def _advance(self, runs: list[str], size: int, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A step takes the best candidate of every run; neighbours are linked, so a merge touches its own places only.

        Gives the ids of all runs, how many each has, the candidates taken (without keys) and how many.
        """
        limit, columns, none = self.limit, np.arange(size), np.int32(_NONE)
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        sym = np.full((len(runs), size), -1, np.int32)
        sym[columns < sizes[:, None]] = self.chars[np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), np.uint32)]
        key = keys.astype(np.uint64) if keys is not None else None
        after = np.where(columns + 1 < sizes[:, None], columns + 1, size).astype(np.int16)
        before = np.tile((columns - 1).astype(np.int16), (len(runs), 1))
        rank = np.full((len(runs), size), none, np.int32)
        rank[:, :-1] = self._ranks(sym[:, :-1], sym[:, 1:])
        done = np.empty_like(sym)
        row, taken = np.arange(len(runs)), []
        while True:
            j = np.argmin(rank, axis=1)
            best = rank[np.arange(len(row)), j]
            go = best < none
            n = np.flatnonzero(go)
            if len(n) < 0.7 * len(row):
                done[row[~go]] = sym[~go]
                if not len(n):
                    break
                row, sym, after, before, rank, j, best = (x[n] for x in (row, sym, after, before, rank, j, best))
                n = np.arange(len(row))
            i, r = j[n], best[n]
            if key is None:
                taken.append((row[n], i.astype(np.uint64) << np.uint64(32) | r.astype(np.uint64)))
            else:
                merge = _drawn(key[row[n]], i.astype(np.uint64), r.astype(np.uint64)) >= limit
                rank[n[~merge], i[~merge]] = none
                n, i, r = n[merge], i[merge], r[merge]
            made = self.rank_ids[r]
            k = after[n, i]
            beyond = after[n, k]
            sym[n, i], sym[n, k], rank[n, k], after[n, i] = made, -1, none, beyond
            has = beyond < size
            before[n[has], beyond[has]] = i[has]
            right = np.where(has, sym[n, np.minimum(beyond, size - 1)], -1)
            rank[n, i] = self._ranks(made, right)
            h = before[n, i]
            has = h >= 0
            n, h, made = n[has], h[has], made[has]
            rank[n, h] = self._ranks(sym[n, h], made)
        there = done != -1
        n, flat = there.sum(1), done[there]
        if (odd := np.flatnonzero(flat < 0)).size:  # spelled in bytes
            spelled = [self._spell(chr(-10 - c)) for c in flat[odd].tolist()]
            more = np.ones(len(flat), np.int64)
            more[odd] = [len(x) for x in spelled]
            n = np.add.reduceat(more, np.cumsum(n) - n)
            flat = np.repeat(flat, more)
            flat[np.repeat(np.isin(np.arange(len(more)), odd), more)] = np.concatenate(spelled)
        if not taken:
            return flat.astype(np.int32), n, np.zeros(0, np.uint64), np.zeros(len(runs), np.int64)
        rows, codes = (np.concatenate(x) for x in zip(*taken, strict=True))
        return flat.astype(np.int32), n, codes[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(runs))

    def _learn(self, runs: list[str]) -> None:
        """Remembers the segmentation of runs without any skip, and the candidates that it takes."""
        if len(self.memo) >= self.most:  # what hasn't been met since the last time goes
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        for r in runs:
            if r not in memo and r in older:
                memo[r] = older[r]
        new = [r for r in runs if r not in memo]
        if new:
            flat, first, n, codes, at, many = self.segment_many(new)
            data, code = flat.tobytes(), codes.tobytes()
            pairs = zip((4 * first).tolist(), (4 * (first + n)).tolist(), (8 * at).tolist(), (8 * (at + many)).tolist(), strict=True)
            memo.update(zip(new, [(data[a:b], code[c:d]) for a, b, c, d in pairs], strict=True))

    def encode_many(self, texts: list[str], keys: list[int]) -> list[bytes]:
        """``encode_bytes`` of many texts.

        The candidates of every run at every place are drawn; a run of which none is skipped is segmented
        as ever, and the others are segmented together.
        """
        out: list[bytes] = [b""] * len(texts)
        where, split, many = [], [], 0
        for i, text in enumerate(texts):
            if "\0" in text or SPACE in text:
                out[i] = self.encode_bytes(text, keys[i])
            elif text:
                where.append(i)
                split.append(self.runs.findall(" " + text))
                many += len(split[-1])
            if many > 100_000:  # so many runs at a time
                self._encode(where, split, keys, out)
                where, split, many = [], [], 0
        if where:
            self._encode(where, split, keys, out)
        return out

    def _encode(self, where: list[int], split: list[list[str]], keys: list[int], out: list[bytes]) -> None:
        flat = [r for runs in split for r in runs]
        number = {r: k for k, r in enumerate(dict.fromkeys(flat))}
        self._learn(list(number))
        known = [self.memo[r] for r in number]
        which = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        data = [np.frombuffer(b"".join([k[0] for k in known]), np.int32)]
        n = np.fromiter((len(k[0]) for k in known), np.int64, len(known)) // 4
        first, many = (np.cumsum(n) - n)[which], n[which]
        if self.limit:
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            own = _place_keys(np.repeat(np.array([keys[i] for i in where], np.uint64), sizes), place.astype(np.uint64))
            codes = np.frombuffer(b"".join([k[1] for k in known]), np.uint64)
            n = np.fromiter((len(k[1]) for k in known), np.int64, len(known)) // 8
            start, each = (np.cumsum(n) - n)[which], n[which]
            at = len(data[0])
            for lo in range(0, len(flat), 100_000):
                m = each[lo : lo + 100_000]
                row = np.repeat(np.arange(lo, lo + len(m)), m)
                code, _ = stretches(codes, start[lo : lo + len(m)], m)
                skip = np.zeros(len(m), bool)
                skip[row[_drawn(own[row], code >> np.uint64(32), code & np.uint64(_MASK)) < self.limit] - lo] = True
                skipped = np.flatnonzero(skip) + lo
                ids, there, n = self.segment_many([flat[i] for i in skipped.tolist()], own[skipped])
                data.append(ids)
                first[skipped], many[skipped] = there + at, n
                at += len(ids)
        ids, ends = stretches(np.concatenate(data), first, many)
        ends = 4 * ends[np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes)))]
        whole = ids.tobytes()
        for i, a, b in zip(where, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = whole[a:b]

    def encode(self, text: str, key: int = 0) -> list[int]:
        return array("i", self.encode_bytes(text, key)).tolist()

    def encode_bytes(self, text: str, key: int = 0) -> bytes:
        """The ids as native 32-bit integers; ``key``: of the text, below 2**64.  Run by run, without a memo."""
        if not text:
            return b""
        if "\0" in text or SPACE in text:  # rare: marked apart, so that they are spelled in bytes
            text = text.replace("\0", "\0\0").replace(SPACE, "\0" + SPACE)
        runs = self.runs.findall(" " + text)
        own = _place_keys(np.full(len(runs), key, np.uint64), np.arange(len(runs), dtype=np.uint64)).tolist()
        return b"".join(array("i", self.segment(r.replace(" ", SPACE), k)).tobytes() for r, k in zip(runs, own, strict=True))

    def decode(self, ids: list[int]) -> str:
        return spelled_out(ids, self.spelled)


def encode(docs: DataFrame, model: str, rate: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; a null text is empty, an empty text has no ids.

    The key is of (seed, id): rows of equal id and text get equal ids, and rows of null id share a key.
    Another seed gives other segmentations.  Other columns don't matter.
    """
    batched(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model, rate)
        for batch in batches:
            keys = [xxhash.xxh64_intdigest(str(i), seed) for i in batch.column(0).to_pylist()]
            coded = codec.encode_many([t or "" for t in batch.column(1).to_pylist()], keys)
            ends = np.cumsum([0, *map(len, coded)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])
        del codec
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids array<int>")


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` (id, ids) with ``text``."""
    batched(coded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        spelled = spellings(sentencepiece.SentencePieceProcessor(model_file=model))
        for batch in batches:
            flat, at = batch.column(1).values.to_numpy(), batch.column(1).offsets.to_numpy()
            text = [spelled_out(flat[a:b].tolist(), spelled) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string())], [*batch.schema.names, "text"])
        give_back()

    return coded.select("id", "ids").mapInArrow(run, "id long, ids array<int>, text string")
