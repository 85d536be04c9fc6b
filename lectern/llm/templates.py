"""Benchmark decontamination by template windows.

Numbers, names (capitalised words) and units become typed placeholders (units of at most three letters only
behind a number: "in" is mostly a word); other words count in lower case, without punctuation around them.  Windows of ``width`` such tokens are hashed, the corpus's
windows are hash-joined with the benchmark's, and the values that a document and an item have in
matched placeholders must correspond one to one over the whole aligned passage.  So an exact copy
matches, and so does the same question with other names and figures; chance matches of templates
with muddled values don't.  A window that is exact counts by itself: part of an item copied word for word is found
whatever values the rest of the passage has.

Both sides hold each window in three forms: with names; without (a capitalised word is a literal), for
documents in lower, upper or title case; and exact, with no placeholders.  A window may hold any number of
placeholders but needs a literal, and all matched windows of a passage together ``LITERALS`` of them
(half the tokens, if the item has few): runs of names or numbers alone are alike in any two texts.  An
exact window is all literals, so copies rich in numbers or names are found whatever they hold.

An item of under ``width`` tokens is one window of its own length; one of under 5 is exact only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, batched, sliced, window_hashes, written

WIDTH, SHORTEST, LITERALS = 13, 5, 4
#: Benchmark windows up to which their hashes and rows are broadcast (8 bytes each hash); beyond, the join shuffles.
BROADCAST_WINDOWS = 500_000
# Units of measure, as words and as abbreviations.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml l liter liters litre litres "
    "gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "percent % $ € £ usd eur dollar dollars euro euros cent cents degree degrees celsius fahrenheit mph kmh km/h m/s watt watts volt volts"
).split()
AROUND = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*_`"
NUMBER = r"^[+-]?[$€£]?[0-9]+([.,:/][0-9]+)*(%|[a-z]{1,3})?$"
SLOT = {"n": 1, "u": 2, "p": 3}
FORMS = NAMES, NO_NAMES, EXACT = 0, 1, 2


class Tokens:
    """The template tokens of a batch of texts: hashes and kinds (0: a literal) in each form, and values, punctuation alone left out."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        bare = pc.utf8_trim(words.uniq, characters=AROUND)
        self.values = pc.utf8_lower(bare)
        kind = np.zeros((len(FORMS), len(bare)), np.int8)
        kind[NAMES, pc.match_substring_regex(bare, r"^\p{Lu}[\p{L}'’-]+$").to_numpy(zero_copy_only=False)] = SLOT["p"]
        kind[:EXACT, pc.is_in(self.values, pa.array(UNITS)).to_numpy(zero_copy_only=False)] = SLOT["u"]
        kind[:EXACT, pc.match_substring_regex(self.values, NUMBER).to_numpy(zero_copy_only=False)] = SLOT["n"]
        digest = xxhash.xxh64_intdigest
        literal = np.fromiter((digest(w, 3) for w in self.values.to_pylist()), np.uint64, len(bare))
        hashes = np.where(kind > 0, kind.astype(np.uint64), literal)
        full = pc.not_equal(bare, "").to_numpy(zero_copy_only=False)[words.ids] if len(bare) else np.zeros(0, bool)
        self.ids = words.ids[full]
        self.offsets = np.concatenate(([0], np.cumsum(full)))[words.offsets]
        self.hashes, self.kinds = hashes[:, self.ids], kind[:, self.ids]
        if len(self.ids):
            after = np.concatenate(([False], self.kinds[NAMES, :-1] == SLOT["n"]))
            after[self.offsets[:-1][np.diff(self.offsets) > 0]] = False
            word = (pc.utf8_length(self.values).to_numpy() <= 3)[self.ids] & pc.match_substring_regex(self.values, "^[a-z/]+$").to_numpy(zero_copy_only=False)[self.ids]
            for form in (NAMES, NO_NAMES):
                plain = word & ~after & (self.kinds[form] == SLOT["u"])
                self.kinds[form, plain], self.hashes[form, plain] = 0, literal[self.ids[plain]]

    def windows(self, width: int, form: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place in the batch, hash) of every window of one text that holds a literal."""
        counts = np.diff(self.offsets)
        many = np.maximum(counts - width + 1, 0)
        text = np.repeat(np.arange(len(counts)), many)
        at = np.arange(many.sum()) + np.repeat(self.offsets[:-1] - (np.cumsum(many) - many), many)
        if form != EXACT and len(at):
            slots = np.concatenate(([0], np.cumsum(self.kinds[form] > 0)))
            rich = slots[at + width] - slots[at] < width
            at, text = at[rich], text[rich]
        return text, at, window_hashes(self.hashes[form], width)[at]

    def slots(self, at: int, width: int, form: int) -> list[str]:
        """Kind and value of each placeholder in a window, with its place there."""
        kinds = self.kinds[form]
        here = np.flatnonzero(kinds[at : at + width])
        return [f"{kinds[at + i]}:{self.values[self.ids[at + i]].as_py()}" for i in here.tolist()]

    def literals(self, at: int, width: int, form: int) -> list[int]:
        """Where the literals of a window are, from its start."""
        return np.flatnonzero(self.kinds[form][at : at + width] == 0).tolist()


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(hash, width, item, place, slots, literals, windows) for every window of every item; windows: how many the item has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, doc = [], batch.column(0).to_pylist()
            tokens = Tokens(batch.column(1))
            counts = np.diff(tokens.offsets)
            for form in FORMS:
                for w in sorted({min(int(c), width) for c in counts if c >= (1 if form == EXACT else SHORTEST)}):
                    for i, at, h in zip(*(x.tolist() for x in tokens.windows(w, form)), strict=True):
                        if min(counts[i], width) == w:
                            place = at - int(tokens.offsets[i])
                            literals = [place + k for k in tokens.literals(at, w, form)]
                            rows.append((h - (1 << 64) * (h >> 63), w, doc[i], place, tokens.slots(at, w, form), literals, int(counts[i]) - w + 1))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64())
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["hash", "width", "item", "place", "slots", "literals", "windows"]
            )

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "hash long, width int, item long, place long, slots array<string>, literals array<long>, windows long").distinct()


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, item, matched, windows, same_values): documents that hold windows of benchmark items.

    ``matched`` of the item's ``windows`` occur in one passage: all there, if its values are consistent, else the exact
    ones.  ``same_values``: all of these have the item's own values.  Rows with a null id take no part, null and empty texts have no windows, a
    repeated id counts as one document; an empty benchmark or corpus gives no rows.
    """
    spark = docs.sparkSession
    batched(spark)
    bench = written(benchmark_windows(items, width=width), "templates")
    small = bench.count() <= BROADCAST_WINDOWS
    widths = [r[0] for r in bench.select("width").distinct().collect()]  # at most width of them
    known = np.sort(np.array([r[0] for r in bench.select("hash").distinct().collect()], np.int64)) if small else None
    known = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = known.value
        for batch in sliced(batches):
            tokens, out = Tokens(batch.column(1)), []
            for w in widths:
                told = np.zeros((len(FORMS), len(tokens.ids)), np.int64)  # a window that is alike in two forms is given once
                for form in FORMS if w >= SHORTEST else (EXACT,):
                    text, at, h = tokens.windows(w, form)
                    h = h.view(np.int64)
                    new = (told[:form, at] != h).all(axis=0)
                    told[form, at] = h
                    if only is not None and len(only):
                        new[new] = only[np.minimum(np.searchsorted(only, h[new]), len(only) - 1)] == h[new]
                    text, at, h = text[new], at[new], h[new]
                    out += [(i, a - int(tokens.offsets[i]), x, w, tokens.slots(a, w, form)) for i, a, x in zip(text.tolist(), at.tolist(), h.tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(cols[0], pa.int64())),
                    pa.array(cols[1], pa.int64()),
                    pa.array(cols[2], pa.int64()),
                    pa.array(cols[3], pa.int32()),
                    pa.array(cols[4], pa.list_(pa.string())),
                ],
                ["id", "at", "hash", "width", "values"],
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(run, "id long, at long, hash long, width int, values array<string>")
    met = found.join(F.broadcast(bench) if small else bench, ["hash", "width"]).where(F.size("values") == F.size("slots"))
    exact = F.when(F.size("slots") == 0, F.col("place"))  # a window of literals alone is a copy, whatever the rest of its passage holds
    passage = met.groupBy("id", "item", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.expr("arrays_zip(slots, values)")))).alias("pairs"),
        F.count_distinct("place").alias("matched"),
        F.count_distinct(exact).alias("exact"),
        F.max("windows").alias("windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("literals")))).alias("literals"),
        F.max(F.least(F.lit(LITERALS), F.floor((F.col("width") + 1) / 2))).alias("needed"),
    )
    sides = [F.size(F.array_distinct(F.col("pairs")[k])) == F.size("pairs") for k in ("slots", "values")]
    passage = passage.withColumn("consistent", (F.col("literals") >= F.col("needed")) & sides[0] & sides[1])
    return passage.where("consistent or exact > 0").groupBy("id", "item").agg(
        F.max(F.when(F.col("consistent"), F.col("matched")).otherwise(F.col("exact"))).alias("matched"),
        F.max("windows").alias("windows"),
        F.max(~F.col("consistent") | F.forall("pairs", lambda p: p["slots"] == p["values"])).alias("same_values"),
    )
