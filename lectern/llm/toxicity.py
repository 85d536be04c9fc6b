"""Toxicity by a support vector machine over a subsequence string kernel, with Nystrom landmarks.

The kernel of two strings counts their common subsequences of ``LETTERS`` letters, start and end among
them, each gap and each inserted character costing a factor ``DECAY``.  A piece's likeness to a landmark is their
kernel, scaled by the kernels of both with themselves (less by that of the piece, as more may stand around an
insult), to the power ``SHARP``.  Pieces of a sentence are its words, without marks around them but with those inside,
and the stretches of neighbouring short words with the gaps between them; signs that are neither letters nor digits
are gaps.  So "idi.ot", "iddxiot", "i d i o t" and "id iot" are all near "idiot".

Landmarks are words, or their first letters, that tell the labelled classes apart, taken by how sure that is
as long as the ones before leave a part of them unexplained (the residual of the Nystrom map), and the words of
the clean class that are most like those.  The Nystrom map makes the kernel a vector with one entry a
landmark, on which a linear SVM is trained: a document's label says that some sentence of it is toxic, by
some piece, so a toxic document is represented by its most suspicious piece and a clean one by its ``CLEAN_PIECES``
most suspicious ones, picked anew ``ROUNDS`` times with the weights found; each toxic landmark is also shown with gaps
and insertions.  A sentence is as toxic as its most suspicious piece, and a document as its worst sentence.

Fitting takes at most ``MOST_ROWS`` labelled documents of each class, those of least hashed id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, batched, columns_but, packed, sliced, written

LETTERS, DECAY, PART, SHARP = 4, 0.95, 0.15, 2
#: Labelled documents of each class, and candidate words of each class, that a fit takes at most.
MOST_ROWS, MOST_WORDS = 3000, 1000
CLEAN_PIECES, ROUNDS = 3, 3
#: The weight of all gapped forms, as a part of that of the toxic documents.
GAPPED = 0.5
#: Around every piece and whole-word landmark; a landmark of first letters has no end.
START, END = "\1", "\2"
#: How often chance may give a toxic landmark in a fit.
CHANCE = 0.05
#: The likeness to a toxic landmark that makes a clean word one too, and how many of them.
ALIKE, CONTRAST = 0.3, 64
#: The part of a candidate that the landmarks before it must leave unexplained.
RESIDUAL = 0.25
#: Words of at most this many letters are also compared across the gaps between them.
SHORT = 3
#: Pieces longer than this are compared in overlapping parts of this length, and count as their best part.
PIECE = 24
AROUND = ".,;:!?\"'()[]{}<>«»“”„‘’…-–—*_`#$%&|~^+=/\\"


def _codes(words: list[str], pad: int) -> np.ndarray:
    """[words, longest]: letters, digits, start and end as numbers; other signs are gaps, like what is behind the end."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), int(sizes.max())), pad, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    signs, at = np.unique(flat, return_inverse=True)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.where([chr(c).isalnum() or c in (1, 2) for c in signs], signs, pad)[at]
    return out


def _raw(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernels of the pairs ``s`` [n, any width] and ``t`` [n, width], characters as numbers, gaps of the two unlike."""
    n, width = t.shape
    gaps = np.triu(DECAY ** (np.arange(width)[None, :] - np.arange(width)[:, None]).clip(0)).astype(np.float32)
    prime = [np.ones((n, width + 1), np.float32)] + [np.zeros((n, width + 1), np.float32) for _ in range(LETTERS - 1)]
    total = np.zeros(n, np.float32)
    for a in range(s.shape[1]):
        match = (s[:, a, None] == t).astype(np.float32) * np.float32(DECAY * DECAY)
        total += (match * prime[-1][:, :-1]).sum(1)
        for i in range(LETTERS - 1, 0, -1):
            prime[i][:, 1:] = DECAY * prime[i][:, 1:] + (match * prime[i - 1][:, :-1]) @ gaps
    return total


def _neighbours(codes: np.ndarray) -> np.ndarray:
    """[words, width - 1]: each letter and the next one, gaps aside, as one number; negative where there is none."""
    close = np.take_along_axis(codes, np.argsort(codes < 0, axis=1, kind="stable"), axis=1).astype(np.int64)
    return np.where(close[:, 1:] < 0, -1, close[:, :-1] << 21 | close[:, 1:])


def kernels(pieces: list[str], landmarks: list[str]) -> np.ndarray:
    """[pieces, landmarks]: likenesses K(s, t) / (K(s, s)**PART K(t, t)**(1 - PART)), at most 1, to the power SHARP.

    A stretch of words is scaled by the landmark's kernel alone, as other words may stand around an insult.  A piece that holds less than half of a landmark's pairs of neighbouring letters, gaps aside, is not like it (0).
    """
    out = np.zeros((len(pieces), len(landmarks)), np.float32)
    t = _codes(landmarks, -2)
    own = _raw(np.where(t < 0, -1, t), t)
    joins = _neighbours(t)
    pairs = np.unique(joins[joins >= 0])
    holds = np.zeros((len(pairs), len(landmarks)), np.float32)
    row, col = np.nonzero(joins >= 0)
    holds[np.searchsorted(pairs, joins[row, col]), row] = 1
    needed = holds.sum(0) / 2
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(pieces):
        if len(w) > PIECE:
            out[i] = kernels([w[k : k + PIECE] for k in range(0, len(w) - PIECE // 2, PIECE // 2)], landmarks).max(0)
        elif len(w) >= LETTERS:
            by_length.setdefault(-(-len(w) // 4), []).append(i)
    for where in by_length.values():
        for k in range(0, len(where), 5000):
            part = np.array(where[k : k + 5000])
            s = _codes([pieces[i] for i in part.tolist()], -1)
            joins = _neighbours(s)
            at = np.minimum(np.searchsorted(pairs, joins), len(pairs) - 1)
            row, col = np.nonzero(pairs[at] == joins)
            has = np.zeros((len(part), len(pairs)), np.float32)
            has[row, at[row, col]] = 1
            row, mark = np.nonzero(has @ holds >= needed)
            if len(row):
                some, of = np.unique(row, return_inverse=True)
                norm = _raw(s[some], np.where(s[some] < 0, -2, s[some]))[of]
                spaced = np.array([" " in pieces[part[i]] for i in some.tolist()])[of]
                for m in range(0, len(row), 20_000):
                    r, c = row[m : m + 20_000], mark[m : m + 20_000]
                    n = np.where(spaced[m : m + 20_000], own[c], norm[m : m + 20_000])
                    out[part[r], c] = np.minimum(_raw(s[r], t[c]) / np.maximum(n**PART * own[c] ** (1 - PART), 1e-9), 1) ** SHARP
    return out


def pieces_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct pieces of a batch of texts in lower case, and of every piece met which it is and its text."""
    words = Words(texts)
    if not len(words.ids):
        return [], words.ids, words.ids
    coded = pc.utf8_trim(words.uniq, characters=AROUND).dictionary_encode()
    uniq, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)[words.ids]
    text = np.repeat(np.arange(len(words)), np.diff(words.offsets))
    short = np.fromiter((0 < len(w) <= SHORT and w.isalnum() for w in uniq), bool, len(uniq))[ids]
    ends = pc.match_substring_regex(words.uniq, r"[.!?]$").to_numpy(zero_copy_only=False)[words.ids]  # of a sentence
    single = np.fromiter((len(w) == 1 for w in uniq), bool, len(uniq))[ids]
    joins = short[1:] & short[:-1] & (text[1:] == text[:-1]) & (~ends[:-1] | single[:-1])
    edge = np.diff(np.concatenate(([0], joins.view(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    plain = [uniq[i] for i in ids.tolist()] if len(first) else []
    number: dict[str, int] = {}
    which = [number.setdefault(" ".join(plain[a:b]), len(number)) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    pieces = [START + w + END for w in [*uniq, *number]]
    return pieces, np.concatenate((ids, np.array(which, np.int64) + len(uniq))), np.concatenate((text, text[first]))


@dataclass
class Model:
    """Landmark words, a weight for each, and what turns a margin into a probability."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, pieces: list[str]) -> np.ndarray:
        parts = [kernels(pieces[i : i + 20_000], self.landmarks) @ self.weights for i in range(0, len(pieces), 20_000)] if self.landmarks else []
        return np.concatenate(parts) if parts else np.zeros(len(pieces))

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def _svm(x: np.ndarray, y: np.ndarray, u: np.ndarray, rounds: int = 1000, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM on rows of weights ``u``, classes weighted alike, by accelerated gradient steps."""
    share = u * np.where(y > 0, 0.5 / max(1e-9, u[y > 0].sum()), 0.5 / max(1e-9, u[y < 0].sum()))
    a = np.c_[x, np.ones(len(x))]
    step = 1 / (2 * np.linalg.eigvalsh((a * share[:, None]).T @ a)[-1] + penalty + 1e-12)
    w = v = np.zeros(a.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (a @ v))
        grad = -2 * a.T @ (share * slack * y) + penalty * v
        new = v - step * grad
        v, w = new + k / (k + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(m: np.ndarray, y: np.ndarray, u: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(toxic) = 1 / (1 + exp(-(slope * margin + shift))), by Newton steps."""
    a, p = np.c_[m, np.ones(len(m))], np.array([1.0, 0.0])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a @ p, -30, 30)))
        p = p + np.linalg.solve((a * (u * q * (1 - q))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (u * ((y > 0) - q)) - 1e-3 * p)
    return float(p[0]), float(p[1])


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Trains on labelled rows for which ``allowed`` (over the id) holds; rows without a label of 0 or 1 take no part.

    Without rows of both classes the model has no landmarks and scores everything alike.
    """
    spark = docs.sparkSession
    batched(spark)
    told = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("label")).where(allowed)
    order = F.xxhash64(F.col(id_col).cast("string"))
    some = [told.where(F.col("label") == k).orderBy(order, id_col).limit(MOST_ROWS) for k in (0, 1)]
    picked = some[0].unionByName(some[1])
    texts = docs.select(id_col, text_col).join(picked, id_col).select("label", F.lower(text_col).alias("text"))
    # near copies share their long words, so they share the least hash of one (given a few): of those a single text counts
    long_words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= 8)
    texts = texts.withColumn("copy", F.when(F.size(long_words) >= 5, F.array_min(F.transform(long_words, lambda w: F.xxhash64(w)))).otherwise(F.xxhash64("text")))
    texts = texts.groupBy("label", "copy").agg(F.min("text").alias("text")).select("label", "text")
    sample = written(texts.repartition(spark.sparkContext.defaultParallelism), "sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        return Model([], np.zeros(0), 0.0, 0.0, 0.0 if not classes.get(1) else 1e-9)
    # a word counts once a document, and so does each of its beginnings
    told_words = F.filter(F.array_distinct(F.split("text", r"[^\p{L}]+")), lambda w: F.length(w).between(LETTERS, PIECE - 2))
    stems = F.flatten(F.transform(told_words, lambda w: F.array(*(F.concat(F.lit(START), F.substring(w, 1, k)) for k in range(LETTERS, 9)))))
    whole = F.transform(told_words, lambda w: F.concat(F.lit(START), w, F.lit(END)))
    counts = sample.select("label", F.explode(F.array_distinct(F.concat(whole, stems))).alias("w")).groupBy("w").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
    both, shared = classes[0] + classes[1], (F.col("p") + F.col("n")) / (classes[0] + classes[1])
    z = (F.col("p") / classes[1] - F.col("n") / classes[0]) / F.sqrt((shared * (1 - shared) + 1 / both**2) * (1 / classes[0] + 1 / classes[1]))
    tested = written(counts.where("p + n > 1").select("w", "p", "n", z.alias("z")), "tested")
    ranked = tested.orderBy(F.desc("z"), F.desc(F.length("w")), "w").limit(MOST_WORDS).collect()
    many, share = tested.count(), classes[1] / both
    sure = {r["w"] for r in ranked if r["z"] > 0 and _tail(r["p"], r["p"] + r["n"], share) * many < CHANCE}
    suspects = [r["w"] for r in ranked if r["w"] in sure] or [r["w"] for r in ranked[:8]]
    suspects = _unlike([w for i, w in enumerate(suspects) if not any(w.startswith(k) or k.startswith(w) for k in suspects[:i])], 0)
    alike = tested.where(F.col("w").endswith(END) & (F.col("n") > 0))
    alike = alike.where(F.substring("w", 1, LETTERS).isin(sorted({w[:LETTERS] for w in suspects}))).orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()
    clean = [r["w"] for r in alike if r["w"] not in sure]
    if clean:
        like = kernels(clean, suspects).max(1)
        clean = [clean[i] for i in np.argsort(-like, kind="stable").tolist() if like[i] >= ALIKE]
    landmarks = _unlike(suspects + clean, len(suspects))[: len(suspects) + CONTRAST]

    inner = kernels(landmarks, landmarks).astype(float)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T

    def witnesses(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every sampled document the features of its most suspicious pieces by these weights."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pieces, which, text = pieces_of(batch.column(1))
                label = batch.column(0).to_numpy()
                x, of = np.zeros((batch.num_rows, len(landmarks))), np.arange(batch.num_rows)
                if pieces:
                    features = kernels(pieces, landmarks)
                    pairs = np.unique(np.stack((text, which)), axis=1)
                    text, which = pairs[:, np.lexsort((pairs[1], -(features @ weights)[pairs[1]], pairs[0]))]
                    place = np.arange(len(text)) - np.searchsorted(text, text)
                    some = place < np.where(label[text] > 0, 1, CLEAN_PIECES)
                    x, of = features[which[some]].astype(float), text[some]
                yield pa.RecordBatch.from_arrays([pa.array(label[of]), pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

        rows = sample.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, x array<double>").collect()  # 4 * MOST_ROWS at most
        return np.array([r["x"] for r in rows]), np.array([2 * r["label"] - 1 for r in rows])

    told_apart = kernels([START + g + END for w in suspects for g in gapped_forms(w.strip(START + END))], landmarks).astype(float)
    weights = np.array([1.0] * len(suspects) + [-0.5] * (len(landmarks) - len(suspects)))
    for _ in range(ROUNDS):
        x, y = witnesses(weights)
        x, y = np.r_[x, told_apart], np.r_[y, np.ones(len(told_apart), int)]
        u = np.where(y > 0, 1.0, 1 / CLEAN_PIECES)
        u[len(y) - len(told_apart) :] = GAPPED * classes[1] / max(1, len(told_apart))
        w, bias = _svm(x @ whiten, y, u)
        weights = whiten @ w
    slope, shift = _logistic(x @ weights + bias, y, u)
    every = {r["label"]: r["count"] for r in told.groupBy("label").count().collect()}
    shift += log(every[1] / every[0] / (classes[1] / classes[0]))  # the sample may hold more of the rarer class
    return Model(landmarks, weights, bias, slope, shift)


def _tail(p: int, n: int, share: float) -> float:
    """P(at least ``p`` of ``n`` documents are toxic), if each is with probability ``share``."""
    logs = [lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log1p(-share) for k in range(p, n + 1)]
    return sum(exp(x) for x in logs)


def gapped_forms(word: str) -> list[str]:
    """A word with gaps and insertions: every letter apart, marks between letters, one and two signs inserted."""
    half = len(word) // 2
    return [" ".join(word), ".".join(word), f"{word[:half]}xx{word[half:]}", f"{word[:half]} {word[half:]}", f"{word[:-1]}*{word[-1:]}"]


def _unlike(words: list[str], given: int) -> list[str]:
    """Of ``words``, best first, the ``given`` first and those that the ones kept before leave unexplained: the residual of a pivoted Cholesky factor."""
    if not words:
        return []
    inner = kernels(words, words).astype(float)
    inner = np.minimum((inner + inner.T) / 2, 1)
    left, factor, kept = np.diag(inner).copy(), np.zeros((len(words), 0)), []
    for i, word in enumerate(words):
        if i < given or left[i] > RESIDUAL:
            column = (inner[:, i] - factor @ factor[i]) / np.sqrt(max(left[i], 1e-6))
            factor, left = np.c_[factor, column], left - column**2
            kept.append(word)
    return kept


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every row keeps all its columns; a ``score`` or ``predicted`` it has already, in any case, is replaced.  A
    null, empty or blank text has no piece and gets the score of a piece without any likeness; repeated rows
    are scored alike.
    """
    batched(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes: MOST_WORDS words and weights at most
    rest = columns_but(docs, "score", "predicted")
    inner = docs.select(F.struct(*packed(rest)).alias("row"), F.lower(packed([text_col])[0].cast("string")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = shared.value, {}
        for batch in sliced(batches):
            pieces, which, text = pieces_of(batch.column(1))
            if len(memo) > 200_000:
                memo.clear()
            new = [w for w in pieces if w not in memo]
            memo.update(zip(new, model.values(new).tolist(), strict=True))
            margins = np.full(batch.num_rows, 0.0)  # a piece that is like no landmark
            np.maximum.at(margins, text, np.fromiter((memo[w] for w in pieces), float, len(pieces))[which])
            margins += model.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(margins))], ["row", "score"])

    out = inner.mapInArrow(run, inner.select("row").schema.add("score", "double"))
    return out.select(*(F.col("row")[c].alias(c) for c in rest), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
