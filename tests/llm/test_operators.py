"""The operators against brute force on small tables with nulls, blanks, ties, repeats and extra columns."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lectern.llm import automaton, neighbours, pieces, pitman_yor, records, rollup, simhash, substring, templates, toxicity
from lectern.llm import licences as lic
from lectern.llm.common import new_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(1)
VOCABULARY = [f"w{i}" for i in range(400)]
PASSAGE = [rng.choice(VOCABULARY) for _ in range(70)]


def some(n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


TEXTS = [None, "", "  \n\t ", "one two", "A b c A b c", " ".join(some(200)), " ".join(some(30) + PASSAGE + some(40)), " ".join(some(5) + PASSAGE), " ".join(PASSAGE[5:] + some(10))]
TEXTS += [TEXTS[5], TEXTS[5] + " more", " ".join(some(3000)), "é\x0bx \x1cy", " ".join(PASSAGE * 3)]
ROWS = [(i, t, "x", i * 1.0) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, row string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, docs, empty):
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: fingerprint(t, 3) for i, t, *_ in ROWS}
    group = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = min(group[a], group[b])
    assert got == {i: (prints[i], group[i]) for i in prints}
    assert simhash.near_duplicates(empty).count() == 0


def test_chain_of_fingerprints_is_one_group(spark):
    fps = spark.createDataFrame([((1 << i) - 1,) for i in range(0, 40, 2)], "fp long")
    links = {(r.a, r.b) for r in simhash.links(fps).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in links) and len(links) == 19


def brute_removed(rows, width=50):
    words, first = {i: WORD.findall(t or "") for i, t in rows}, {}
    for i in sorted(words):
        for j in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][j : j + width]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        out[i] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


@pytest.mark.parametrize("most", [256, 2, 1])
def test_substring(spark, docs, empty, most):
    out = substring.remove_shared(docs, shard=most)
    assert out.columns == ["doc_id", "text", "row", "score", "n_words", "n_removed"]
    got = {r.doc_id: (r.n_words, r.n_removed, WORD.findall(r.text or "")) for r in out.collect()}
    assert got == brute_removed([r[:2] for r in ROWS])
    assert substring.remove_shared(empty).count() == 0


def test_automaton():
    strings = [[rng.choice("ab") for _ in range(rng.randrange(12))] for _ in range(6)]
    held = automaton.SuffixAutomaton()
    for s in strings:
        held.add(s)
    probe = [rng.choice("ab") for _ in range(40)]
    runs = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    assert held.matching(probe) == [max([0] + [k for k in range(1, i + 2) if tuple(probe[i + 1 - k : i + 1]) in runs]) for i in range(40)]


def test_records(spark, docs, empty):
    tokenizer = records.session_tokenizer(spark, "word_bpe_49k.json")
    from tokenizers import Tokenizer

    t, start, want = Tokenizer.from_file(tokenizer), 0, {}
    for i, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[i], start = (start, ids), start + len(ids)
    _, back, _ = records.token_files(docs, tokenizer)
    assert {r.id: (r.start, r.ids) for r in back.collect()} == want
    assert records.token_files(empty, tokenizer)[1].count() == 0
    framed = records.frame(b"payload")
    assert records.unframe(framed) == (b"payload", len(framed))
    for i in range(len(framed)):
        with pytest.raises(ValueError):
            records.unframe(framed[:i] + bytes([framed[i] ^ 1]) + framed[i + 1 :])


def test_pieces(spark, docs):
    model = records.session_tokenizer(spark, "piece_bpe_32k.model")
    odd = ["\0", "a\0b ▁", "  a  b", "\n\n x", "😀 é́", ",,, .a", "<s> <0x41>", *(t or "" for t in TEXTS)]
    plain, dropped = pieces.PieceCodec(model), pieces.PieceCodec(model, 0.3)
    for t in odd:
        if "\0" not in t and "▁" not in t:
            assert plain.encode(t) == plain.model.encode(t)
        for key in (0, 1):
            assert dropped.decode(dropped.encode(t, key)) == t
    keys = list(range(len(odd)))
    assert dropped.encode_many(odd, keys) == [dropped.encode_bytes(t, k) for t, k in zip(odd, keys, strict=True)]
    assert dropped.encode(TEXTS[5], 0) != dropped.encode(TEXTS[5], 1) != plain.encode(TEXTS[5])
    repeated = "wonderful segmentation " * 200
    cuts = [tuple(dropped.segment("▁segmentation", k)) for k in pieces._place_keys(np.full(400, 3, np.uint64), np.arange(400, dtype=np.uint64)).tolist()[1::2]]
    assert len(set(cuts)) > 10  # a word that repeats in a document is cut in varied ways
    assert dropped.decode(dropped.encode(repeated, 3)) == repeated
    back = pieces.decode(pieces.encode(docs.withColumn("ids", F.lit(1)), model, 0.1, 3), model)
    assert {r.id: r.text for r in back.collect()} == {i: t or "" for i, t, *_ in ROWS}
    assert pieces.encode(docs.limit(0), model).count() == 0
    again = spark.createDataFrame([(1, "one more"), (1, "one more"), (None, "one more"), (None, None)], "doc_id long, text string")
    got = [(r.id, tuple(r.ids)) for r in pieces.encode(again, model, 0.5, 3).collect()]
    assert got[0] == got[1] and got[3] == (None, ())


def test_templates(spark, empty):
    item = "Alice buys 12 apples for 3 dollars each and then sells 5 of them to her neighbour for twice the price she paid"
    other = item.replace("Alice", "Bertha").replace("12", "40").replace("3", "7")
    muddled = "Bob buys 12 apples for 12 dollars each and then sells 12 of them to her neighbour for twice the price she paid"
    rows = [(1, f"x y {item} z"), (2, other.replace(" ", "\n")), (3, muddled), (4, "nothing of it"), (5, None), (6, ""), (7, item.lower())]
    items = spark.createDataFrame([(9, item), (8, "too short"), (7, None)], "item_id long, text string")
    got = {(r.id, r.item): r.same_values for r in templates.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 9): True, (2, 9): False, (7, 9): True}
    assert templates.contaminated(empty, items).count() == 0


def test_toxicity(spark, empty):
    insult = ["idiot", "moron", "worthless"]
    rows = []
    for i in range(400):
        w = some(60)
        if i % 4 == 0:
            w[rng.randrange(60)] = insult[i % 3]
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.drop("text"), F.col("doc_id") % 5 != 0)
    assert {toxicity.START + w + toxicity.END for w in insult} <= set(model.landmarks)
    probe = [(1, "you idi.ot"), (2, "such a morron"), (3, "w1 w2 w3"), (4, ""), (5, None)]
    out = toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), model).collect()
    by = {r.doc_id: r.score for r in out}
    assert min(by[1], by[2]) > max(by[3], by[4], by[5]) and by[4] == by[5]
    held = toxicity.score(frame.where("doc_id % 5 = 0"), model).collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.95 * len(held)
    assert toxicity.fit(empty, frame.drop("text").limit(0), F.lit(True)).landmarks == []


def test_rollup(spark):
    keys = "source string, lang string, tokenizer string, n_tokens long"
    make = lambda *r: spark.createDataFrame(list(r), keys)
    store = rollup.Rollup(spark, new_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    assert store.commit("a", rollup.inserts(make(("s", "en", "v1", 5), ("s", None, "v1", 7), ("t", "en", "v1", None))))
    assert not store.commit("a", rollup.inserts(make(("s", "en", "v1", 500))))
    assert store.commit("b/1", rollup.deletes(make(("s", None, "v1", 7))))
    assert store.commit("c", rollup.revisions(make(("s", "en", "v1", 5)), make(("s", "de", "v1", 6))))
    want = {("s", "de", "v1", 1, 6), ("t", "en", "v1", 1, 0)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert not store.commit("c", rollup.inserts(make(("q", "q", "q", 1))))
    store.commit("d", rollup.inserts(make(("q", "q", "q", 1))))
    assert {tuple(r) for r in store.totals().collect()} == want | {("q", "q", "q", 1, 1)}


def test_licences(spark, empty):
    known = lic.known_digests(spark)
    full = lic.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 A. Person\n" + full.upper().replace("LICENSE", "LICENCE")), (2, full + " and more"), (3, "text\nreleased under the MIT licence!\n"), (4, None), (5, " . "), (None, full)]
    got = {tuple(r) for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert got == {(1, "text", "MIT"), (3, "line", "MIT")}
    assert lic.scan(empty, known).count() == 0


def test_neighbours(spark):
    x = np.random.default_rng(2).normal(size=(700, 16)).round(1).astype(float)
    x[300:500] = x[7]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(900, None), (1000, [0.0] * 16), (1100, [float("nan")] * 16), (1200, [None] * 16), (1300, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    assert sorted(got) == list(range(0, 700, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(700), d)) if i != q][:10]
        hits += len(set(want) & {f[1] for f in found})
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
    assert hits >= 0.9 * 70
    assert neighbours.nearest(frame.limit(0), F.lit(True)).count() == 0


def test_pitman_yor(spark, docs, empty):
    model = pitman_yor.train(docs.select("text"))
    counts = {}
    tokens = {i: [*WORD.findall((t or "").lower()), "\n"] for i, t, *_ in ROWS}
    for w in sum(tokens.values(), []):
        counts[w] = counts.get(w, 0) + 1
    assert (model.tokens, model.types) == (sum(counts.values()), len(counts))
    probs = model.words.collect()
    for ctx in (0, 5, 200):  # each context's probabilities of all words and the unknown one make 1
        total = sum(np.dot(model.mix[ctx], r.p0) + dict(zip(r.ctxs, r.own, strict=True)).get(ctx, 0) for r in probs)
        assert abs(total + np.dot(model.mix[ctx], model.unknown) - 1) < 1e-6
    for rare in (model.rare, 1 << 40):  # all by the head table, all by the join
        model.rare = rare
        if rare > 1 << 30:
            model.head = {"h": np.zeros(0, np.int64), "c": np.zeros(0, np.int64), "p0": np.zeros((0, pitman_yor.SAMPLES)), "own": np.zeros(0), "keys": np.zeros(0, np.int64), "place": np.zeros(0, np.int64), "table": np.zeros((0, 256))}
        out = {r.doc_id: r for r in pitman_yor.score(docs, model, [F.col("doc_id")]).collect()}
        for i, w in tokens.items():
            base = sum(np.log10((counts[x] + 1) / (model.tokens + model.types + 1)) for x in w)
            assert out[i].n_tokens == len(w) == out[i].n_known and abs(out[i].base_score - base) < 1e-6 * abs(base)
            assert out[i].score < 0
        if rare < 1 << 30:
            kept = {i: r.score for i, r in out.items()}
    assert all(abs(kept[i] - out[i].score) < 1e-3 for i in kept)
    none = pitman_yor.train(empty.select("text"))
    assert none.tokens == 0 and pitman_yor.score(docs, none, [F.col("doc_id")]).count() == len(ROWS)


def test_gibbs_moves_reach_the_posterior():
    """Tables of n customers of one dish, many chains: P(t) by the generalised Stirling numbers."""
    n, new, d, chains = 5, 0.7, 0.4, 20_000
    stirling = {1: {1: 1.0}}
    for i in range(1, n):
        stirling[i + 1] = {t: stirling[i].get(t - 1, 0) + (i - d * t) * stirling[i].get(t, 0) for t in range(1, i + 2)}
    want = np.array([stirling[n][t] * new ** (t - 1) for t in range(1, n + 1)])
    sizes, at = np.full(chains, n, np.int64), np.arange(chains + 1)
    steps, weight = np.full(chains, n), np.full(chains, new)
    for sweep in range(12):
        key = pitman_yor.mixed(np.arange(chains, dtype=np.uint64) + np.uint64(sweep << 32))
        sizes, at = pitman_yor.moved(sizes, at, steps, steps, weight, d, key)
    assert (np.add.reduceat(sizes, at[:-1]) == n).all()
    got = np.bincount(np.diff(at), minlength=n + 1)[1:] / chains
    assert np.abs(got - want / want.sum()).max() < 0.015
    sizes, at = pitman_yor.moved(sizes, at, np.full(chains, 3), np.full(chains, 40), weight, d, key)
    assert (np.add.reduceat(sizes, at[:-1]) == n + 37).all()


def test_pipeline_keeps_columns_and_clean_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[1:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    last = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest() == r.text_sha256 for r in last)
    assert all(r.n_pieces >= 0 for r in last)
