"""Importance resampling, the filter audit and rank-array BPE against brute force and the tokenizers library."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import audit, bpe, q_audit, resample
from lectern.llm.queries import QUERIES
from lectern.llm.records import session_tokenizer

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute_draw(texts, targets):
    """{id: (n_features, weight, score, rank)}"""
    rows = {i: plain_features(t) for i, t in texts.items()}
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, f in rows.values():
        np.add.at(s, f, 1)
    for x in targets:
        np.add.at(t, plain_features(x)[1], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = {}
    for i, (n, f) in rows.items():
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        out[i] = [len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n]
    may = sorted((-v[2], i) for i, v in out.items() if v[3] >= 20)
    ranks = {i: k + 1 for k, (_, i) in enumerate(may[: 5 * len(may) // 100])}
    return {i: (*v[:3], ranks.get(i)) for i, v in out.items()}


def test_op11(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    targets = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute_draw(texts, targets)
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op11_importance_draw"](spark, SF).collect()}
    assert got == want and sum(v[3] is not None for v in want.values()) > 3


def test_features_of_a_batch_stay_in_their_documents(monkeypatch):
    rng = random.Random(4)
    alphabet = "aZ09 \t.-\x00\x7fé日ß'"
    texts = ["", "one", " ", "x\x00y", "a" * 300 + " b " + "é" * 100 + " c", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300))]
    monkeypatch.setattr(resample, "JOINED", 200)
    seen, n = [[] for _ in texts], []
    for first, held in resample._groups(pa.array(texts)):
        bucket, doc, words = resample.features(held)
        n += words.tolist()
        for b, d in zip(bucket.tolist(), doc.tolist(), strict=True):
            seen[first + d].append(b)
    for t, f, k in zip(texts, seen, n, strict=True):
        words, want = plain_features(t)
        assert (k, sorted(f)) == (words, sorted(want)), t


def test_draw_over_odd_rows(spark):
    """Nulls, blanks, ties, repeated rows, clashing columns, more ranges than rows, and an empty table."""
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(i, words + f" t{i % 7}", "x") for i in range(120)] + [(3, words + " t3", "x"), (500, None, None), (501, "", "x"), (None, words, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, weight string").withColumn("n.words", F.lit(1))
    gain = resample.gains(resample.bucket_counts(docs), resample.bucket_counts(docs.limit(1)))
    out = resample.draw(resample.weights(docs, gain), percent=5, least_words=20).collect()
    assert len(out) == len(rows) and sorted(r["rank"] for r in out if r["rank"]) == list(range(1, 122 * 5 // 100 + 1))
    drawn = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [(-r.score, r.id) for r in drawn] == sorted((-r.score, r.id) for r in drawn)
    assert min(r.score for r in drawn) >= max(r.score for r in out if r.n_words >= 20 and not r["rank"] and r.id is not None)
    assert {(r.id, r.n_features, r.weight) for r in out if r.n_words == 0} == {(500, 0, 0), (501, 0, 0)}
    empty = docs.limit(0)
    assert resample.bucket_counts(empty).count() == 0 and resample.draw(resample.weights(empty, gain), 5, 20).count() == 0


def brute_audit(docs, labels):
    """{(part, order, step): (kept, removed, redundant, unique, good, toxic)} by walking every order."""
    told = {i: (q == 1, t == 1) for i, q, t in labels}
    first = {}
    for i, t, _ in docs:
        first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i > first[t]
        rows.append((lang or "", "".join(c for c, x in zip("ABCDE", tests, strict=True) if x), *told.get(i, (False, False))))
    out = {}
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                fails = [r for r in rows if r[0] == part and f in r[1]]
                out[part, order, step] = len(left), len(gone), len(fails) - len(gone), sum(r[1] == f for r in fails), sum(r[2] for r in gone), sum(r[3] for r in gone)
    return out


def test_audit_by_brute_force_and_sql(spark):
    rng = random.Random(9)
    texts = ["", "A B $", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i}" for i in range(120)), "x " * 150, "É ÀÉ\x1cq", "AB|" * 200]
    docs = [(i, rng.choice([*texts, None]), rng.choice(["en", "de", None, ""])) for i in range(200)]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 260, 3)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("m")).withColumn("id", F.lit(1))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("x"))
    report = audit.audit(frame, told).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for r in report}
    assert got == brute_audit(docs, labels) and len(report) == 3 * 600
    for r in report[::97]:
        assert r.shapley == sum(x.removed for x in report if x.part == r.part and x.filter_order[x.step - 1] == r.filter_order[r.step - 1])
    con = duckdb.connect()
    for name, df in (("documents", frame), ("labels", told)):
        con.register(name, df.toPandas())
    assert {tuple(r) for r in con.sql(q_audit.SQL).fetchall()} == {tuple(r) for r in report}
    assert audit.audit(frame.limit(0), told.limit(0)).count() == 0


def test_audit_of_repeated_and_null_ids(spark):
    rows = [(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (None, "a", "x"), (None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame([(1, 0, 1), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    (r,) = audit.audit(frame, told).where("part = 'x' and filter_order = 'EABCD' and step = 1").collect()
    assert (r.kept, r.removed, r.good_lost) == (2, 2, 0)
    (r,) = audit.audit(frame, told).where("part = 'x' and filter_order = 'AEBCD' and step = 1").collect()
    assert (r.removed, r.good_lost, r.toxic_lost) == (4, 2, 2)


def test_removal_steps_are_the_first_failing_filters():
    rng = np.random.default_rng(1)
    failed, orders = rng.random((40, 5)) < 0.4, np.array(list(itertools.permutations(range(5))))
    steps = audit.removal_steps(failed, orders)
    for d in range(40):
        for o, order in enumerate(orders):
            assert steps[d, o] == next((k + 1 for k, f in enumerate(order) if failed[d, f]), np.inf)


@pytest.fixture(scope="module")
def library(spark):
    path = session_tokenizer(spark, "word_bpe_49k.json")
    return bpe.RankEncoder(path), bpe.Decoder(path), Tokenizer.from_file(path)


def same(own, library, texts):
    ids, starts = own.encode(pa.array(texts))
    wanted = library.encode_batch(texts, add_special_tokens=False)
    return [ids[a:b].tolist() == w.ids for a, b, w in zip(starts[:-1], starts[1:], wanted, strict=True)]


def test_op13(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {}
    for i, t in texts.items():
        ids = library[2].encode(t, add_special_tokens=False).ids
        back = library[2].decode(ids, skip_special_tokens=False)
        want[i] = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op13_rank_array_bpe"](spark, SF).collect()} == want


def test_every_assigned_sign_is_encoded_as_the_library_does(library):
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    for i in range(0, len(signs), 20_000):
        assert all(same(library[0], library[2], [f"a{c}b {c}{c}'s" for c in signs[i : i + 20_000]]))


def test_words_of_every_length_and_added_tokens(library):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeinghtés") for _ in range(rng.randint(1, 90))) for _ in range(400)] + ["in" * 3000, "=" * 500]
    odd = ["<|endoftext|>a<|startoftext|>", "A<|ENDOFTEXT|>x", "ΟΔΟΣ ΣΣ İI", "é <|endoftext|>́x", "\x1c\x1fa", "don't DON'T 'LL", " a b", ""]
    assert all(same(library[0], library[2], words + odd))
    for w in words[:50]:
        assert library[0].long(w.encode()) == library[0].short([w.encode()], 256)[0]
    for text in odd:
        ids = library[2].encode(text, add_special_tokens=False).ids
        assert library[1].decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [library[2].decode(ids, skip_special_tokens=False)]


def test_bpe_of_odd_rows(spark, library):
    path = session_tokenizer(spark, "word_bpe_49k.json")
    rows = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "Hi there")], "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("id", F.lit("a"))
    got = [(r.id, r.ids, r.text) for r in bpe.decode(bpe.encode(rows, path), path).collect()]
    assert sorted(got, key=str) == sorted([(None, [], ""), (1, [], ""), (1, [], ""), (2, library[2].encode("hi there").ids, "hi</w> there</w>")], key=str)
    assert bpe.encode(rows.limit(0), path).count() == 0
    lists = spark.createDataFrame([(1, None), (2, [-1, 320, 10**6]), (3, [])], "id long, ids array<int>")
    assert [r.text for r in sorted(bpe.decode(lists, path).collect())] == ["", library[2].decode([320], skip_special_tokens=False), ""]
