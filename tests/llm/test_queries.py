"""The registered queries and the pipeline over the smallest tables, against brute force where a rule is exact."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import neighbours, q_toxicity, records, templates, toxicity
from lectern.llm.queries import QUERIES

from .test_near_copies import brute_groups
from .test_operators import WORD, brute_removed, fingerprint

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def test_op1(spark, documents):
    rows = QUERIES["op1_toxicity"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    told = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [r for r in rows if told.get(r.doc_id) == 0]
    assert sum(r.predicted == 0 for r in clean) >= 0.9 * len(clean)


def test_op1_kernel_is_the_naive_one():
    """Likenesses against sums over all pairs of common subsequences."""
    from itertools import combinations

    def naive(s, t):
        total = 0.0
        for a in combinations(range(len(s)), toxicity.LETTERS):
            for b in combinations(range(len(t)), toxicity.LETTERS):
                if all(s[i] == t[j] and (s[i].isalnum() or s[i] in "\1\2") for i, j in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    mark = lambda w: toxicity.START + w + toxicity.END
    landmarks = [mark("loser"), toxicity.START + "scum"]
    for piece in ("loser", "loxxser", "l o s e r", "scums", "lo.ser"):
        got = toxicity.kernels([mark(piece)], landmarks)[0]
        for landmark, value in zip(landmarks, got, strict=True):
            joins = lambda w: {a + b for a, b in zip(w, w[1:], strict=False)}
            letters = re.sub("[ .]", "", mark(piece))
            own = naive(landmark if " " in piece else mark(piece), landmark if " " in piece else mark(piece))
            want = naive(mark(piece), landmark) / (own**toxicity.PART * naive(landmark, landmark) ** (1 - toxicity.PART))
            if len(joins(letters) & joins(landmark)) < len(joins(landmark)) / 2:
                want = 0
            assert value == pytest.approx(min(1, want) ** toxicity.SHARP, rel=1e-3), (piece, landmark)


def test_op1_gaps_and_insertions_on_a_trained_model(spark):
    sf = "/root/testdata/sf0.01"
    model = q_toxicity.model(spark, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), sf)
    probes = ["loser", "l.o.s.e.r", "l o s e r", "loxxser", "you mo ron", "id iot", "you are fine", "the sun is up", "", None]
    rows = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("Score", F.lit(2.0))
    out = toxicity.score(rows, model)
    assert out.columns == ["doc_id", "text", "a.b", "score", "predicted"]
    assert [r.predicted for r in sorted(out.collect())] == [1] * 6 + [0] * 4


def test_op2(spark, documents):
    rows = QUERIES["op2_token_rollup"](spark, SF).collect()
    assert sum(r.n_docs for r in rows if r.tokenizer == "words-1") == len({t or "" for t in documents.values()})


def test_op4(spark, documents):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(records.session_tokenizer(spark, "word_bpe_49k.json")), 0
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op4_token_files"](spark, SF).collect()}
    for i in sorted(documents):
        ids = np.array([*tokenizer.encode(documents[i] or "", add_special_tokens=False).ids, 1], "<u4")
        assert got.pop(i) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not got


def test_op5(spark, documents):
    want = {i: (n, gone, hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, gone, kept) in brute_removed(list(documents.items())).items()}
    assert sum(g for _, g, _ in want.values()) > 0
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op5_substring_dedup"](spark, SF).collect()} == want


def test_op6(spark, documents):
    got = {r.doc_id: r.text_sha256 for r in QUERIES["op6_merge_dropout"](spark, SF).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in documents.items()}


def test_op8(spark):
    rows = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    found, hits, asked = {}, 0, [i for i in rows if i % 100 == 0]
    for r in QUERIES["op8_projected_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == sorted(asked)
    for q in asked:
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len({v for _, v, _ in found[q]} & set(ids[order].tolist()))
        assert all(s == np.sqrt(((rows[v] - rows[q]) ** 2).sum()) for _, v, s in found[q])
    assert hits >= 0.9 * 10 * len(asked)


def test_op8_repeated_ids_and_many_cells(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELLS", (8, 8))
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 2)
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (7, x[11].tolist())]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.id)
    hits = sum(len({*got[q]} & {i for i in np.argsort(((x - x[q]) ** 2).sum(1))[:11].tolist() if i != q}) for q in range(0, 400, 20))
    assert hits >= 0.85 * 200 and len(got) == 20


def test_op9(spark, documents):
    rows = QUERIES["op9_pitman_yor"](spark, SF).collect()
    tokens = {i: [*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"] for i, t in documents.items()}
    counts = {}
    for i, ws in tokens.items():
        for w in ws if fold(i, 7) != 2 else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id, 7) == 2, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(np.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # a lower perplexity than the base's


def test_op10(spark, documents):
    prints = {i: fingerprint(t, 3) for i, t in documents.items()}
    group = {i: i for i in prints}
    for _ in range(3):
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", group[i]) for i in prints}


def test_op3_rich_in_placeholders(spark):
    item = "Alice 12 kg Bob 7 kg Carol 9 kg Dave 3 kg and Erin has 5 kg left over"
    other = item.replace("12", "40").replace(" 9", " 8").replace("Alice", "Zoe")
    muddled = other.replace("Bob", "Zoe")
    names = "Anna Bela Carl Dora Emil Fritz Gina Hans Ida Jon Kurt Lena Mia"
    items = spark.createDataFrame([(1, item), (2, names), (2, names), (None, item)], "item_id long, text string")
    texts = [item, f"before {other} after " + "filler words " * 20_000, muddled, "Rob Sam Tim Uwe Vera Will Xena Yan Zoe Abe Ben Cal Dan", names.lower(), "5 kg in all", None, ""]
    rows = [*enumerate(texts), (0, item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit("x")).withColumn("item", F.lit(5))
    got = {(r.id, r.item): r.same_values for r in templates.contaminated(docs, items).collect()}
    assert got == {(0, 1): True, (1, 1): False, (4, 2): True}


def test_pipeline_against_brute_force(spark, documents):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = {r.doc_id: r for r in pipeline.run(spark, SF).collect()}
    toxic = {r.doc_id for r in QUERIES["op1_toxicity"](spark, SF).where("predicted = 1").collect()}
    left = {i: t for i, t in documents.items() if i not in toxic}
    groups = brute_groups(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i] == i}
    cut = {i: kept for i, (_, _, kept) in brute_removed(list(left.items())).items()}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in cut.items()], "doc_id long, text string")
    leaks = {r.id for r in templates.contaminated(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert toxic and len(left) < len(documents) - len(toxic) and leaks
    assert set(rows) == set(left) - leaks
    whole = {i for i in rows if len(cut[i]) == len(WORD.findall(left[i] or ""))}
    assert whole and all(rows[i].text_sha256 == hashlib.sha256((left[i] or "").encode()).hexdigest() for i in whole)


def test_stages_keep_nulls_repeats_and_clashing_columns(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    odd = spark.createDataFrame([(None, None, None, None, None), (5_000_001, None, "en", "x", None), (5_000_002, "", "en", "x", 0), (5_000_002, "", "en", "x", 0)], base.schema)
    docs = base.unionByName(odd).withColumn("n_words", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("predicted", F.lit("p"))
    for name, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.where("doc_id is null").count() == 1 and stage(spark, docs.limit(0), SF).count() == 0, name
        assert out.where("predicted = 'p'").count() == out.count() > 3


def test_licence_texts(spark):
    from lectern.llm import licences as lic

    known = lic.known_digests(spark)
    whole = {k: t for k, t in lic.KNOWN if len(t) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(whole)
    rows = [(i, f"(c) 2020 A. Person\nAll rights reserved.\n{t.upper()}") for i, t in enumerate(whole.values())] + [(99, whole["MPL-2.0"] + " more"), (0, next(iter(whole.values())))]
    got = {(r.id, r.licence_id) for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).where("scope = 'text'").collect()}
    assert got == {(i, k) for i, k in enumerate(whole)}
    assert lic.scan(spark.createDataFrame(rows, "doc_id long, text string"), known).where("id = 0 and scope = 'text'").count() == 1
