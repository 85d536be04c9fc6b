"""Sentences, line joins, likeness, block merging and anchors against rows worked out by hand or by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import similarity
from lectern.functions.sentences import clean_text, cut_sentences, in_open_scope, join_lines, split_sentences
from lectern.plans import segments


@pytest.mark.parametrize(
    ("archetype", "text", "want"),
    [
        ("academic", "As Smith et al. Found this. See Fig. 2 for more [1]. The end is near.", ["As Smith et al. Found this.", "See Fig. 2 for more [1].", "The end is near."]),
        ("academic", "It holds (Smith, 2021). Others differ in this.", ["It holds (Smith, 2021).", "Others differ in this."]),
        ("generic", "It holds (Smith, 2021). Others differ in this.", ["It holds (Smith, 2021). Others differ in this."]),
        ("generic", "He said (see this. And that) was fine. Then he left.", ["He said (see this. And that) was fine.", "Then he left."]),
        ("generic", 'She said “Go. Now.” Then she left us.', ['She said “Go. Now.” Then she left us.']),
        ("generic", "Don't stop. It's the dogs' house. We know.", ["Don't stop.", "It's the dogs' house.", "We know."]),
        ("generic", "First part here. It needs this: Some scholars have said it is so. They left.", ["First part here.", "It needs this:", "Some scholars have said it is so.", "They left."]),
        ("generic", "Parts are the following: Some scholars have said it is so.", ["Parts are the following: Some scholars have said it is so."]),
        ("generic", "It rained all day. Ok.", ["It rained all day. Ok."]),  # a rest of under five signs stays
        ("generic", "no capital follows. here it goes on", ["no capital follows. here it goes on"]),
        ("generic", "...", []),
        ("generic", "", []),
        ("generic", "Costs rose. 5 of them fell. 그는 갔다. 그리고 왔다.", ["Costs rose.", "5 of them fell.", "그는 갔다.", "그리고 왔다."]),
    ],
)
def test_sentences(archetype, text, want):
    assert [s for s, _ in split_sentences(text, archetype)] == want


def test_sentence_types():
    assert split_sentences("Silence. Nobody moved at all.", "literary") == [("Silence.", "utterance"), ("Nobody moved at all.", "sentence")]
    assert split_sentences("Nobody moved at all. Three words here", "essay") == [("Nobody moved at all.", "sentence"), ("Three words here", "utterance")]
    assert split_sentences("Note this: The work has been done by them.", "essay") == [("Note this:", "utterance"), ("The work has been done by them.", "sentence")]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the cat sat on the mat and then it\nslept for hours", "the cat sat on the mat and then it slept for hours"),
        ("an exam-\nple of it", "an example of it"),
        ("see http://a.b/c-\nd now", "see http://a.b/c- d now"),
        ("- one\n- two", "- one\n- two"),
        ("Short line\nNext one starts", "Short line\nNext one starts"),
        ("It ends here.\nNext one", "It ends here.\nNext one"),
        ("a long line that goes on and on and on without any end\nof it\nand on", "a long line that goes on and on and on without any end of it\nand on"),
        ("one\n\n\ntwo\r\nthree", "one\n\ntwo\nthree"),
        ("", ""),
    ],
)
def test_line_joins(text, want):
    assert join_lines(text) == want


def test_clean_text():
    assert clean_text("<p>a&nbsp;b​c</p> é") == "a bc é"
    assert clean_text(None) == ""


def test_open_scopes():
    told = {"(a": True, "(a)": False, "a) b": False, '"a': True, "it's": False, "dogs' x": False, "‘a’": False, "‘a": True, "’a": True, "[a (b]": True, "“a” b": False}
    assert {t: in_open_scope(t) for t in told} == told


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_fuzzy(a, b):
    free, total = dict(enumerate(b)), 0.0
    for x in a:
        scores = {i: 1.0 if x == y else 1 - edits(x, y) / max(len(x), len(y)) if min(len(x), len(y)) > 2 else 0.0 for i, y in free.items()}
        best = max(scores.values(), default=0)
        if best > 0.7:
            del free[min(i for i, s in scores.items() if s == best)]
            total += best
    return total / max(len(a), len(b))


def brute_advanced(x, y):
    a, b = x.split(), y.split()
    t, c = 2 * lcs(a, b) / (len(a) + len(b)), 1 - edits(x, y) / max(len(x), len(y))
    j, f = len({*a} & {*b}) / len({*a} | {*b}), brute_fuzzy(a, b)
    mean = (len(x) + len(y)) / 2
    if mean < 20:
        return max(c * 0.4 + t * 0.3 + j * 0.2 + f * 0.1, c, t)
    return max(t * 0.4 + c * 0.3 + j * 0.2 + f * 0.1, t, c) if mean < 60 else max(t * 0.5 + j * 0.3 + c * 0.1 + f * 0.1, t)


def test_similarities(spark):
    rng = random.Random(4)
    words = ["river", "rivers", "stone", "stones", "a", "of", "lantern", "lanterns", "sky"]
    pairs = [(" ".join(rng.choices(words, k=rng.randrange(1, 14))), " ".join(rng.choices(words, k=rng.randrange(1, 14)))) for _ in range(60)]
    frame = spark.createDataFrame(pairs, "x string, y string")
    for measure, brute in ((similarity.fuzzy, lambda x, y: 1.0 if x == y else brute_fuzzy(x.split(), y.split())), (similarity.advanced, lambda x, y: 1.0 if x == y else brute_advanced(x, y)), (similarity.token_lcs, lambda x, y: 2 * lcs(x.split(), y.split()) / (len(x.split()) + len(y.split())))):
        got = frame.select(F.expr(measure("x", "y")).alias("s")).collect()
        assert [r.s for r in got] == pytest.approx([brute(x, y) for x, y in pairs]), measure.__name__
    empty = spark.createDataFrame([("", ""), ("a", ""), ("", "b"), ("same", "same")], "x string, y string")
    assert [r.s for r in empty.select(F.expr(similarity.advanced("x", "y")).alias("s")).collect()] == [0, 0, 0, 1]


def test_merged_blocks(spark):
    p, long = "paragraph", "This is a sentence of some length. " * 8
    cases = [
        ([(p, "Short one."), (p, "Another short one")], [(p, "Short one. Another short one")]),
        ([(p, "no mark here"), (p, "second part of it")], [(p, "no mark here. second part of it")]),
        ([(p, long), (p, long)], [(p, long), (p, long)]),
        ([("heading", "Some heading"), (p, "Text under it.")], [("heading", "Some heading"), (p, "Text under it.")]),
        ([(p, long), (p, "tiny tail text")], [(p, long + ". tiny tail text")]),
        ([(p, "x" * 790), (p, "y" * 20)], [(p, "x" * 790), (p, "y" * 20)]),
        ([("heading", "tiny")], []),
        ([], []),
    ]
    frame = spark.createDataFrame([(i, [{"kind": k, "content": c} for k, c in blocks]) for i, (blocks, _) in enumerate(cases)], "i int, bs array<struct<kind:string,content:string>>")
    got = {r.i: [tuple(b) for b in r.m] for r in frame.select("i", F.expr(segments.merged_blocks("bs")).alias("m")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def simulated(blocks, stored, light, least):
    """Anchors by the definition: block after block, every free sentence looked at."""
    matches, anchors = [], []
    for doc in sorted({b[0] for b in blocks}):
        all_ = sorted((i, t) for d, i, t in stored if d == doc)
        used, last = set(), None
        for block in sorted({b[1] for b in blocks if b[0] == doc}):
            mine = sorted((no, t) for d, b, no, t in blocks if (d, b) == (doc, block))
            found = []
            for no, t in mine:
                equal = [i for i, s in all_ if s == t and i not in used]
                scored = [(-light[t, s], i) for i, s in all_ if i not in used and light[t, s] >= least[t] and light[t, s] > 0]
                if equal:
                    found.append((doc, block, no, equal[0], "hash"))
                elif scored:
                    found.append((doc, block, no, min(scored)[1], "likeness"))
            if not found:
                for no, t in mine:
                    if scored := [(-light[t, s], i) for i, s in all_ if i not in used and light[t, s] >= 0.3]:
                        found.append((doc, block, no, min(scored)[1], "last resort"))
            matches += found
            ids = [f[3] for f in found]
            if ids and not used & set(range(min(ids), max(ids) + 1)):
                used |= set(range(min(ids), max(ids) + 1))
                last = [doc, block, min(ids), max(ids), len(ids), len(mine)]
                anchors.append(last)
        if last and all_[-1][0] > max(used):
            last[3], last[4] = all_[-1][0], all_[-1][0] - last[2] + 1
    return sorted(matches), sorted(map(tuple, anchors))


def test_anchors_equal_a_simulation(spark):
    """Documents whose blocks compete for sentences: equal ones, repeats, near ones, and blocks that only the last resort helps."""
    rng = random.Random(8)
    words = ["the", "the", "the", "river", "stone", "lantern", "sky", "valley", "of", "of", "morning", "boat"]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 9)))
    stored, blocks = [], []
    for doc in range(40):
        texts = [line() for _ in range(rng.randrange(3, 16))]
        stored += [(doc, 10 * doc + i, t if rng.random() < 0.8 else texts[0]) for i, t in enumerate(texts)]
        for block in range(rng.randrange(1, 8)):
            blocks += [(doc, block, no, rng.choice(texts) if rng.random() < 0.5 else line()) for no in range(rng.randrange(1, 4))]
    stored_df, blocks_df = spark.createDataFrame(stored, "doc_id long, id long, text string"), spark.createDataFrame(blocks, "doc_id long, block_no long, no long, text string")
    pairs = spark.createDataFrame(sorted({(b[3], s[2]) for b in blocks for s in stored if b[0] == s[0]}), "x string, y string")
    light = {(r.x, r.y): r.l for r in pairs.select("x", "y", F.expr(similarity.light("x", "y")).alias("l")).collect()}
    least = {r.x: r.t for r in pairs.select("x", F.expr(segments.threshold("x")).alias("t")).distinct().collect()}
    out = segments.anchoring(blocks_df, stored_df).collect()
    matches, anchors = simulated(blocks, stored, light, least)
    assert sorted((r.doc_id, r.block_no, r.no, r.id, r.how) for r in out if r.no is not None) == matches
    assert sorted((r.doc_id, r.block_no, r.start_id, r.end_id, r.matched, r.sentences) for r in out if r.no is None) == anchors
    assert {m[4] for m in matches} == {"hash", "likeness", "last resort"}
    odd = [(None, 1, 1, "x"), (1, None, 1, "y"), (99, 1, 1, "no such document"), (1, 1, 1, None)]
    assert segments.anchoring(spark.createDataFrame(odd, blocks_df.schema), stored_df.limit(0)).count() == 0
    assert segments.anchoring(blocks_df.limit(0), stored_df).count() == 0


def test_anchors_by_hand(spark):
    stored = [(1, 1, "The river runs slowly to the sea."), (1, 2, "Stones lie in the water."), (1, 3, "A lantern hangs above it."), (1, 4, "Nobody is there."), (2, 1, "The river runs slowly to the sea.")]
    blocks = [(1, 1, 1, "The River runs slowly to the sea"), (1, 1, 2, "Stones lie in cold water."), (1, 2, 1, "Stones lie in the water."), (1, 3, 1, "A lantern hangs above it."), (1, 4, 1, "Nothing alike")]
    out = segments.anchoring(spark.createDataFrame(blocks, "doc_id long, block_no long, no long, text string"), spark.createDataFrame(stored, "doc_id long, id long, text string")).collect()
    assert {(r.block_no, r.no): (r.id, r.how) for r in out if r.no is not None} == {(1, 1): (1, "hash"), (1, 2): (2, "likeness"), (3, 1): (3, "hash")}
    assert sorted((r.block_no, r.start_id, r.end_id, r.matched) for r in out if r.no is None) == [(1, 1, 2, 2), (3, 3, 4, 2)]


def test_candidates_share_more_than_a_common_word(spark, monkeypatch):
    """No two forms meet that share only the word that all have."""
    forms = [(1, f"the a{i} b{i} c{i} d{i} e{i}") for i in range(50)]
    theirs = spark.createDataFrame([(1, i, t) for i, (_, t) in enumerate(forms)], "doc_id long, key long, norm string")
    met = []
    monkeypatch.setattr(similarity, "light", lambda x, y: met.append(1) or "if(norm = theirs, 1e0, 0.5e0)")
    ours = spark.createDataFrame(forms, "doc_id long, norm string")
    assert segments.candidates(ours, theirs, 0.3).count() == 50 and met


def test_polite_forms(spark):
    rows = {r.sentence: (r.polite, r.plain) for r in segments_rows(spark, "STR11")}
    assert rows["연구입니다"] == (True, "연구이다") and rows["연구했습니다"] == (True, "연구했다") and rows["연구"] == (False, "연구")
    assert rows["연구; 그리고 — 끝났다"] == (False, "연구. 그리고 — 끝났다") and rows["연구하세요"] == (True, "연구한다")


def segments_rows(spark, name):
    from lectern.registry import QUERIES

    return QUERIES[name](spark, "/root/testdata/sf0.001").collect()


def test_broken_documents_reach_every_rule(spark):
    reasons = [r.reasons for r in segments_rows(spark, "FLT24")]
    assert all(any(name in r for r in reasons) for name in segments.BROKEN) and len(reasons) < 200


def test_sentence_queries_agree_with_the_splitter(spark):
    got = {}
    for r in segments_rows(spark, "SEG10"):
        got.setdefault(r.doc_id, []).append((r.paragraph_no, r.sentence_no, r.sentence))
    text = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for doc in (0, 1, 50, 199):
        assert [s for *_, s in sorted(got.get(doc, []))] == [s for s, _ in __import__("lectern.functions.sentences", fromlist=["x"]).cut_sentences(clean_text(text[doc]), "generic")]


def test_cutting_an_unclosed_bracket_is_linear():
    import time

    def took(k):
        text = "He said (and more. " + "This is a plain sentence of words. " * k
        start = time.perf_counter()
        assert len(cut_sentences(text, "generic")) == 1
        return time.perf_counter() - start

    took(100)
    assert min(took(8000) for _ in range(3)) < 30 * max(0.002, min(took(1000) for _ in range(3)))
