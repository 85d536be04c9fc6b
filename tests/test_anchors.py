"""ANC1 and JN26: what is alike is found inside a document, and its texts are dealt once."""

import random

from pyspark.sql import functions as F

from lectern.functions.anchors import LAST_RESORT, Alike, Anchoring
from lectern.plans import segments

WORDS = ["the", "the", "the", "river", "stone", "lantern", "sky", "valley", "of", "of", "morning", "boat"]


def shuffled(spark) -> int:
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    each, n = spark._jsc.sc().statusStore().executorList(False).iterator(), 0
    while each.hasNext():
        n += each.next().totalShuffleWrite()
    return n


def test_texts_are_dealt_once(spark):
    """A document of sentences that share rare words with many others: no more goes to disk than its sentences, whatever number of pairs is alike."""
    rng = random.Random(3)
    names = ["".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(2000)]
    stored = [(1, i, " ".join([*rng.choices(names, k=12), *(f"group{i % 4}", f"part{i % 3}", f"side{i % 5}")])) for i in range(400)]
    blocks = [(1, i // 5, i, " ".join(["changed", *t.split()[4:]])) for _, i, t in stored]
    texts = sum(len(t) for *_, t in stored) + sum(len(t) for *_, t in blocks)
    before = shuffled(spark)
    out = segments.anchoring(spark.createDataFrame(blocks, "doc_id long, block_no long, no long, text string"), spark.createDataFrame(stored, "doc_id long, id long, text string")).collect()
    assert sum(r.no is not None for r in out) == 400
    assert shuffled(spark) - before < 2 * texts


def test_alike_as_the_join(spark):
    """Candidates and likenesses of a form are those of the join in SQL; forms without a free id are left out."""
    rng = random.Random(5)
    forms = sorted({" ".join(rng.choices(WORDS, k=rng.randrange(0, 9))) for _ in range(120)})
    theirs, ours = forms[:60], sorted({*forms[40:], ""})
    joined = segments.candidates(
        spark.createDataFrame([(1, f) for f in ours], "doc_id long, norm string"), spark.createDataFrame([(1, i, f) for i, f in enumerate(theirs)], "doc_id long, key long, norm string"), LAST_RESORT
    ).select("norm", "key", F.col("likeness")).collect()
    alike = Alike(theirs)
    for least in (LAST_RESORT, 0.5, 0.7):
        got = {(f, k): x for f in ours for x, k in alike.to(f, least, [False] * len(theirs))}
        assert got == {(r.norm, r.key): r.likeness for r in joined if r.likeness >= least}
    gone = [k % 2 == 0 for k in range(len(theirs))]
    assert {k for f in ours for _, k in alike.to(f, LAST_RESORT, gone)} == {r.key for r in joined if r.key % 2}


def test_only_what_has_no_equal_is_compared():
    state = Anchoring({"a river runs": [1], "stones lie": [2, 3], "a river ran": [4]})
    assert state.block([(1, "a river runs", 0.5), (2, "stones lie", 0.5)]) == ([(1, 1, "hash", 1.0), (2, 2, "hash", 1.0)], (1, 2))
    assert state.alike is None
    assert state.block([(1, "a river runs", 0.3)])[0][0][1:3] == (4, "likeness")
