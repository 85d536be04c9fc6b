"""The near-duplicate stage of the pipeline against brute force over shingle sets."""

import random
import re

from corpus_pipeline import drop_near_copies
from lectern.llm import near

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(rows):
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    group[a] = min(group[a], group[b])
    return group


def planted():
    rng = random.Random(3)
    texts = [None, "", " \n", "one two", "One  two", "one three"]
    for n in (20, 60, 125, 400, 1632):
        words = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.05):  # single words changed, five shingles each
            copy = list(words)
            for i in rng.sample(range(n), max(1, int(share * n))):
                copy[i] = "other"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[: int(0.85 * n)]).upper())
    return list(enumerate(texts))


def test_near_copies_are_those_of_brute_force(spark):
    rows = planted()
    want = brute_groups(rows)
    assert 3 < len(set(want.values())) < len(rows) - 15  # copies are planted, and some are too far apart
    docs = spark.createDataFrame([*rows, (None, "one two")], "doc_id long, text string")
    assert {r.id: r.component_id for r in near.near_copies(docs).collect()} == want
    kept = [r.doc_id for r in drop_near_copies(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([None, *set(want.values())], key=str)
    assert near.near_copies(docs.limit(0)).count() == 0


def test_a_large_bucket_gives_pairs_in_proportion(spark):
    one = spark.range(2000).selectExpr("id AS sig", "1L AS key")
    pairs = near._pairs(one)
    assert 1900 < pairs.distinct().count() <= near.NEXT * 2000


def test_a_large_bucket_of_edited_copies_gives_its_links_and_few_other_pairs(spark):
    rng = random.Random(11)
    core, drawn = [rng.getrandbits(63) - (1 << 62) for _ in range(146)], {}
    for sig in range(400):  # windows of five around some words are gone; few of the texts share enough of them
        gone = {i + j for i in rng.sample(range(142), rng.randrange(3, 12)) for j in range(5)}
        drawn[sig] = frozenset(h if i not in gone else h + 1 for i, h in enumerate(core))
    for sig in range(400, 420):  # and some are a text of these but for a hash
        drawn[sig] = drawn[sig - 400] - {min(drawn[sig - 400])}
    links = {(a, b) for a in drawn for b in drawn if a < b and len(drawn[a] & drawn[b]) >= 0.8 * len(drawn[a] | drawn[b])}
    held = spark.createDataFrame([(s, list(h)) for s, h in drawn.items()], "sig long, hashes array<long>")
    members = spark.createDataFrame([(1, s, None, s) for s in drawn], "key long, sig long, fp long, component long")
    tried = spark.createDataFrame([], "a long, b long")
    found = {tuple(r) for r in near.others(members, near.shared_sizes(held), tried, 0.8).collect()}
    assert len(links) > 20 and links <= found
    assert len(found) < 2 * len(links) < len(drawn) * (len(drawn) - 1) / 8
