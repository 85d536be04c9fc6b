"""The substring operator on rows that share an id, against brute force, with large shards and with small ones."""

import random
import re

import pytest

from lectern.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")
rng = random.Random(7)


def some(n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


PASSAGE = some(70)
SAME = " ".join(some(12) + PASSAGE[3:] + some(9))
ROWS = [(0, " ".join(some(40) + PASSAGE[:60] + some(20))), (0, " ".join(PASSAGE[8:] + some(100))), (0, "short"), (1, SAME), (1, SAME), (1, SAME)]
ROWS += [(2, " ".join(some(300) + PASSAGE)), (2, " ".join(PASSAGE[1:] + some(2))), (2, None), (3, " ".join(some(1) + PASSAGE[:65])), (3, " ".join(PASSAGE)), (None, SAME)]


def brute(rows, width=50):
    words, first = [WORD.findall(t or "") for _, t in rows], {}
    for (i, _), w in zip(rows, words, strict=True):
        for j in range(len(w) - width + 1 if i is not None else 0):
            first[tuple(w[j : j + width])] = min(i, first.get(tuple(w[j : j + width]), i))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [False] * len(w)
        for j in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[j : j + width])] < i:
                gone[j : j + width] = [True] * width
        out.append((str(i), len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return sorted(out)


@pytest.mark.parametrize("most", [256, 2, 1])
def test_repeated_ids(spark, most):
    out = substring.remove_shared(spark.createDataFrame(ROWS, "doc_id long, text string"), shard=most).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, WORD.findall(r.text or "")) for r in out) == brute(ROWS)
