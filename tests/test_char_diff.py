"""Character differences against a dynamic programme and by hand."""

import random
import time

from lectern.functions import char_diff
from lectern.functions.char_diff import CUT, KEEP, PUT, readable, script


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1], row[j]) + 1 if x != y else row[j - 1])
        row = new
    return row[-1]


def sides(ops):
    return "".join(t for o, t in ops if o != PUT), "".join(t for o, t in ops if o != CUT)


def test_scripts_are_shortest_and_lossless():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice(["ab", "abc", "abcdefgh "])
        a, b = ("".join(rng.choice(letters) for _ in range(rng.randrange(25))) for _ in "ab")
        ops = script(a, b)
        assert sides(ops) == (a, b) and sum(len(t) for o, t in ops if o != KEEP) == distance(a, b), (a, b, ops)
        assert all(t for _, t in ops) and all(x[0] != y[0] for x, y in zip(ops, ops[1:], strict=False))
        clean = readable(ops)
        assert sides(clean) == (a, b), (a, b, clean)


def test_long_texts_that_are_alike():
    a = "The river runs slowly to the sea. " * 3000
    b = a[:50_000] + "and " + a[50_020:]
    ops = script(a, b)
    assert sides(ops) == (a, b) and sum(len(t) for o, t in ops if o != KEEP) <= 24


def test_clean_up_by_hand():
    told = lambda a, b: readable(script(a, b))
    assert told("same", "same") == [(KEEP, "same")] and told("", "") == [] and told("a", "") == [(CUT, "a")] and told("", "b") == [(PUT, "b")]
    assert told("mouse", "sofas") == [(CUT, "mouse"), (PUT, "sofas")]
    assert told("The cat sat", "The big cat sat") == [(KEEP, "The "), (PUT, "big "), (KEEP, "cat sat")]
    assert told("The xaxcxd.", "The zaycwd.") == [(KEEP, "The "), (CUT, "xaxcx"), (PUT, "zaycw"), (KEEP, "d.")]
    assert readable([(CUT, "abcxxx"), (PUT, "xxxdef")]) == [(CUT, "abc"), (KEEP, "xxx"), (PUT, "def")]
    assert readable([(CUT, "xxxabc"), (PUT, "defxxx")]) == [(PUT, "def"), (KEEP, "xxx"), (CUT, "abc")]
    assert readable([(CUT, "ab"), (PUT, "cd"), (KEEP, "12"), (CUT, "e")]) == [(CUT, "ab"), (PUT, "cd"), (KEEP, "12"), (CUT, "e")]
    assert readable([(CUT, "abc"), (KEEP, "b"), (CUT, "xy")]) == [(CUT, "abcbxy"), (PUT, "b")]
    assert told("one two three", "one too three") == [(KEEP, "one t"), (CUT, "w"), (PUT, "o"), (KEEP, "o three")]


def test_all_diagonals_at_once_give_the_same_script(monkeypatch):
    """STR18: beyond a number of steps the search takes a step's diagonals together, so that a long sentence in capitals ends; nothing else changes."""
    rng = random.Random(11)
    for _ in range(200):
        a = "".join(rng.choice("abcd EF") for _ in range(rng.randrange(120)))
        b = a[: len(a) // 2].upper() + a[len(a) // 2 + rng.randrange(4) :]
        monkeypatch.setattr(char_diff, "FEW", 1000)
        one = script(a, b)
        monkeypatch.setattr(char_diff, "FEW", rng.randrange(1, 9))
        assert script(a, b) == one
    monkeypatch.undo()
    a = "The river Runs slowly to the Sea, " * 150
    began = time.monotonic()
    ops = readable(script(a, a.upper()))
    assert sides(ops) == (a, a.upper()) and time.monotonic() - began < 15


def test_one_way_alone_is_no_search(monkeypatch):
    """STR18: where what both texts have can be kept in one way alone, the script is told without a search, and is that of the search."""
    rng = random.Random(12)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abcd, EF") for _ in range(rng.randrange(60)))
        pairs += [(a, a.upper()), (a, "".join(rng.choice("bcdxy, E") for _ in range(rng.randrange(60)))), (a, a[: len(a) // 3] + a[len(a) // 2 :].upper())]
    told = [script(a, b) for a, b in pairs]
    monkeypatch.setattr(char_diff, "_only_way", lambda x, y: None)
    assert [script(a, b) for a, b in pairs] == told
    monkeypatch.undo()
    long = "Orre " * 3_000 + "orantion thatin, " * 10_000  # a capital that more words of the answer have
    monkeypatch.setattr(char_diff, "_middle", None)  # not called
    ops = script(long, long.upper())
    assert sides(ops) == (long, long.upper()) and sum(len(t) for op, t in ops if op == 0) == sum(not c.islower() for c in long)
