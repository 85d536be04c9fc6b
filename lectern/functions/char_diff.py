"""The difference of two texts by characters: a shortest edit script, cleaned up so that a reader sees whole words.

``script`` finds a shortest one by the greedy search from both ends that meets in the middle (time by length and
distance, space by length), so texts may be long where they are alike, or where each has signs that the other lacks and the rest can be kept in one way alone.
"""

from __future__ import annotations

import re

import numpy as np

KEEP, CUT, PUT = 0, -1, 1
#: From so many steps on a search takes all diagonals of a step at once.
FEW = 200
Ops = list[tuple[int, str]]


def _middle(a: str, b: str) -> tuple[int, int] | None:
    """A place on a shortest path from both starts to both ends, about half way; None if the texts share nothing."""
    n, m = len(a), len(b)
    most, delta = (n + m + 1) // 2, n - m
    zero = min(most, FEW) + 2  # the place of diagonal 0; what isn't reached is -1
    ahead, back = [-1] * (2 * zero + 1), [-1] * (2 * zero + 1)
    ahead[zero + 1] = back[zero + 1] = 0
    odd = delta % 2
    for d in range(most + 1):
        if d == FEW:
            return _far_middle(a, b, ahead, back)
        first, last = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)  # no further than the texts go
        for k in range(first, last + 1, 2):
            above, below = ahead[zero + k + 1], ahead[zero + k - 1]
            x = above if k == -d or (k != d and below < above) else below + 1
            y = x - k
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            ahead[zero + k] = x
            if odd and -d < delta - k < d and x + back[zero + delta - k] >= n:
                return x, y
        for k in range(first, last + 1, 2):
            above, below = back[zero + k + 1], back[zero + k - 1]
            x = above if k == -d or (k != d and below < above) else below + 1
            y = x - k
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            back[zero + k] = x
            if not odd and -d <= delta - k <= d and x + ahead[zero + delta - k] >= n:
                return n - x, m - y
    return None


def _far_middle(a: str, b: str, ahead: list[int], back: list[int]) -> tuple[int, int] | None:
    """``_middle`` from ``FEW`` steps on: the same search, all diagonals of a step at once."""
    n, m = len(a), len(b)
    most, delta, zero = (n + m + 1) // 2, n - m, n + m + FEW + 3
    sides = []
    for x, y, found in ((a, b, ahead), (a[::-1], b[::-1], back)):
        reach = np.full(2 * zero + 1, -1, np.int32)
        reach[zero - len(found) // 2 : zero + len(found) // 2 + 1] = found
        signs = [np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (x, y)]
        # past its end a text has a sign that the other hasn't
        sides.append((*(np.append(s, np.uint32(end)).astype(np.int32) for s, end in zip(signs, (0x7FFFFFFE, 0x7FFFFFFF), strict=True)), reach))
    for d in range(FEW, most + 1):
        first, last = -d + 2 * max(0, d - m), d - 2 * max(0, d - n)
        k = np.arange(first, last + 1, 2, dtype=np.int32)
        for way, (p, q, reach) in enumerate(sides):
            x = reach[zero + first - 1 : zero + last : 2] + 1
            np.maximum(x, reach[zero + first + 1 : zero + last + 2 : 2], out=x)
            if first == -d:
                x[0] = reach[zero + first + 1]
            if last == d:
                x[-1] = reach[zero + last - 1] + 1
            # a place beyond either end is met with the sign past it
            on = np.flatnonzero(p[np.minimum(x, n)] == q[np.minimum(x - k, m)])
            for _ in range(7):
                if not len(on):
                    break
                x[on] += 1
                at = x[on]
                on = on[p[np.minimum(at, n)] == q[np.minimum(at - k[on], m)]]
            for i in on.tolist():  # few go on for long
                x[i] += _alike(p, int(x[i]), q, int(x[i] - k[i]))
            reach[zero + first : zero + last + 1 : 2] = x
            if way == (delta + 1) % 2:
                other = sides[1 - way][2]
                far = d if way else d - 1
                low, high = max(0, (delta - far - first + 1) // 2), max(0, min(len(k), (delta + far - first) // 2 + 1))
                met = x[low:high] + other[delta - k[low:high] + zero] >= n
                if met.any():
                    i = low + int(met.argmax())
                    at = int(x[i]), int(x[i] - k[i])
                    return (n - at[0], m - at[1]) if way else at
    return None


def _alike(p: np.ndarray, i: int, q: np.ndarray, j: int) -> int:
    """How many signs of ``p`` from ``i`` are those of ``q`` from ``j``, by stretches of doubling length."""
    begin, step = i, 16
    while True:
        n = min(step, len(p) - i, len(q) - j)
        differ = p[i : i + n] != q[j : j + n]
        if n == 0 or differ.any():
            return i + (int(differ.argmax()) if n else 0) - begin
        i, j, step = i + n, j + n, step * 2


def _only_way(x: str, y: str) -> Ops | None:
    """The shortest script of two texts, if all signs of one that the other has too can be kept, and in one way alone; else None.

    So they can be kept in the first way and the last, each sign as early or as late as may be, and these are the same.  A
    sentence against its capitals takes time by its length then: its small letters are in no way in the other.
    """
    in_x, in_y = set(x), set(y)
    at_x, at_y = [i for i, sign in enumerate(x) if sign in in_y], [j for j, sign in enumerate(y) if sign in in_x]
    few, many, p, q = (at_x, at_y, x, y) if len(at_x) <= len(at_y) else (at_y, at_x, y, x)
    first, left = [], iter(many)
    for i in few:
        j = next((j for j in left if q[j] == p[i]), None)
        if j is None:
            return None
        first.append(j)
    left = reversed(many)
    if any(next(j for j in left if q[j] == p[i]) != k for i, k in zip(reversed(few), reversed(first), strict=True)):
        return None
    at_x, at_y = (few, first) if few is at_x else (first, few)
    out: Ops = []
    i = j = 0
    for p, q in zip([*at_x, len(x)], [*at_y, len(y)], strict=True):
        out += ([(CUT, x[i:p])] if p > i else []) + ([(PUT, y[j:q])] if q > j else []) + ([(KEEP, x[p])] if p < len(x) else [])
        i, j = p + 1, q + 1
    return out


def script(a: str, b: str) -> Ops:
    """A shortest script from ``a`` to ``b``: what is kept, cut and put, in order."""
    out: Ops = []
    todo: list[tuple[str, str] | tuple[int, str]] = [(a, b)]
    while todo:
        x, y = todo.pop()
        if isinstance(x, int):
            out.append((x, y))
            continue
        head = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        if head:
            out.append((KEEP, x[:head]))
            x, y = x[head:], y[head:]
        tail = next((i for i, (p, q) in enumerate(zip(reversed(x), reversed(y), strict=False)) if p != q), min(len(x), len(y)))
        if tail:
            todo.append((KEEP, x[len(x) - tail :]))
            x, y = x[: len(x) - tail], y[: len(y) - tail]
        if not x or not y:
            out += ([(CUT, x)] if x else []) + ([(PUT, y)] if y else [])
            continue
        if only := _only_way(x, y):
            out += only
            continue
        at = _middle(x, y)
        if at is None or at in ((0, 0), (len(x), len(y))):
            out += [(CUT, x), (PUT, y)]
        else:
            todo += [(x[at[0] :], y[at[1] :]), (x[: at[0]], y[: at[1]])]
    return joined(out)


def joined(ops: Ops) -> Ops:
    """Neighbours of one kind in one, cuts before puts; what both share at an end is kept."""
    groups: list[list[str]] = [["", "", ""]]  # cut, put, and what is kept after them
    for op, text in ops:
        if op == KEEP:
            groups[-1][2] += text
        else:
            if groups[-1][2]:
                groups.append(["", "", ""])
            groups[-1][0 if op == CUT else 1] += text
    before = ""
    out: Ops = []
    for cut, put, keep in groups:
        head = next((i for i, (p, q) in enumerate(zip(cut, put, strict=False)) if p != q), min(len(cut), len(put)))
        before, cut, put = before + cut[:head], cut[head:], put[head:]
        tail = next((i for i, (p, q) in enumerate(zip(reversed(cut), reversed(put), strict=False)) if p != q), min(len(cut), len(put)))
        keep, cut, put = cut[len(cut) - tail :] + keep, cut[: len(cut) - tail], put[: len(put) - tail]
        if cut or put:
            out += [(KEEP, before)] * bool(before) + [(CUT, cut)] * bool(cut) + [(PUT, put)] * bool(put)
            before = keep
        else:
            before += keep
    return out + [(KEEP, before)] * bool(before)


def _edge(left: str, right: str) -> int:
    """How well a cut between two texts reads: at an end, a blank line, a line, a sentence, a space, a sign, inside a word."""
    if not left or not right:
        return 6
    a, b = left[-1], right[0]
    if (a in "\r\n" and re.search(r"\n\r?\n$", left)) or (b in "\r\n" and re.match(r"\r?\n\r?\n", right)):
        return 5
    if a in "\r\n" or b in "\r\n":
        return 4
    if not a.isalnum() and not a.isspace() and b.isspace():
        return 3
    if a.isspace() or b.isspace():
        return 2
    return 1 if not a.isalnum() or not b.isalnum() else 0


def slid(ops: Ops) -> Ops:
    """Single edits between kept texts moved to where they read best, the rightmost of equals."""
    out = list(ops)
    for i in range(1, len(out) - 1):
        if not (out[i - 1][0] == KEEP == out[i + 1][0] and out[i][0] != KEEP):
            continue
        left, edit, right = out[i - 1][1], out[i][1], out[i + 1][1]
        back = next((k for k, (p, q) in enumerate(zip(reversed(left), reversed(edit), strict=False)) if p != q), min(len(left), len(edit)))
        if back:
            left, edit, right = left[: len(left) - back], edit[len(edit) - back :] + edit[: len(edit) - back], edit[len(edit) - back :] + right
        best, top = (left, edit, right), _edge(left, edit) + _edge(edit, right)
        while edit and right and edit[0] == right[0]:
            left, edit, right = left + edit[0], edit[1:] + right[0], right[1:]
            if (score := _edge(left, edit) + _edge(edit, right)) >= top:
                best, top = (left, edit, right), score
        out[i - 1], out[i], out[i + 1] = (KEEP, best[0]), (out[i][0], best[1]), (KEEP, best[2])
    return joined([x for x in out if x[1]])


def readable(ops: Ops) -> Ops:
    """The script for a reader: kept texts no longer than the edits on both sides of them go into these, edits move to the ends of
    words, and what a cut ends with and the next put begins with is kept where it is half of either."""
    edits, keeps = [["", ""]], []  # cuts and puts before, between and after the kept texts
    for op, text in joined(ops):
        if op == KEEP:
            keeps.append(text)
            edits.append(["", ""])
        else:
            edits[-1][0 if op == CUT else 1] += text
    done, held = edits[:1], []
    for keep, edit in zip(keeps, edits[1:], strict=True):
        held.append(keep)
        done.append(edit)
        # a wider edit can take in the kept text before it too; the shared ends of the wider edit stay in it: kept again, they would only go in the next round
        while held and len(held[-1]) <= min(max(map(len, done[-2])), max(map(len, done[-1]))):
            (cut, put), keep = done.pop(), held.pop()
            done[-1] = [done[-1][0] + keep + cut, done[-1][1] + keep + put]
    ops = []
    for (cut, put), keep in zip(done, [*held, ""], strict=True):
        ops += [(CUT, cut)] * bool(cut) + [(PUT, put)] * bool(put) + [(KEEP, keep)] * bool(keep)
    return _overlaps(slid(ops))


def _shared(a: str, b: str) -> int:
    """How long the longest end of ``a`` is that ``b`` begins with, by the borders of ``b``'s beginnings."""
    b = b[: len(a)]
    borders, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = borders[k - 1]
        k += b[i] == b[k]
        borders[i] = k
    k = 0
    for sign in a[len(a) - len(b) :]:
        while k and (k == len(b) or sign != b[k]):
            k = borders[k - 1]
        k += sign == b[k] if b else 0
    return k


def _overlaps(ops: Ops) -> Ops:
    out: Ops = []
    i = 0
    while i < len(ops):
        if i + 1 < len(ops) and ops[i][0] == CUT and ops[i + 1][0] == PUT:
            cut, put = ops[i][1], ops[i + 1][1]
            forth, back = _shared(cut, put), _shared(put, cut)
            n = max(forth, back)
            if n and n >= min(len(cut), len(put)) / 2:
                if forth >= back:
                    parts = [(CUT, cut[: len(cut) - n]), (KEEP, put[:n]), (PUT, put[n:])]
                else:
                    parts = [(PUT, put[: len(put) - n]), (KEEP, cut[:n]), (CUT, cut[n:])]
                out += [p for p in parts if p[1]]
                i += 2
                continue
        out.append(ops[i])
        i += 1
    return out
