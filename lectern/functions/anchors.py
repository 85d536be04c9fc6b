"""Anchors of blocks: each block takes the stored sentences that its own are most like, among those that no block before has."""

from __future__ import annotations

import math
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

#: The least likeness that counts when no sentence of a block reaches its own threshold.
LAST_RESORT = 0.3


#: Likenesses that a document holds for forms it may meet again.
HELD = 200_000


class Alike:
    """The stored normal forms of one document by their rarest tokens, to find those like another form.

    A form at least ``least`` like another has ``least`` of its distinct tokens in it, repeats counted, so of its tokens in the order
    of their rarity in the document all but that many (less one) are an index: two forms that are alike share one of these.
    """

    def __init__(self, forms: list[str]) -> None:
        self.forms = forms
        self.words = [w.split(" ") if w else [] for w in forms]
        self.sets = [frozenset(w) for w in self.words]
        numbered = [self._numbered(w) for w in self.words]
        self.many = Counter(t for tokens in numbered for t in tokens)
        self.index: dict[tuple[str, int], list[int]] = {}
        for key, tokens in enumerate(numbered):
            for t in self._rarest(tokens, len(self.sets[key]), LAST_RESORT):
                self.index.setdefault(t, []).append(key)

    @staticmethod
    def _numbered(words: list[str]) -> list[tuple[str, int]]:
        """Each word with how many of it came before."""
        if len(set(words)) == len(words):
            return [(w, 0) for w in words]
        seen: dict[str, int] = {}
        out = []
        for w in words:
            out.append((w, seen.get(w, 0)))
            seen[w] = out[-1][1] + 1
        return out

    def _rarest(self, tokens: list[tuple[str, int]], different: int, least: float) -> list[tuple[str, int]]:
        many = self.many
        return sorted(tokens, key=lambda t: (many.get(t, 0), t))[: len(tokens) - math.ceil(different * least - 1e-9) + 1]

    def to(self, form: str, least: float, gone: list[bool]) -> list[tuple[float, int]]:
        """(likeness, key) of the stored forms at least ``least`` alike and not ``gone``, the most alike first; the likeness of ``similarity.light``."""
        if not form:
            return []
        a = form.split(" ")
        here = frozenset(a)
        size, different = len(a), len(here)
        met: set[int] = set()
        for t in self._rarest(self._numbered(a), different, least):
            met.update(self.index.get(t, ()))
        out = []
        for key in met:
            b, there = self.words[key], self.sets[key]
            if gone[key] or not b:
                continue
            i = len(here & there)
            u = different + len(there) - i
            longer = max(size, len(b))
            likeness = i * 1.0 / u
            # no more tokens are met in lock-step than the shorter has
            if max(likeness, 0.6 * i / u + 0.4 * min(size, len(b)) / longer) < least:
                continue
            j = 0
            if b[0] in here:
                for t in a:
                    if t == b[j]:
                        j += 1
                        if j == len(b):
                            break
            likeness = 1.0 if form == self.forms[key] else max(likeness, 0.6 * i * 1.0 / u + 0.4 * j / longer)
            if likeness >= least:
                out.append((likeness, key))
        out.sort(reverse=True)
        return out


class Anchoring:
    """One document's state: the ids of each normal form, and the intervals of ids that are taken.

    ``taken`` only grows, so each normal form keeps a pointer to its first free id and no id is looked at twice.  What is like a
    sentence is asked for only when no sentence of its own form is free.
    """

    def __init__(self, stored: dict[str, list[int]]) -> None:
        self.keys = {form: key for key, form in enumerate(stored)}
        self.ids, self.at = list(stored.values()), [0] * len(stored)
        self.gone = [False] * len(stored)
        self.taken: list[tuple[int, int]] = []
        self.alike: Alike | None = None
        self.known: dict[tuple[str, float], list[tuple[float, int]]] = {}
        self.held = 0

    def candidates(self, form: str, least: float) -> list[tuple[float, int]]:
        found = self.known.get((form, least))
        if found is None:
            if self.alike is None:
                self.alike = Alike(list(self.keys))
            found = self.alike.to(form, least, self.gone)
            if self.held > HELD:
                self.known.clear()
                self.held = 0
            self.known[form, least] = found
            self.held += len(found) + 1
        return found

    def is_free(self, lo: int, hi: int) -> bool:
        """Is no id from ``lo`` to ``hi`` taken?  Intervals don't overlap, so the one before and the one after decide."""
        k = bisect_right(self.taken, (lo, 1 << 62))
        return not (k and self.taken[k - 1][1] >= lo) and not (k < len(self.taken) and self.taken[k][0] <= hi)

    def first_free(self, key: int | None) -> int | None:
        if key is None or self.gone[key]:
            return None
        ids, k = self.ids[key], self.at[key]
        while k < len(ids) and not self.is_free(ids[k], ids[k]):
            k += 1
        self.at[key] = k
        self.gone[key] = k == len(ids)
        return None if self.gone[key] else ids[k]

    def best(self, candidates: list[tuple[float, int]], least: float) -> tuple[int | None, float]:
        """The free id most alike, the least of equals; ``candidates``: (likeness, key), the most alike first."""
        found, top = None, 0.0
        for likeness, key in candidates:
            if likeness < least or (found is not None and likeness < top):
                break
            here = self.first_free(key)
            if here is not None and (found is None or here < found):
                found, top = here, likeness
        return found, top

    def block(self, sentences: list[tuple[int, str, float]]) -> tuple[list[tuple[int, int, str, float]], tuple[int, int] | None]:
        """Matches (no, id, how, likeness) of a block's sentences (no, normal form, threshold), and its range of ids, if no id
        in it is taken; then it is taken."""
        matches = []
        for no, form, least in sentences:
            here = self.first_free(self.keys.get(form))
            if here is not None:
                matches.append((no, here, "hash", 1.0))
                continue
            here, likeness = self.best(self.candidates(form, least), least)
            if here is not None:
                matches.append((no, here, "likeness", likeness))
        if not matches:
            for no, form, _ in sentences:
                here, likeness = self.best(self.candidates(form, LAST_RESORT), LAST_RESORT)
                if here is not None:
                    matches.append((no, here, "last resort", likeness))
        if not matches:
            return [], None
        lo, hi = min(m[1] for m in matches), max(m[1] for m in matches)
        if not self.is_free(lo, hi):
            return matches, None
        insort(self.taken, (lo, hi))
        return matches, (lo, hi)


def anchored(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (doc_id, block_no, no, id, how, likeness, start_id, end_id, matched, sentences) of one document.

    ``rows``: (doc_id, block_no, no, normal form, threshold), the stored sentences first (block_no null, no its id), ascending, then
    those of blocks by block and number.  A match has its id, an anchor (no null) its range; the last anchor is extended to the last stored sentence.
    """
    stored: dict[str, list[int]] = {}
    state: Anchoring | None = None
    held, block, last, doc, most = [], None, None, None, None

    def finish() -> Iterator[tuple]:
        nonlocal last
        matches, span = state.block(held)
        for no, i, how, likeness in matches:
            yield doc, block, no, i, how, likeness, None, None, None, None
        if span:
            if last:
                yield last
            last = (doc, block, None, None, None, None, *span, len(matches), len(held))

    for doc, number, no, form, least in rows:
        if number is None:
            stored.setdefault(form, []).append(no)
            most = no
            continue
        if state is None:
            state = Anchoring(stored)
        if held and number != block:
            yield from finish()
            held = []
        block = number
        held.append((no, form, least))
    if held:
        yield from finish()
    if last:
        top = max(z for _, z in state.taken)
        yield last if most <= top else (*last[:7], most, most - last[6] + 1, last[9])
