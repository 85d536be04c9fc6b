"""A suffix automaton over words, grown string by string."""

from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """Holds every run of consecutive symbols of the strings added so far."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, string: Sequence) -> None:
        step, link, length = self.next, self.link, self.length
        last = 0
        for symbol in string:
            known = step[last].get(symbol)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, known, symbol)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and symbol not in step[at]:
                step[at][symbol] = new
                at = link[at]
            if at >= 0:
                known = step[at][symbol]
                link[new] = known if length[known] == length[at] + 1 else self._split(at, known, symbol)
            last = new

    def _split(self, at: int, known: int, symbol) -> int:
        """Gives ``known``'s shorter runs a state of their own."""
        step, link, length = self.next, self.link, self.length
        twin = len(step)
        step.append(step[known].copy())
        length.append(length[at] + 1)
        link.append(link[known])
        link[known] = twin
        while at >= 0 and step[at].get(symbol) == known:
            step[at][symbol] = twin
            at = link[at]
        return twin

    def matching(self, string: Sequence) -> list[int]:
        """For each place the length of the longest run that ends there and is held."""
        step, link, length = self.next, self.link, self.length
        state = now = 0
        out = []
        for symbol in string:
            while state and symbol not in step[state]:
                state = link[state]
                now = length[state]
            if symbol in step[state]:
                state = step[state][symbol]
                now += 1
            out.append(now)
        return out
