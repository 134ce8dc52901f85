"""Suffix automaton of a set of sequences, with the least id of the sequences that hold each substring."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np


class SuffixAutomaton:
    """States are sets of end positions; `link` leads to the state of the longest suffix that ends elsewhere too.

    Sequences must be added by ascending id: a state keeps the id that made it, and `close` hands the ids of longer
    states down to their suffixes. A clone has no id of its own."""

    def __init__(self, no_id: int):
        self.no_id = no_id
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [no_id]

    def _clone(self, p: int, q: int, symbol: int) -> int:
        """A state for the substrings of `q` that are at most one longer than those of `p`."""
        nxt, link, new = self.next, self.link, len(self.length)
        nxt.append(nxt[q].copy())
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.low.append(self.no_id)
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = new
            p = link[p]
        link[q] = new
        return new

    def add(self, symbols: Iterable[int], own: int) -> None:
        nxt, link, length, low = self.next, self.link, self.length, self.low
        last = 0
        for symbol in symbols:
            known = nxt[last].get(symbol)
            if known is not None:  # an earlier sequence has been here
                last = known if length[known] == length[last] + 1 else self._clone(last, known, symbol)
                continue
            new, p = len(length), last
            nxt.append({})
            length.append(length[last] + 1)
            low.append(own)
            link.append(0)
            while p >= 0 and symbol not in nxt[p]:
                nxt[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, symbol)
            last = new

    def close(self) -> None:
        """Give every state the least id of the sequences in which its substrings occur, longest states first."""
        low, link, length = np.array(self.low), np.array(self.link), np.array(self.length)
        order = np.argsort(length, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0, True])
        for a, b in zip(edges[-2:0:-1], edges[:0:-1]):  # not the root
            np.minimum.at(low, link[order[a:b]], low[order[a:b]])
        self.low = low.tolist()

    def match(self, symbols: Sequence[int], width: int) -> tuple[list[int], list[int]]:
        """Matching statistics of a stream: for each position the length of the longest substring that ends
        there, counted up to `width`, and the least id that holds it."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        state, have, found, least = 0, 0, [], []
        for symbol in symbols:
            to = nxt[state].get(symbol)
            while to is None and state:
                state = link[state]
                have = length[state]
                to = nxt[state].get(symbol)
            if to is not None:
                state, have = to, have + 1
                if have > width:
                    have = width
                while length[link[state]] >= have > 0:
                    state = link[state]
            found.append(have)
            least.append(low[state] if have else self.no_id)
        return found, least
