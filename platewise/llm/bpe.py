"""What makes byte-pair encoding a forward recurrence.

A token sequence is the encoding of its text exactly if every token encodes to
itself and every adjacent pair encodes to that pair.  So each prefix of a word
has one last token: the one vocabulary suffix that is compatible with the last
token of the prefix before it.  Both tokenizers of this package step over
prefixes with that rule.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence


class MergeTable:
    """Merges by rank; ``rank(left, right)`` is None where nothing merges."""

    def __init__(self, rank: Callable[[str, str], int | None]):
        self.rank = rank
        self._made: dict[str, tuple | None] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def merge(self, symbols: Sequence[str], stop: int = 1) -> list[str]:
        """The encoding of a short symbol sequence, merge by merge, until
        ``stop`` parts are left."""
        parts = list(symbols)
        while len(parts) > stop:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.rank(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merge_long(self, symbols: Sequence[str]) -> list[str]:
        """As ``merge``, with a heap over a linked list for long sequences."""
        parts: list[str | None] = list(symbols)
        n = len(parts)
        after, prior = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = self.rank(parts[i], parts[after[i]])
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != left or parts[j] != right:
                continue  # one of the two has merged meanwhile
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                prior[after[j]] = i
            offer(prior[i])
            offer(i)
        return [p for p in parts if p is not None]

    def symbols(self, token: str) -> list[str]:
        return list(token)

    def made(self, token: str) -> tuple | None:
        """``(rank, left, right)`` of the merge that completes the token in
        its own encoding; ``()`` for a symbol, None if the token's text does
        not encode to it."""
        known = self._made.get(token, 0)
        if known == 0:
            symbols = self.symbols(token)
            if len(symbols) == 1:
                known = ()
            else:
                known = None
                halves = self.merge(symbols, stop=2)
                if len(halves) == 2 and self.rank(*halves) is not None:
                    known = (self.rank(*halves), *halves)
            self._made[token] = known
        return known

    def solid(self, token: str) -> bool:
        """Whether the token's own text encodes to it."""
        return self.made(token) is not None

    def fits(self, left: str, right: str) -> bool:
        """Whether two solid tokens may stand side by side.

        Undoes the merges of both, the latest first.  At each step the two
        neighbours at the border coexisted until one of them took part in the
        merge just undone; had their own merge come before it, the border
        would be gone.  Of equal ranks the left place merges first.
        """
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > 400_000:  # a cache only
                self._pairs.clear()
            known = self._pairs[left, right] = self.border_stays(left, right)
        return known

    def border_stays(self, left: str, right: str) -> bool:
        limit, equal = float("inf"), False
        while True:
            rank = self.rank(left, right)
            if rank is not None and (rank < limit or (equal and rank == limit)):
                return False
            a, b = self.made(left), self.made(right)
            if not a and not b:
                return True
            if a and (not b or a[0] > b[0]):
                limit, _, left = a
                equal = False
            else:
                limit, right, _ = b
                equal = True
