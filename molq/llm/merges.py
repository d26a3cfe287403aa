"""Merge vocabularies by stable neighbours.

Greedy merging (best rank first, leftmost on ties) has one useful property: a sequence of tokens is
the encoding of its text exactly when each token and each pair of neighbours encodes to itself.
So the encoding of every prefix can be built from left to right: the last token of a prefix is
the only one that ends there and is stable next to the last token of the rest.

A pair is unstable when some merge across the border comes due while both border symbols exist.
Each token's border symbols, with the ranks at which they come and go, are listed once.
"""

from __future__ import annotations

from collections.abc import Callable

Life = list[tuple[str, float, float]]


class StablePairs(dict):
    """(left, right) -> does the pair encode to itself? With nothing on the left: does the right token?

    Answers are kept in two generations, up to a bound: what is not asked for again goes first."""

    LIMIT = 150_000

    def __init__(self, rank: Callable[[str, str], float | None], symbols: Callable[[str], list[str]]):
        super().__init__()
        self.rank, self.symbols, self.older = rank, symbols, {}
        self.borders: dict[str, tuple[bool, bool, Life, Life]] = {}

    def encode(self, symbols: list[str], seen: Callable[[float, list[str]], None] | None = None) -> list[str]:
        while len(symbols) > 1:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                r = self.rank(symbols[i], symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            symbols[at:at + 2] = [symbols[at] + symbols[at + 1]]
            if seen:
                seen(best, symbols)
        return symbols

    def _border(self, token: str) -> tuple[bool, bool, Life, Life]:
        """(encodes to itself, ranks only rise, left border symbols, right border symbols)."""
        found = self.borders.get(token)
        if found is None:
            first = self.symbols(token)
            states = [(float("-inf"), first[0], first[-1])]
            end = self.encode(first, lambda r, s: states.append((r, s[0], s[-1])))
            rising = all(a[0] <= b[0] for a, b in zip(states, states[1:]))
            lives = []
            for side in (1, 2):
                life: Life = []
                for state in states:
                    if not life or life[-1][0] != state[side]:
                        if life:
                            life[-1] = (*life[-1][:2], state[0])
                        life.append((state[side], state[0], float("inf")))
                lives.append(life)
            found = self.borders[token] = (end == [token], rising, *lives)
        return found

    def whole(self, token: str) -> bool:
        return self._border(token)[0]

    def __missing__(self, pair: tuple[str, str]) -> bool:
        stable = self.older.get(pair)
        if stable is None:
            stable = self._stable(pair) if pair[0] else self.whole(pair[1])
        if len(self) >= self.LIMIT:
            self.older = dict(self)
            self.clear()
        self[pair] = stable
        return stable

    def _stable(self, pair: tuple[str, str]) -> bool:
        left, right = map(self._border, pair)
        if not (left[1] and right[1]):
            return self.encode(self.symbols(pair[0]) + self.symbols(pair[1])) == list(pair)
        if not (left[0] and right[0]):
            return False
        # At equal rank the merge further left goes first: inside the left token, before the border.
        for a, a_from, a_to in left[3]:
            for b, b_from, b_to in right[2]:
                due = self.rank(a, b)
                if due is not None and max(a_from, b_from) <= due < a_to and due <= b_to:
                    return False
        return True
