"""Many glob patterns as one automaton, whose state can be carried from a folder to what lies in it."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"\*+|\?|\[!?\]?[^\]]*\]|.", re.S)


class Globs:
    """Shift-and automaton over all ``patterns`` at once: bit i of a state means that the part before token i has matched.

    ``*`` stands for any characters, slashes too, ``?`` for one, ``[a-c]`` and ``[!a-c]`` for one in or not in a set; a bracket
    that is not closed stands for itself. A step costs one table lookup and three operations on integers, whatever the
    number of patterns. ``start`` is the state before any character; ``step`` reads some; ``accepts`` says whether all of
    what was read matches a pattern.
    """

    def __init__(self, patterns: list[str]):
        self._tokens: list[str | None] = []  # None ends a pattern
        begins = []
        for pattern in patterns:
            begins.append(len(self._tokens))
            self._tokens += [*_TOKEN.findall(pattern), None]
        bits = lambda test: sum(1 << i for i, t in enumerate(self._tokens) if test(t))
        self._stars = bits(lambda t: t is not None and t[0] == "*")
        self._ends = bits(lambda t: t is None)
        self._others = [(i, t) for i, t in enumerate(self._tokens) if t is not None and t[0] != "*"]
        self._moves: dict[str, int] = {}
        self.start = self._past_stars(sum(1 << i for i in begins))

    def _past_stars(self, state: int) -> int:
        """A star may stand for nothing; runs of stars are one token, so one shift is enough."""
        return state | (state & self._stars) << 1

    def _fits(self, token: str, c: str) -> bool:
        if token == "?":
            return True
        if token[0] != "[" or len(token) == 1:
            return token == c
        inner = token[1:-1]
        negated = inner.startswith("!")
        inner = inner[negated:]
        found, i = False, 0
        while i < len(inner):
            if i + 2 < len(inner) and inner[i + 1] == "-":
                found |= inner[i] <= c <= inner[i + 2]
                i += 3
            else:
                found |= inner[i] == c
                i += 1
        return found != negated

    def step(self, state: int, text: str) -> int:
        for c in text:
            if not state:
                break
            move = self._moves.get(c)
            if move is None:
                move = self._moves[c] = sum(1 << i for i, t in self._others if self._fits(t, c))
            state = self._past_stars((state & move) << 1 | state & self._stars)
        return state

    def accepts(self, state: int) -> bool:
        return bool(state & self._ends)

    def match(self, text: str) -> bool:
        return self.accepts(self.step(self.start, text))
