"""A worker's memory of what a tokenizer said about words: bounded, in two generations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any


class Generations:
    """Word -> value. When the young generation is full it becomes the old one; words in use come back from there.

    Holds at most ``2 * limit`` words plus those of one call; what is forgotten is made again, so results never depend on it.
    """

    def __init__(self, limit: int):
        self.young: dict[str, Any] = {}
        self.old: dict[str, Any] = {}
        self.limit = limit

    def fill(self, words: Sequence[str], make: Callable[[list[str]], Sequence[Any]]) -> list[Any]:
        """Values of all words; ``make`` is asked once for the distinct words that nobody remembers."""
        found = list(map(self.young.get, words))
        if None in found:
            gaps = [i for i, v in enumerate(found) if v is None]
            missing = {words[i] for i in gaps}
            fresh = {w: v for w in missing if (v := self.old.get(w)) is not None}
            unknown = [w for w in missing if w not in fresh] if fresh else list(missing)
            if unknown:
                fresh.update(zip(unknown, make(unknown)))
            for i in gaps:
                found[i] = fresh[words[i]]
            self.young.update(fresh)
            if len(self.young) > self.limit:
                self.old, self.young = self.young, {}
        return found
