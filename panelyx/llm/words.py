"""A bounded cache of per-word results, and ragged gathers over numpy arrays."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import numpy as np

from .common import trim


class WordCache:
    """Numbers words at first sight and computes their results in bulk; starts anew when it holds over `limit` words.

    A cache changes no result: a word that was dropped is computed again.
    """

    def __init__(self, compute: Callable[[list], object], limit: int = 400_000):
        self.compute, self.limit = compute, limit
        self.clear()

    def clear(self) -> None:
        self.numbers: dict = defaultdict(count().__next__)
        self.parts: list = []
        self.done = 0

    def release(self, most: int = 50_000) -> None:
        """At the end of a task: lets go of a large cache, as the worker may be used for other work next."""
        if len(self.numbers) > most:
            self.clear()
        trim()

    def number(self, docs: Iterable[list]) -> list[np.ndarray]:
        """The words' numbers for each document; call results() after it."""
        if len(self.numbers) > self.limit:
            self.clear()
        at = self.numbers.__getitem__
        return [np.fromiter(map(at, words), np.int32, len(words)) for words in docs]

    def fresh(self) -> list:
        """The words that have no result yet, in the order of their numbers."""
        n, words = len(self.numbers) - self.done, []
        for w in reversed(self.numbers):
            if len(words) == n:
                break
            words.append(w)
        return words[::-1]

    def results(self):
        """One array with a row for each number."""
        if new := self.fresh():
            self.parts.append(self.compute(new))
            self.done += len(new)
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0] if self.parts else None


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def by_bytes(rows: Iterable[tuple], size: Callable[[tuple], int], most: int) -> Iterator[list[tuple]]:
    """Groups rows until they hold `most`; a larger row makes its own group."""
    held, got = [], 0
    for row in rows:
        n = size(row)
        if held and got + n > most:
            yield held
            held, got = [], 0
        held.append(row)
        got += n
    if held:
        yield held
