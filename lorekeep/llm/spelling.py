"""Strings numbered as they appear, and the ids that spell them, in flat arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np


def gathered(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + count], one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(total)]


class Numbers(dict):
    """Numbers of strings in the order in which they first appear; ``fresh`` holds the latest."""

    def __init__(self, known: Iterable[str] = ()):
        super().__init__((w, n) for n, w in enumerate(known))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Remembered:
    """Numbers of distinct strings, with what is learned of each while it is remembered.

    Beyond ``most`` strings or ``chars`` characters those that were met once, or
    least often, are forgotten.
    """

    def __init__(self, learn: Callable[[list[str]], object], most: int, chars: int):
        self.learn, self.most, self.chars = learn, most, chars
        self.numbers, self.held = Numbers(), 0
        self.uses = np.zeros(0, dtype=np.int64)

    def _add(self, learned) -> None:
        raise NotImplementedError

    def _keep(self, kept: np.ndarray) -> None:
        raise NotImplementedError

    def _forget(self) -> None:
        words = list(self.numbers)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-self.uses, kind="stable")
        fits = (np.cumsum(sizes[order]) <= self.chars // 2) & (np.arange(len(order)) < self.most // 2) & (self.uses[order] > 1)
        kept = np.sort(order[fits])
        self.numbers, self.held = Numbers([words[k] for k in kept.tolist()]), int(sizes[kept].sum())
        self.uses = self.uses[kept] // 2
        self._keep(kept)

    def numbered(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """Each text, given as its strings, as their numbers."""
        if len(self.numbers) > self.most or self.held > self.chars:
            self._forget()
        number = self.numbers.__getitem__
        cut = [np.fromiter(map(number, t), dtype=np.int32) for t in texts]
        fresh = self.numbers.fresh
        if fresh:
            self.held += sum(map(len, fresh))
            self._add(self.learn(fresh))
            fresh.clear()
        uses = np.bincount(np.concatenate(cut) if cut else np.zeros(0, dtype=np.int32), minlength=len(self.numbers))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        return cut


class Spellings(Remembered):
    """Ids of strings.  ``learn`` gives the ids of all, one after the other, and how many each has."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int, chars: int):
        super().__init__(learn, most, chars)
        self.ids, self.starts, self.counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _add(self, learned) -> None:
        ids, counts = learned
        self.starts = np.concatenate([self.starts, np.cumsum(counts) - counts + len(self.ids)])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])

    def _keep(self, kept: np.ndarray) -> None:
        self.ids = gathered(self.ids, self.starts[kept], self.counts[kept])
        self.counts = self.counts[kept]
        self.starts = np.cumsum(self.counts) - self.counts

    def spell(self, texts: Iterable[list[str]]) -> list[np.ndarray]:
        """The ids of each text, given as its strings."""
        return [gathered(self.ids, self.starts[c], self.counts[c]) for c in self.numbered(texts)]

    def flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings, one after the other, and how many each has."""
        own = self.numbered([words])[0]
        return gathered(self.ids, self.starts[own], self.counts[own]), self.counts[own]


class Rows(Remembered):
    """A row of numbers for each string.  ``learn`` gives the rows of all."""

    def __init__(self, learn: Callable[[list[str]], np.ndarray], most: int, chars: int, width: int):
        super().__init__(learn, most, chars)
        self.table = np.zeros((0, width))

    def _add(self, learned) -> None:
        self.table = np.concatenate([self.table, learned])

    def _keep(self, kept: np.ndarray) -> None:
        self.table = self.table[kept]


def slices(texts: list[str], chars: int) -> Iterator[slice]:
    """Runs of neighbours of about so many characters: one text at least."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chars):
            size += len(texts[end])
            end += 1
        yield slice(at, end)
        at = end
