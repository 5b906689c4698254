"""Results for the distinct spans of many texts, each worked out once and then gathered by arrays."""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from hourmart.llm.batches import SpanHasher, Texts

LIMIT = 1 << 18       # spans held; beyond it the cache starts again, so its memory is bounded


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class SpanCache:
    """Token ids of spans; `make` gets new spans' strings and returns a list of ids for each."""

    def __init__(self, make: Callable[[list[str]], list[list[int]]], limit: int = LIMIT):
        self.make, self.limit = make, limit
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.flat = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def encode(self, texts: Texts, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all spans one after the other, and the bounds of each span's ids."""
        keys, first, place = np.unique(SpanHasher(texts.data)(starts, ends), return_index=True, return_inverse=True)
        if len(self.rows) > self.limit:
            self.clear()
        known, keys = self.rows, keys.tolist()
        rows = list(map(known.get, keys))
        if None in rows:
            new = [i for i, r in enumerate(rows) if r is None]
            raw, at = texts.data.tobytes(), first[new]
            made = self.make([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            lengths = np.fromiter(map(len, made), np.int64, len(made))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.uint32, int(lengths.sum()))])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(lengths)])
            for i in new:
                rows[i] = known[keys[i]] = len(known)
        rows = np.array(rows, np.int64)[place]
        begin, lengths = self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]
        return self.flat[ranges(begin, lengths)], np.concatenate([[0], np.cumsum(lengths)])
