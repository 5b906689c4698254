"""Spans that were encoded stay for the next slices of a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from hourmart.llm import batches as B
from hourmart.llm import records
from hourmart.llm.queries import BYTE_BPE


def test_spans_are_encoded_once(monkeypatch):
    cache = records._encoder(BYTE_BPE)[0]
    cache.clear()
    made, make = [], cache.make
    monkeypatch.setattr(cache, "make", lambda strings: made.append(len(strings)) or make(strings))
    texts = B.texts_of(pa.array([" ".join(f"w{i}" for i in range(k, k + 100_000)) for k in range(0, 300_000, 100_000)]))
    first = records.encoded(texts, BYTE_BPE)
    again = records.encoded(texts, BYTE_BPE)
    assert made == [sum(made)] and sum(made) > 1 << 18
    assert all(np.array_equal(a, b) for a, b in zip(first, again))
    cache.clear()
