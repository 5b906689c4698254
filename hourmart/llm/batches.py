"""Texts of an Arrow batch as one flat byte array, cut into words and hashed by array operations.

All cuts are at ASCII bytes, so working on UTF-8 bytes gives the same words as working on characters.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21      # texts of a batch are handled in slices of about so many bytes

_BLANKS = [0x20, *range(0x09, 0x0E)]
#: Bytes of words `[^\x20\x09-\x0D]+`.
IN_WORD = np.ones(256, bool)
IN_WORD[_BLANKS] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower case.
IN_PLAIN_WORD = np.zeros(256, bool)
IN_PLAIN_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95                    # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeds(n: int, start: int = 1) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(start, start + n, dtype=np.uint64) * np.uint64(_STEP))


#: A value for each byte; the second table takes A-Z as a-z.
BYTE_VALUES = seeds(256, 1000)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[0x41:0x5B] = BYTE_VALUES[0x61:0x7B]

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to the n-th at least; those of usual slices are kept."""
    size = max(1 << 16, 1 << max(n - 1, 0).bit_length())
    kept = max(_powers, default=0)
    if size <= kept:
        return _powers[kept]
    made = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)]))
                 for b in (np.uint64(_BASE), np.uint64(_INVERSE)))
    if size <= 2 * SLICE_BYTES:
        _powers.clear()
        _powers[size] = made
    return made


def release() -> None:
    """Gives back what this process keeps for the next slice."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """The function of a task, giving back at its end what a reused Python worker would go on holding."""
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()
    return tidied


@dataclass
class Texts:
    """Texts one after the other: text i is data[bounds[i]:bounds[i + 1]]."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


@dataclass
class Words:
    """Words of texts: word j is data[starts[j]:ends[j]]; text i has words bounds[i]:bounds[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def texts_of(column: pa.Array) -> Texts:
    """The UTF-8 bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return Texts(data[bounds[0]:bounds[-1]], bounds - bounds[0])


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES, rows: int = 1 << 30) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Rows of the batches, cut so that a slice holds `rows` at most and about `limit` bytes of text, or one longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = texts_of(batch.column(column))
        first = 0
        while first < len(whole):
            last = int(np.searchsorted(whole.bounds, whole.bounds[first] + limit, "right")) - 1
            last = min(max(last, first + 1), first + rows, len(whole))
            bounds = whole.bounds[first:last + 1]
            yield batch.slice(first, last - first), Texts(whole.data[bounds[0]:bounds[-1]], bounds - bounds[0])
            first = last


def words_of(texts: Texts, members: np.ndarray = IN_WORD) -> Words:
    """Maximal runs of member bytes; no run goes from one text into the next."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(texts.bounds), np.int64))
    inside = members[texts.data]
    edge = np.ones(n, bool)
    np.logical_not(inside[:-1], out=edge[1:])
    edge[texts.bounds[:-1][texts.bounds[:-1] < n]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[texts.bounds[1:][texts.bounds[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & edge) + 1
    return Words(starts, ends, np.searchsorted(starts, texts.bounds))


class SpanHasher:
    """64-bit hashes of spans of a byte array; equal spans have equal hashes wherever they are."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.up, self.down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        v = values[data]
        v *= self.up[:len(data)]
        np.cumsum(v, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends] - self.sums[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64) * np.uint64(_STEP)
        return mix(h)

    def beginnings(self, starts: np.ndarray) -> np.ndarray:
        """At each place, the hash of what begins at the last of `starts` and ends before the place; the first start is 0."""
        n = len(self.sums) - 1
        size = np.diff(np.append(starts, n))
        down = self.down[starts]
        h = np.repeat(down, size)
        h *= self.sums[:-1]
        h -= np.repeat(self.sums[starts] * down + starts.astype(np.uint64) * np.uint64(_STEP), size)
        h += np.arange(n, dtype=np.uint64) * np.uint64(_STEP)
        return mix(h)

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of a fixed length."""
        h = self.sums[length:] - self.sums[:-length]
        h *= self.down[:len(h)]
        h += np.uint64(length * _STEP & 0xFFFFFFFFFFFFFFFF)
        return mix(h)


def runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive items (len(hashes) - length + 1 of them)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n].copy()
    for j in range(1, length):
        total *= np.uint64(_BASE)
        total += hashes[j:n + j]
    return mix(total + np.uint64(length))


def by_group(groups: np.ndarray, values: np.ndarray) -> np.ndarray:
    """An order of the rows by (group, value); groups are few and come in rising order."""
    order = np.argsort(values)
    if len(groups) and groups[-1] > 0:
        kind = np.uint16 if groups[-1] < 1 << 16 else np.uint64
        order = order[np.argsort(groups[order].astype(kind), kind="stable")]
    return order


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def list_array(values: np.ndarray, bounds: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values),
                                    mask=None if mask is None else pa.array(mask))
