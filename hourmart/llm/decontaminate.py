"""Benchmark decontamination with suffix arrays over shards of the training texts.

A shard is a slice of documents. Its words get ranks, prefix doubling sorts its suffixes (none goes
beyond its document), and every suffix of every benchmark item is searched in it by binary search,
one word deeper at a time, all suffixes side by side. The interval left at the depth of a window
gives the places the window occurs at; the deepest interval that is not empty gives the longest
verbatim match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.span_cache import ranges
from hourmart.llm.staging import session_of

WINDOW = 10                   # words
SHARD_BYTES = 1 << 22         # text of a shard, or one longer document
BLOCK_BYTES = 1 << 25         # benchmark text that is held at once
FIELDS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long"


@dataclass
class Items:
    """Words of benchmark items, one item after the other."""

    words: np.ndarray         # hashes
    left: np.ndarray          # words from here to the item's end
    window: np.ndarray        # words of the item's windows
    item: np.ndarray          # number of the item
    names: list[str | None]   # item_id as a string


def items_of(texts: list[str | None], names: list[str | None]) -> Items:
    found, words = _words(B.texts_of(pa.array(texts, pa.string())))
    counts = np.diff(words.bounds)
    item = words.text
    left = words.bounds[1:][item] - np.arange(len(item))
    return Items(found, left, np.minimum(counts[item], WINDOW), item, names)


def _words(texts: B.Texts) -> tuple[np.ndarray, B.Words]:
    words = B.words_of(texts, B.IN_PLAIN_WORD)
    return B.SpanHasher(texts.data, B.FOLDED_VALUES)(words.starts, words.ends), words


def suffix_array(symbols: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes, by `depth` symbols at least; `left` is each suffix's length.

    Pairs of ranks at doubling offsets are sorted and ranked anew until all are unique or the depth
    is reached. A suffix that ends sorts before those that go on.
    """
    n = len(symbols)
    rank, order, k = symbols + 1, np.argsort(symbols, kind="stable"), 1
    while k < depth:
        beyond = np.zeros(n, np.int64)
        goes_on = np.flatnonzero(left > k)
        beyond[goes_on] = rank[goes_on + k]
        key = rank * (n + 1) + beyond
        order = np.argsort(key)
        in_order = key[order]
        new = np.ones(n, np.int64)
        new[1:] = in_order[1:] != in_order[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        k *= 2
        if rank.max(initial=0) == n:
            break
    return order


class Shard:
    """The suffix array of the words of some texts."""

    def __init__(self, texts: B.Texts, depth: int):
        hashes, self.words = _words(texts)
        self.known, self.symbols = np.unique(hashes, return_inverse=True)
        self.text = self.words.text
        self.left = self.words.bounds[1:][self.text] - np.arange(len(hashes))
        self.order = suffix_array(self.symbols, self.left, depth)

    def _bound(self, low: np.ndarray, high: np.ndarray, depth: int, symbol: np.ndarray) -> np.ndarray:
        """Binary search in each interval: the first suffix whose symbol at `depth` is `symbol` or more."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            at = self.order[middle]
            here = np.where(self.left[at] > depth, self.symbols[np.minimum(at + depth, len(self.symbols) - 1)], -1)
            less = here < symbol[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
        return low

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each item suffix: the interval of its window, the interval of its longest match and its length."""
        m, n = len(items.words), len(self.order)
        at = np.minimum(np.searchsorted(self.known, items.words), max(len(self.known) - 1, 0))
        symbol = np.where(self.known[at] == items.words, at, -1) if len(self.known) else np.full(m, -1)
        first, last = np.zeros(m, np.int64), np.zeros(m, np.int64)
        low, high, length = np.zeros(m, np.int64), np.full(m, n), np.zeros(m, np.int64)
        live, depth = np.arange(m), 0
        while len(live):
            live = live[(items.left[live] > depth)]
            s = symbol[live + depth]
            live, s = live[s >= 0], s[s >= 0]
            a = self._bound(low[live], high[live], depth, s)
            b = self._bound(a, high[live], depth, s + 1)
            live, a, b = live[a < b], a[a < b], b[a < b]
            low[live], high[live], length[live] = a, b, depth + 1
            depth += 1
            whole = live[items.window[live] == depth]
            first[whole], last[whole] = low[whole], high[whole]
        return first, last, low, high, length


@dataclass
class Findings:
    n_words: np.ndarray
    n_hit: np.ndarray
    n_items: np.ndarray
    items: list[list[str]]
    longest: np.ndarray


def inspect(texts: B.Texts, blocks: Iterable[Items], depth: int) -> Findings:
    """What each text shares with the items of all blocks; `depth` is the longest item's number of words."""
    shard = Shard(texts, max(depth, WINDOW))
    hit = np.zeros(len(shard.symbols) + 1, np.int64)
    longest = np.zeros(len(texts), np.int64)
    names: list[set[str]] = [set() for _ in range(len(texts))]
    for items in blocks:
        first, last, low, high, length = shard.search(items)
        some = np.flatnonzero(last > first)
        counts = last[some] - first[some]
        places = shard.order[ranges(first[some], counts)]
        np.add.at(hit, places, 1)
        np.add.at(hit, places + np.repeat(items.window[some], counts), -1)
        pairs = np.unique(np.stack([shard.text[places], np.repeat(items.item[some], counts)]), axis=1) if len(places) else np.zeros((2, 0), np.int64)
        for text, item in pairs.T.tolist():
            if items.names[item] is not None:
                names[text].add(items.names[item])
        some = np.flatnonzero(length)
        counts = high[some] - low[some]
        np.maximum.at(longest, shard.text[shard.order[ranges(low[some], counts)]], np.repeat(length[some], counts))
    covered = (np.cumsum(hit[:-1]) > 0).astype(np.int64)
    return Findings(np.diff(shard.words.bounds), B.sums_between(covered, shard.words.bounds),
                    np.array([len(x) for x in names], np.int64), [sorted(x) for x in names], longest)


class Blocks:
    """Items that were sent out in blocks; one block is in memory at a time."""

    def __init__(self) -> None:
        self.sent: list[Broadcast] = []
        self.depth = 0

    def add(self, spark: SparkSession, items: Items) -> None:
        self.sent.append(spark.sparkContext.broadcast(items))
        self.depth = max(self.depth, int(items.left.max(initial=0)))

    def __iter__(self) -> Iterator[Items]:
        for block in self.sent:
            yield block.value
            if len(self.sent) > 1:
                block.__dict__.pop("_value", None)


def _blocks(benchmark: DataFrame) -> Blocks:
    """The benchmark in blocks of about BLOCK_BYTES, each collected and sent out by itself."""
    spark = session_of(benchmark)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-total // BLOCK_BYTES)
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n, 1)))
    blocks = Blocks()
    for i in range(n):
        found = rows.filter(key == i).distinct().collect()
        blocks.add(spark, items_of([r.text for r in found], [r.item_id for r in found]))
    return blocks


def _report(blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches, limit=SHARD_BYTES):
            found = inspect(texts, blocks, blocks.depth)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(found.n_words), pa.array(found.n_hit), pa.array(found.n_items),
                 pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found.items], pa.string()),
                 pa.array(found.n_hit > 0), pa.array(found.longest)],
                [f.split()[0] for f in FIELDS.split(", ")])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match (words).

    A null or empty text, or one without words, has no hits and is clean. Items without words have no
    windows; rows that repeat an item count once, and an item_id counts once in n_items whatever its
    rows; an item with a null item_id hits but is not listed. Every row of `docs` gives a row. An
    empty benchmark leaves all clean. Other columns are ignored.
    """
    session_of(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(B.tidy(_report(_blocks(benchmark))), FIELDS)


def _clean(blocks: Blocks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches):      # smaller shards, as a pipeline's workers hold more
            yield rows.filter(pa.array(inspect(texts, blocks, blocks.depth).n_hit == 0))
    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that share no window with the benchmark."""
    session_of(docs)
    return docs.mapInArrow(B.tidy(_clean(_blocks(benchmark))), docs.schema)
