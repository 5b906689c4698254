"""Removal of repeated byte strings by prefix doubling over sampled suffixes.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. Sorting a row for
each byte of the corpus from length 1 on would write many times the corpus, so the rounds start long
and on few suffixes:

1. Of every `length` bytes, one suffix is taken: the one whose short string (three quarters) has the lowest hash
   (the leftmost of equals). Equal strings take it at the same offset, so every repeated string has
   its suffix among those that remain when unique ones are dropped. A suffix speaks for the run of
   starts that took it.
2. Remaining suffixes are ranked again by all the bytes their starts cover. Where this is repeated,
   all starts of the run are past the threshold.
3. For the others, and one suffix of each class of step 2 that shares its short string with
   another class, each start becomes a row with its rank pair: the first half's bytes and those
   of the second. Spark sorts the pairs; a pair of two classes is a repeated string of `length` bytes.
   These suffixes are joined with their texts, so that no other suffix gets a row for each of its starts.

Ranks are 64-bit hashes of the strings they stand for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.span_cache import ranges
from hourmart.llm.staging import Steps, free_name, session_of

LENGTH = 400
PART_BITS = 18                   # bits of a filter that are put together in one task
SLICE_BYTES = 1 << 20            # texts that are handled together
FILTER_BITS = 28                 # a filter is 2 ** FILTER_BITS bits at most, whatever the input; it only saves work
BITS_EACH = 16                   # bits of a filter for each of its hashes, up to that size
SECOND = 24                      # a hash sets the bits that its lowest and its middle bits name; the highest are uneven where the lowest hash was taken


def short_of(length: int) -> int:
    """Bytes of the strings that suffixes are sampled by: 300 for 400."""
    return 3 * length // 4


class Suffixes:
    """The sampled suffixes of texts: their place, the run of starts they speak for, and two ranks."""

    def __init__(self, texts: B.Texts, length: int = LENGTH):
        size = short_of(length)
        slack = length - size + 1        # short strings in a string of `length` bytes
        self.hasher = B.SpanHasher(texts.data)
        n = len(texts.data)
        if n < length:
            self.place = self.first = self.last = self.text = np.zeros(0, np.int64)
            self.rank = self.wide = np.zeros(0, np.uint64)
            return
        short = self.hasher.windows(size)
        low = (short & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(short), dtype=np.uint64)
        reach = 1
        while 2 * reach <= slack:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < slack:
            low = np.minimum(low[:len(low) - (slack - reach)], low[slack - reach:])
        text = np.repeat(np.arange(len(texts)), np.diff(texts.bounds))[:len(low)]
        starts = np.flatnonzero(np.arange(len(low)) + length <= texts.bounds[1:][text])
        taken = (low[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.diff(taken, prepend=-1))      # a suffix lies in one text, so runs end with the text
        self.place, self.first = taken[new], starts[new]
        self.last = starts[np.append(new[1:], len(starts)) - 1] if len(new) else new
        self.text = text[self.first]
        self.rank = short[self.place]
        shape = ((self.place - self.first) * length + self.last - self.first).astype(np.uint64)
        self.wide = B.mix(self.hasher(self.first, self.last + length) ^ B.mix(shape + np.uint64(1)))


class Filter:
    """A set of hashes in bits that grow with their number up to a bound: no false negatives, 2 % of false positives below it."""

    def __init__(self, hashes: DataFrame):
        self.size = min(FILTER_BITS, max(PART_BITS, (BITS_EACH * hashes.count() - 1).bit_length()))
        mask, bit = (1 << self.size) - 1, F.col("bit")
        both = F.array(F.col("hash").bitwiseAND(mask), F.shiftright("hash", SECOND).bitwiseAND(mask))
        dealt = (hashes.select(F.explode(both).alias("bit")).select(
            F.shiftright(bit, PART_BITS).cast("int").alias("part"), bit.bitwiseAND((1 << PART_BITS) - 1).cast("int").alias("bit")))
        parts = dealt.repartition("part").mapInArrow(B.tidy(_bit_parts), "part int, bits binary")
        self.words = np.zeros(1 << (self.size - 5), np.uint32)
        size = 1 << (PART_BITS - 5)
        for row in parts.toLocalIterator():         # 2 ** FILTER_BITS bits at most
            self.words[row.part * size:(row.part + 1) * size] = np.frombuffer(row.bits, np.uint32)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self._set(hashes) & self._set(hashes >> np.uint64(SECOND))

    def _set(self, bit: np.ndarray) -> np.ndarray:
        bit = bit & np.uint64((1 << self.size) - 1)
        return ((self.words[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & np.uint32(1)).astype(bool)


def _bit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each part of a filter; all rows of a part are in one task, which holds the bits alone."""
    parts: dict[int, np.ndarray] = {}
    for batch in batches:
        part, bit = batch.column("part").to_numpy(), batch.column("bit").to_numpy()
        for p in np.unique(part).tolist():
            own = bit[part == p]
            bits = parts.setdefault(p, np.zeros(1 << (PART_BITS - 5), np.uint32))
            np.bitwise_or.at(bits, own >> 5, np.uint32(1) << (own & 31).astype(np.uint32))
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([b.tobytes() for b in parts.values()], pa.binary())], ["part", "bits"])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _ranks(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in B.text_slices(batches, limit=SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([_signed(Suffixes(texts, length).rank)], ["hash"])
    return run


def _remaining(repeated: Broadcast, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches, limit=SLICE_BYTES):
            s = Suffixes(texts, length)
            own = np.flatnonzero(repeated.value.has(s.rank))
            base = texts.bounds[:-1][s.text[own]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("key").take(pa.array(s.text[own])), _signed(s.rank[own]), _signed(s.wide[own]),
                 pa.array(s.first[own] - base), pa.array(s.last[own] - base)],
                ["key", "rank", "wide", "first", "last"])
    return run


def _pairs(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches, limit=SLICE_BYTES):
            hasher = B.SpanHasher(texts.data)
            of_text = pa.compute.list_value_length(rows.column("first")).to_numpy()
            first, size, rank, wide = (rows.column(c).flatten().to_numpy() for c in ("first", "size", "rank", "wide"))
            start = ranges(first + np.repeat(texts.bounds[:-1], of_text), size)
            yield pa.RecordBatch.from_arrays(
                [_signed(hasher(start, start + half)), _signed(hasher(start + half, start + length)),
                 pa.array(np.repeat(rank, size)), pa.array(np.repeat(wide, size)), pa.array(ranges(np.zeros_like(size), size))],
                ["rank", "next_rank", "of_rank", "wide", "offset"])
    return run


def repeated_starts(texts: DataFrame, steps: Steps, length: int = LENGTH) -> DataFrame:
    """(key, first, last): runs of starts of repeated strings in the text with that key; runs may overlap."""
    spark: SparkSession = texts.sparkSession
    suffixes = texts.select("text").mapInArrow(B.tidy(_ranks(length)), "hash long")
    again = steps.keep(suffixes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "again")
    repeated = spark.sparkContext.broadcast(Filter(again))
    steps.drop(again)
    del suffixes, again
    steps.release()
    rows = steps.keep(texts.select("key", "text").mapInArrow(
        B.tidy(_remaining(repeated, length)), "key long, rank long, wide long, first long, last long"), "suffixes")
    repeated.destroy()

    # a class: equal bytes under all starts of the run, of which there are equally many; its first member speaks for it
    order = F.xxhash64("key", "first")
    classes = steps.keep(rows.groupBy("rank", "wide").agg(F.count("*").alias("n"), F.min_by("key", order).alias("key"),
                                                         F.min_by("first", order).alias("first"), F.max(F.col("last") - F.col("first") + 1).alias("size")), "classes")
    split = classes.groupBy("rank").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("rank")
    speakers = classes.join(split, "rank", "left_semi").groupBy("key").agg(F.collect_list(F.struct("first", "size", "rank", "wide")).alias("runs"))
    steps.release()
    pairs = steps.keep(texts.join(speakers.hint("shuffle_hash"), "key").select("text", *(F.col(f"runs.{c}").alias(c) for c in ("first", "size", "rank", "wide"))).mapInArrow(
        B.tidy(_pairs(length)), "rank long, next_rank long, of_rank long, wide long, offset long"), "pairs")
    del split, speakers
    steps.release()
    doubled = steps.keep(pairs.groupBy("rank", "next_rank").agg(F.min("wide").alias("low"), F.max("wide").alias("high"))
                         .filter("low <> high").select("rank", "next_rank"), "doubled")
    steps.release()
    found = (pairs.join(doubled, ["rank", "next_rank"]).select(F.col("of_rank").alias("rank"), "wide", "offset").distinct()
             .groupBy("rank", "wide").agg(F.collect_list("offset").alias("offsets")))      # at most a quarter of the length of each
    found = steps.keep(found, "found")
    steps.drop(pairs, doubled)
    del pairs, doubled
    steps.release()
    whole = classes.filter("n > 1").select("rank", "wide")
    sure = rows.join(whole, ["rank", "wide"], "left_semi").select("key", "first", "last")
    some = (rows.join(whole, ["rank", "wide"], "left_anti").join(found, ["rank", "wide"])
            .select("key", "first", F.explode("offsets").alias("offset"))
            .select("key", (F.col("first") + F.col("offset")).alias("first"), (F.col("first") + F.col("offset")).alias("last")))
    return sure.unionByName(some)


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key of doc_id and text; rows that share it are alike in all that matters here."""
    return docs.withColumn("key", F.xxhash64(F.col("doc_id"), F.col("text")))


def _with_runs(docs: DataFrame, steps: Steps, length: int) -> DataFrame:
    """The runs of each text that has some; texts need no sorting to meet them."""
    texts = _keyed(docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    runs = steps.last(repeated_starts(texts.select("key", "text"), steps, length).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs")), "runs")     # bounded by the text's own length
    steps.release()      # the texts are shuffled next
    return runs.select(F.col("key").alias("run_key"), F.col("runs.first").alias("run_first"), F.col("runs.last").alias("run_last"))


def removed_bytes(texts: B.Texts, first: pa.Array, last: pa.Array, length: int = LENGTH) -> np.ndarray:
    """Which bytes are covered by strings that start in the runs of their text (lists, null for none)."""
    edges = np.zeros(len(texts.data) + 1, np.int64)
    for i, (a, b) in enumerate(zip(first, last)):
        if a.is_valid:
            at = texts.bounds[i]
            np.add.at(edges, at + a.values.to_numpy(), 1)
            np.add.at(edges, at + b.values.to_numpy() + length, -1)
    return np.cumsum(edges[:-1]) > 0


def _report(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches, limit=SLICE_BYTES):
            gone = removed_bytes(texts, rows.column("run_first"), rows.column("run_last"), length)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            at = texts.bounds[:-1][texts.bounds[:-1] < len(gone)]
            begins[at] = gone[at]
            sums = [hashlib.sha256(texts.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(texts.bounds.tolist(), texts.bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(texts.bounds)), pa.array(B.sums_between(gone.astype(np.int64), texts.bounds)),
                 pa.array(B.sums_between(begins.astype(np.int64), texts.bounds)), pa.array(sums, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    return run


def repeated_bytes(docs: DataFrame, steps: Steps | None = None, length: int = LENGTH) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A null text counts as empty. Texts shorter than `length` keep all. Rows that repeat a document are
    occurrences of their own, so all of their strings are repeated. An empty table gives no rows.
    Other columns are ignored.
    """
    steps = steps or Steps(session_of(docs))
    rows = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    runs = _with_runs(rows.select("doc_id", "text"), steps, length)
    return (rows.join(runs.hint("shuffle_hash"), rows["key"] == runs["run_key"], "left").select("doc_id", "text", "run_first", "run_last")
            .mapInArrow(B.tidy(_report(length)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def _cut(columns: list[str], first: str, last: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches, limit=SLICE_BYTES):
            gone = removed_bytes(texts, rows.column(first), rows.column(last), length)
            kept = B.sums_between((~gone).astype(np.int64), texts.bounds)
            left = texts.data[~gone].tobytes()
            ends = np.cumsum(kept)
            text = [left[b - n:b].decode(errors="ignore") for b, n in zip(ends.tolist(), kept.tolist())]
            made = {"text": pa.array(text, pa.string())}
            if "n_chars" in columns:
                made["n_chars"] = pa.array([len(x) for x in text], rows.schema.field("n_chars").type)
            touched = B.sums_between(gone.astype(np.int64), texts.bounds) > 0
            yield pa.RecordBatch.from_arrays(
                [pa.compute.if_else(pa.array(touched), made[c], rows.column(c)) if c in made else rows.column(c) for c in columns], columns)
    return run


def without_repeats(docs: DataFrame, steps: Steps | None = None, length: int = LENGTH) -> DataFrame:
    """The documents with strings of `length` bytes that repeat cut out of `text` (and `n_chars` counted again where it is there).

    A character that loses some of its bytes goes as a whole. Rows without repeats, null and empty texts
    among them, stay as they are; rows that repeat a document are occurrences of their own. Texts are read
    whole, an empty table stays empty, and columns may have any names.
    """
    steps = steps or Steps(session_of(docs))
    runs = _with_runs(docs.select("doc_id", "text"), steps, length)
    key = F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))
    own, first, last = (free_name(c, docs.columns) for c in ("run_key", "run_first", "run_last"))
    joined = docs.withColumn(own, key).join(runs.toDF(own, first, last).hint("shuffle_hash"), own, "left")
    return joined.mapInArrow(B.tidy(_cut(docs.columns, first, last, length)), docs.schema)
