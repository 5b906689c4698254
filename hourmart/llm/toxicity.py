"""Toxicity by multiple-instance learning with a noisy-or over sentences.

A document is a bag of sentences. A sentence's score is logistic in the hashed words and
beginnings of words it holds, so inflected forms count too; the document is toxic unless every
sentence is clean: 1 - prod(1 - score). Only documents have labels, so the likelihood of the noisy-or
teaches which sentences speak for one, and these are then located.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.staging import session_of
from hourmart.llm.training import fold, sigmoid

BUCKET_BITS = 22
BEGINNINGS = (4, 5, 6, 7)     # bytes of a word's beginnings
SAMPLE_DOCS = 3000            # labelled documents of each label that are learned from, at most
SAMPLE_BYTES = 1 << 26        # bytes of all their texts together, at most; whole texts only
MIN_DOCS = 3                  # a bucket found in fewer of them keeps weight 0
EPOCHS, STEPS, BAGS, RATE, SPARSITY = 30, 2000, 64, 0.3, 5e-4       # epochs, or as many as take STEPS
FIRST_BIAS = -6.0             # log odds of a sentence before anything is learned
THRESHOLD = 0.5
FOLDS, HELD_OUT = 5, 0

_KINDS = B.seeds(2, 77)
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?\n")] = True
_SCHEMA = ("doc_id long, held_out boolean, score double, predicted int, n_sentences long, "
           "offending array<struct<start:int,length:int,score:double>>")


@dataclass
class Bags:
    """Sentences of documents: document i has sentences of[i]:of[i + 1]; (sentence, bucket) pairs are distinct."""

    of: np.ndarray
    sentence: np.ndarray
    bucket: np.ndarray
    starts: np.ndarray          # bytes of the sentence in the slice
    ends: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))


def _spans(words: B.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What is hashed of each word: all of it, and the beginnings that are shorter than it.

    Returns the word's number, start, end and a kind that keeps beginnings apart from whole words.
    """
    sizes, number = words.ends - words.starts, np.arange(len(words.starts))
    longer = [number[sizes > n] for n in BEGINNINGS]
    return (np.concatenate([number, *longer]), np.concatenate([words.starts, *[words.starts[x] for x in longer]]),
            np.concatenate([words.ends, *[words.starts[x] + n for x, n in zip(longer, BEGINNINGS)]]),
            np.repeat([0] + [1] * len(longer), [len(number), *map(len, longer)]))


def sentences(texts: B.Texts, wanted: np.ndarray | None = None) -> Bags:
    """Sentences end at . ! ? and line ends; those without a word are none, and a text without any has one empty one.

    With `wanted`, a truth value for each bucket, pairs of other buckets are left out.
    """
    words = B.words_of(texts, B.IN_PLAIN_WORD)
    text, count = words.text, np.diff(words.bounds)
    fresh = np.ones(len(words.starts), bool)
    if len(fresh):
        ends = np.cumsum(_ENDS[texts.data])[words.starts]
        fresh[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])
    empty = np.flatnonzero(count == 0)
    # sentences in order of their texts; an empty one stands where its text stands
    at = np.concatenate([text[fresh], empty])
    order = np.argsort(at, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    own = place[:int(fresh.sum())]
    of = np.searchsorted(at[order], np.arange(len(count) + 1))
    starts, ends = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    sentence = np.zeros(0, np.int64)
    bucket = np.zeros(0, np.int64)
    if len(fresh):
        of_word = own[np.cumsum(fresh) - 1]
        first = np.flatnonzero(fresh)
        starts[own] = words.starts[first]
        ends[own] = words.ends[np.concatenate([first[1:], [len(fresh)]]) - 1]
        number, begin, end, kind = _spans(words)
        hashes = B.SpanHasher(texts.data, B.FOLDED_VALUES)(begin, end) ^ _KINDS[kind]
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        sentence = of_word[number]
        if wanted is not None:
            found = np.flatnonzero(wanted[bucket])
            sentence, bucket = sentence[found], bucket[found]
        pairs = np.unique(sentence << BUCKET_BITS | bucket)
        sentence, bucket = pairs >> BUCKET_BITS, pairs & (1 << BUCKET_BITS) - 1
    return Bags(of, sentence, bucket, starts, ends)


class NoisyOr:
    """Logistic sentence scores, joined by noisy-or; weights are kept for the buckets `known` only."""

    def __init__(self, known: np.ndarray | None = None):
        self.known = np.zeros(0, np.int64) if known is None else known
        self.weights = np.zeros(len(self.known) + 1)      # the last one, always 0, is for all others
        self.bias = FIRST_BIAS

    @property
    def wanted(self) -> np.ndarray:
        """A truth value for each bucket: whether it has a weight."""
        found = np.zeros(1 << BUCKET_BITS, bool)
        found[self.known[self.weights[:-1] != 0]] = True
        return found

    def slots(self, bucket: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(self.known, bucket), len(self.known) - 1)
        return np.where(self.known[at] == bucket, at, len(self.known))

    def odds(self, slots: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        return self.bias + np.bincount(sentence, self.weights[slots], n)

    def scores(self, bags: Bags) -> tuple[np.ndarray, np.ndarray]:
        """Of each document and of each sentence."""
        odds = self.odds(self.slots(bags.bucket), bags.sentence, int(bags.of[-1]))
        return -np.expm1(-np.add.reduceat(np.logaddexp(0, odds), bags.of[:-1])), sigmoid(odds)

    def gradients(self, slots: np.ndarray, sentence: np.ndarray, owner: np.ndarray, label: np.ndarray,
                  share: np.ndarray) -> tuple[np.ndarray, float]:
        """Of the mean negative log-likelihood of the labels, by weight and bias; share weighs documents."""
        odds = self.odds(slots, sentence, len(owner))
        total = np.maximum(np.bincount(owner, np.logaddexp(0, odds), len(label)), 1e-9)
        by_total = np.where(label > 0, -1 / np.expm1(np.minimum(total, 50)), 1.0) * share / len(label)
        by_odds = by_total[owner] * sigmoid(odds)
        return np.bincount(slots, by_odds[sentence], len(self.weights)), float(by_odds.sum())

    def fit(self, bags: Bags, label: np.ndarray, share: np.ndarray, seed: int = 7) -> None:
        """Proximal Adagrad: weights that do not earn their keep stay 0."""
        rng, slots = np.random.default_rng(seed), self.slots(bags.bucket)
        pairs_of = np.searchsorted(bags.sentence, bags.of)          # pairs are in order of their sentences
        squares, bias_squares = np.full(len(self.weights), 1e-6), 1e-6
        for _ in range(max(EPOCHS, -(-STEPS * BAGS // len(label)))):
            order = rng.permutation(len(label))
            for at in range(0, len(order), BAGS):
                own = order[at:at + BAGS]
                pairs = np.concatenate([np.arange(pairs_of[i], pairs_of[i + 1]) for i in own])
                sizes = bags.of[own + 1] - bags.of[own]
                shift = np.repeat(np.cumsum(sizes) - sizes - bags.of[own], pairs_of[own + 1] - pairs_of[own])
                by_weight, by_bias = self.gradients(
                    slots[pairs], bags.sentence[pairs] + shift, np.repeat(np.arange(len(own)), sizes), label[own], share[own])
                squares += by_weight ** 2
                bias_squares += by_bias ** 2
                pace = RATE / np.sqrt(squares)
                moved = self.weights - pace * by_weight
                moved = np.sign(moved) * np.maximum(np.abs(moved) - pace * SPARSITY, 0)
                self.weights = np.where(by_weight != 0, moved, self.weights)
                self.weights[-1] = 0
                self.bias -= RATE * by_bias / np.sqrt(bias_squares)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document: the bounds of its sentences among its pairs, and the pairs' buckets."""
    for rows, texts in B.text_slices(batches):
        bags = sentences(texts)
        ends = np.searchsorted(bags.sentence, np.arange(int(bags.of[-1])), "right")
        pairs_of = np.searchsorted(bags.sentence, bags.of)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), B.list_array((ends - pairs_of[bags.owner]).astype(np.int32), bags.of),
             B.list_array(bags.bucket.astype(np.int32), pairs_of)], ["doc_id", "ends", "buckets"])


def train(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    """Learns from labelled documents outside the held-out fold, SAMPLE_DOCS of a label and SAMPLE_BYTES at most.

    Both bounds follow a hash of doc_id, one text a doc_id. Documents weigh as much as those of their
    label that were left out, so the label's share stays that of all labelled rows.
    """
    marks = (labels.filter("toxic is not null and doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
             .filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = {r[0]: r[1] for r in marks.groupBy("toxic").count().collect()}
    spark, texts = docs.sparkSession, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = [r for value in sorted(counts) for r in
              marks.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return NoisyOr()
    ids = F.broadcast(spark.createDataFrame([(r.doc_id,) for r in chosen], "doc_id long"))      # bounded by SAMPLE_DOCS
    sizes = dict(texts.join(ids, "doc_id").groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("n"), F.xxhash64("doc_id").alias("h"))
                 .orderBy("h").select("doc_id", F.coalesce("n", F.lit(0))).collect())
    upto = np.cumsum(list(sizes.values()), dtype=np.int64)
    label = {r.doc_id: r.toxic for r in chosen}
    kept = [i for i, total in zip(sizes, upto) if total <= SAMPLE_BYTES]
    if not kept:
        return NoisyOr()
    ids = F.broadcast(spark.createDataFrame([(i, sizes[i]) for i in kept], "doc_id long, n int"))
    one = (texts.join(ids, "doc_id").filter(F.coalesce(F.octet_length("text"), F.lit(0)) == F.col("n"))
           .groupBy("doc_id").agg(F.min("text").alias("text")))
    found = one.mapInArrow(_extract, "doc_id long, ends array<int>, buckets array<int>").toArrow().sort_by("doc_id")
    labelled = np.array([label[i] for i in found["doc_id"].to_pylist()])
    ends, buckets = found["ends"].combine_chunks(), found["buckets"].combine_chunks()
    per_doc, per_pair = np.diff(ends.offsets.to_numpy()), np.diff(buckets.offsets.to_numpy())
    of = np.concatenate([[0], np.cumsum(per_doc)])
    first = np.repeat(np.cumsum(per_pair) - per_pair, per_doc)
    sentence_ends = ends.flatten().to_numpy() + first
    bucket = buckets.flatten().to_numpy().astype(np.int64)
    sentence = np.searchsorted(sentence_ends, np.arange(len(bucket)), "right")
    # documents with each bucket, some documents at a time; buckets too rare for a weight go before learning
    docs_with, pairs_of = np.zeros(1 << BUCKET_BITS, np.int64), np.concatenate([[0], np.cumsum(per_pair)])
    for i in range(0, len(per_pair), 512):
        upto = min(i + 512, len(per_pair))
        of_doc = np.repeat(np.arange(upto - i), per_pair[i:upto])
        in_doc = np.unique(of_doc << BUCKET_BITS | bucket[pairs_of[i]:pairs_of[upto]])
        docs_with += np.bincount(in_doc & (1 << BUCKET_BITS) - 1, minlength=1 << BUCKET_BITS)
    frequent = docs_with[bucket] >= MIN_DOCS
    none = np.zeros(0, np.int64)
    bags = Bags(of, sentence[frequent], bucket[frequent], none, none)
    scorer = NoisyOr(np.flatnonzero(docs_with >= MIN_DOCS))
    weight = {v: counts[v] / max((labelled == v).sum(), 1) for v in counts}
    share = np.array([weight[v] for v in labelled])
    scorer.fit(bags, labelled, share / share.mean())
    return scorer


def _score(scorer: NoisyOr):
    wanted = scorer.wanted
    kind = pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches):
            bags = sentences(texts, wanted)
            score, by_sentence = scorer.scores(bags)
            bad = np.flatnonzero((by_sentence >= THRESHOLD) & (bags.ends > bags.starts))
            # places are counted in code points from the start of the text
            points = np.concatenate([[0], np.cumsum((texts.data & 0xC0) != 0x80)])
            begin = points[bags.starts[bad]] - points[texts.bounds[bags.owner[bad]]]
            spans = pa.StructArray.from_arrays(
                [pa.array(begin.astype(np.int32)), pa.array((points[bags.ends[bad]] - points[bags.starts[bad]]).astype(np.int32)),
                 pa.array(by_sentence[bad])], fields=list(kind))
            bounds = np.searchsorted(bags.owner[bad], np.arange(len(bags.of)))
            words = np.bincount(bags.owner, bags.ends > bags.starts, len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                 pa.array(words), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans)],
                ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"])
    return run


def toxicity(docs: DataFrame, labels: DataFrame, scorer: NoisyOr | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_sentences, offending.

    `labels` has (doc_id, toxic). offending lists sentences scored THRESHOLD or more: start and length
    in code points, and score; a document may pass the threshold by many weaker sentences and list
    none. A null or empty text, or one without words, has n_sentences 0 and the score of one empty
    sentence. Without labelled rows all sentences score as FIRST_BIAS says. A doc_id labelled more than
    once counts as toxic if any label says so, and of its texts a shortest is learned from; a null
    doc_id is neither held out nor learned from. Repeated rows give a row each; texts of any length are
    read whole; other columns are ignored.
    """
    session_of(docs)
    scorer = scorer or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(scorer), _SCHEMA)


def toxic_sentences(docs: DataFrame, labels: DataFrame, scorer: NoisyOr | None = None) -> DataFrame:
    """(doc_id, start, length, score) of every offending sentence."""
    return toxicity(docs, labels, scorer).select("doc_id", F.inline("offending"))
