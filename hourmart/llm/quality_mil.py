"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded from its byte histogram
and word statistics; gated attention weighs the encoded passages, and the weighted mean is scored.
Only documents have labels, so the attention learns which passages speak for or against one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.staging import session_of
from hourmart.llm.training import Adam, drawn, first_ids, fold, one_text_each, sample, sigmoid

SAMPLE_DOCS = 1500            # labelled documents of each label that are learned from, about
SAMPLE_PASSAGES = 64          # passages of each of these, drawn over the whole text; most texts have fewer
PASSAGE = 64
CODE, GATE = 16, 8
EPOCHS, BAGS = 12, 64
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2
FEATURES = 256 + 3


def passages(texts: B.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages and the passages' bounds by text; a text without words has one empty passage."""
    words = B.words_of(texts)
    counts = np.diff(words.bounds)
    n = np.maximum((counts + PASSAGE - 1) // PASSAGE, 1)
    first = np.cumsum(n) - n
    bounds = np.concatenate([first, [int(n.sum())]])
    passage = np.repeat(first, counts) + (np.arange(len(words.starts)) - np.repeat(words.bounds[:-1], counts)) // PASSAGE
    out = np.zeros((int(n.sum()), FEATURES), np.float32)
    if not len(passage):
        return out, bounds
    sizes = words.ends - words.starts
    byte_passage = np.repeat(passage, sizes)
    inside = texts.data[B.IN_WORD[texts.data]]
    out[:, :256] = np.bincount(byte_passage * 256 + inside, minlength=len(out) * 256).reshape(-1, 256)
    letters = np.maximum(out[:, :256].sum(1, keepdims=True), 1)
    out[:, :256] = np.sqrt(out[:, :256] / letters)
    hashes = B.SpanHasher(texts.data)(words.starts, words.ends)
    order = B.by_group(words.text, hashes)
    again = np.zeros(len(hashes), np.float64)
    again[order[1:]] = (hashes[order[1:]] == hashes[order[:-1]]) & (words.text[order[1:]] == words.text[order[:-1]])
    in_passage = np.maximum(np.bincount(passage, minlength=len(out)), 1)
    out[:, 256] = np.bincount(passage, again, len(out)) / in_passage
    out[:, 257] = np.bincount(passage, np.minimum(sizes, 40), len(out)) / in_passage / 10
    out[:, 258] = np.bincount(passage, sizes > 24, len(out)) / in_passage
    return out, bounds


class BagScorer:
    """Encoder, gated attention and a logistic output."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"e": (FEATURES, CODE), "ec": (CODE,), "v": (CODE, GATE), "u": (CODE, GATE), "a": (GATE,), "o": (CODE,), "oc": (1,)}
        self.weights = {k: (rng.standard_normal(s) * (s[0] ** -0.5 if k[-1] != "c" else 0)).astype(np.float32) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        code = np.tanh(x @ w["e"] + w["ec"])
        t, g = np.tanh(code @ w["v"]), sigmoid(code @ w["u"])
        energy = (t * g) @ w["a"]
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        weight = np.exp(energy - np.maximum.reduceat(energy, bounds[:-1])[owner])
        weight /= np.add.reduceat(weight, bounds[:-1])[owner]
        pooled = np.add.reduceat(weight[:, None] * code, bounds[:-1])
        return sigmoid(pooled @ w["o"] + w["oc"]), (code, t, g, owner, weight, pooled)

    def gradients(self, x: np.ndarray, bounds: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        p, (code, t, g, owner, weight, pooled) = self.forward(x, bounds)
        d = ((p - label) / len(label)).astype(np.float32)
        d_pooled = d[:, None] * w["o"]
        d_code = weight[:, None] * d_pooled[owner]
        d_weight = (code * d_pooled[owner]).sum(1)
        d_energy = weight * (d_weight - np.add.reduceat(weight * d_weight, bounds[:-1])[owner])
        d_t, d_g = d_energy[:, None] * w["a"] * g * (1 - t * t), d_energy[:, None] * w["a"] * t * g * (1 - g)
        d_code += d_t @ w["v"].T + d_g @ w["u"].T
        d_code *= 1 - code * code
        return {"o": pooled.T @ d, "oc": d.sum(keepdims=True), "a": (t * g).T @ d_energy, "v": code.T @ d_t, "u": code.T @ d_g,
                "e": x.T @ d_code + 1e-5 * w["e"], "ec": d_code.sum(0)}

    def fit(self, x: np.ndarray, bounds: np.ndarray, labels: np.ndarray, seed: int = 3) -> None:
        rng, adam = np.random.default_rng(seed), Adam(self.weights, 0.01)
        bags = [x[a:b] for a, b in zip(bounds, bounds[1:])]
        for _ in range(EPOCHS):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), BAGS):
                own = order[at:at + BAGS]
                sizes = [len(bags[i]) for i in own]
                adam.apply(self.gradients(np.concatenate([bags[i] for i in own]), np.concatenate([[0], np.cumsum(sizes)]), labels[own]))


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the passages drawn from each text."""
    for rows, texts in B.text_slices(batches):
        x, bounds = passages(texts)
        own, bounds = drawn(bounds, SAMPLE_PASSAGES)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("quality"), B.list_array(x[own].ravel(), bounds * FEATURES)], ["doc_id", "quality", "features"])


def train(docs: DataFrame, labels: DataFrame) -> BagScorer:
    """Learns from a bounded sample of labelled documents outside the held-out fold.

    A label's share of SAMPLE_DOCS is chosen by a hash of doc_id, one text a doc_id, and of a text
    SAMPLE_PASSAGES passages at most, drawn over the whole of it.
    """
    marks = (labels.filter("quality is not null and doc_id is not null")
             .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
             .filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    chosen, bound = sample(marks, "quality", SAMPLE_DOCS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows = texts.join(F.broadcast(first_ids(chosen, bound)), "doc_id").select("doc_id", "text", "quality")
    found = (one_text_each(rows, "quality", bound)
             .mapInArrow(_draw, "doc_id long, quality int, features array<float>").toArrow().sort_by("doc_id"))
    scorer = BagScorer()
    if len(found):
        share = marks.agg(F.avg("quality")).first()[0]
        features, quality = found["features"].combine_chunks(), found["quality"].to_numpy().astype(np.float32)
        bounds = (features.offsets.to_numpy() - features.offsets[0].as_py()) // FEATURES
        scorer.fit(features.flatten().to_numpy().reshape(-1, FEATURES), bounds, quality)
        # labels were sampled evenly; the output is moved back to their share among all labelled rows
        seen = np.mean(quality)
        if 0 < share < 1 and 0 < seen < 1:
            scorer.weights["oc"] += np.float32(np.log(share / (1 - share)) - np.log(seen / (1 - seen)))
    return scorer


def _score(scorer: BagScorer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in B.text_slices(batches):
            score = scorer.forward(*passages(texts))[0].astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"])
    return run


def quality_scores(docs: DataFrame, labels: DataFrame, scorer: BagScorer | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    A null or empty text, or one without words, is a bag of one empty passage and has its score like
    any other. Without labelled rows the scores are those of the untrained network. A document with
    several labels counts with the lowest; a null doc_id is neither held out nor learned from.
    Repeated rows give a row each; other columns are ignored.
    """
    session_of(docs)
    scorer = scorer or train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(_score(scorer), "doc_id long, held_out boolean, score double, predicted int")
