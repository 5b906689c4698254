"""What the trained operators share: the held-out fold, a bounded sample of rows, and Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the doc_id as text, modulo parts; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def sample(rows: DataFrame, stratum: str, most: int) -> tuple[DataFrame, int]:
    """Rows of about `most` doc_ids of each value of `stratum`, by a hash of doc_id, and the doc_ids to take at most.

    Values are few (labels); they are counted first, so one scan is enough and nothing is sorted. Rows
    that share a doc_id are chosen together, so their number has no bound: :func:`one_text_each` sets it.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(stratum).count().collect()}
    if not counts:
        return rows, 0
    share = F.create_map(*[x for value, n in sorted(counts.items()) for x in (F.lit(value), F.lit(min(1.0, most / n)))])
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col(stratum)] * 1_000_003)
    return chosen, 2 * most * len(counts)


def first_ids(rows: DataFrame, bound: int) -> DataFrame:
    """The `bound` first rows in the order of a hash of doc_id; the same ones in every run."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def one_text_each(chosen: DataFrame, label: str, bound: int) -> DataFrame:
    """Of `chosen` (doc_id, text, label), one whole text for each of `bound` doc_ids at most.

    Of several texts of a doc_id, the one of least hash is taken. Only hashes are sorted, and only the
    texts taken are shuffled, copies of one text after they met in their task.
    """
    h = F.xxhash64("text")
    least = chosen.groupBy("doc_id").agg(F.min(F.struct(h.alias("h"), F.col(label))).alias("one"))
    keys = F.broadcast(first_ids(least, bound).select("doc_id", F.col("one.h").alias("h")))      # bounded
    return (chosen.join(keys, "doc_id").filter(h == F.col("h"))
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.min(label).alias(label)))


def drawn(bounds: np.ndarray, most: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of the members bounds[i]:bounds[i + 1] of each group, `most` at most, drawn over the whole group; and their bounds."""
    parts = []
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        parts.append(np.arange(a, b) if b - a <= most else
                     np.sort(a + np.random.default_rng([seed, b - a]).choice(b - a, most, replace=False)))
    sizes = np.minimum(np.diff(bounds), most)
    return np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)])


class Adam:
    """Adam steps on a dict of arrays."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def apply(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        scale = self.rate * np.sqrt(1 - 0.999 ** self.step) / (1 - 0.9 ** self.step)
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= (scale * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(self.weights[k].dtype)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
