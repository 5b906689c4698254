"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions and labels every position; states start
anew with each word, so a word's labels are worked out once for all its places. A document's
probabilities are the mean over all its positions. Training is backpropagation through time in
numpy, on the driver, on a bounded sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.span_cache import LIMIT
from hourmart.llm.staging import session_of
from hourmart.llm.training import Adam, drawn, fold, one_text_each, sample, sigmoid

UNKNOWN = "und"
SAMPLE_DOCS = 400             # labelled documents of each language that are learned from, about
SAMPLE_PIECES = 2048          # pieces of each of these, drawn over the whole text; most texts have fewer
ABOVE_CHANCE = 1.2            # of a document that stays: its best language's probability against chance
PIECE = 24                    # bytes; a longer word is read in pieces
STATES = 12                   # of each direction
STEPS = 500
BATCH = 256
FOLDS, HELD_OUT = 4, 2


class ByteTagger:
    """Two gated recurrent layers, forwards and backwards, and a softmax at every position."""

    def __init__(self, languages: list[str], seed: int = 7):
        self.languages, h, rng = languages, STATES, np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.weights = {}
        for d in ("f", "b"):
            self.weights |= {d + "x": normal(256, 3 * h, by=0.3), d + "h": normal(h, 3 * h, by=h ** -0.5), d + "c": np.zeros(3 * h, np.float32)}
        self.weights |= {"o": normal(2 * h, len(languages), by=0.3), "oc": np.zeros(len(languages), np.float32)}

    def _layer(self, d: str, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, list]:
        w, h = self.weights, STATES
        n, t = data.shape
        kind = w[d + "h"].dtype
        state, states, tape = np.zeros((n, h), kind), np.zeros((t, n, h), kind), []
        for i in (range(t) if d == "f" else range(t - 1, -1, -1)):
            x = w[d + "x"][data[:, i]] + w[d + "c"]
            u = state @ w[d + "h"]
            gates = sigmoid(x[:, :2 * h] + u[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            c = np.tanh(x[:, 2 * h:] + r * u[:, 2 * h:])
            m = mask[:, i, None]
            new = state + m * (1 - z) * (c - state)
            tape.append((i, state, z, r, c, u[:, 2 * h:], m))
            state = new
            states[i] = state
        return states, tape

    def positions(self, data: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Probabilities of each language at each position (position, word, language)."""
        forward, tape_f = self._layer("f", data, mask)
        backward, tape_b = self._layer("b", data, mask)
        both = np.concatenate([forward, backward], 2)
        logits = both @ self.weights["o"] + self.weights["oc"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True), (both, tape_f, tape_b)

    def gradients(self, data: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy of all positions, back through time."""
        p, (both, tape_f, tape_b) = self.positions(data, mask)
        error = p
        error[:, np.arange(len(target)), target] -= 1
        error *= (mask.T / mask.sum())[:, :, None]
        w, h = self.weights, STATES
        out = {"o": np.einsum("tnh,tnl->hl", both, error), "oc": error.sum((0, 1))}
        back = error @ w["o"].T
        for d, tape, part in (("f", tape_f, back[:, :, :h]), ("b", tape_b, back[:, :, h:])):
            gx, gh, gc = np.zeros_like(w[d + "x"]), np.zeros_like(w[d + "h"]), np.zeros_like(w[d + "c"])
            ds = np.zeros((data.shape[0], h), gh.dtype)
            for i, state, z, r, c, uc, m in reversed(tape):
                ds = ds + part[i]
                dn = m * ds
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (state - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(gx, data[:, i], dx)
                gc += dx.sum(0)
                gh += state.T @ du
                ds = ds - dn * (1 - z) + du @ w[d + "h"].T
            out |= {d + "x": gx, d + "h": gh, d + "c": gc}
        return out

    def fit(self, words: list[tuple[np.ndarray, np.ndarray]], seed: int = 11) -> None:
        """words: for each language its pieces (rows of PIECE bytes) and their lengths."""
        rng, adam = np.random.default_rng(seed), Adam(self.weights, 0.01)
        each = max(1, BATCH // len(words))
        for _ in range(STEPS):
            parts = [(d[pick], n[pick], np.full(len(pick), i)) for i, (d, n) in enumerate(words) if len(n)
                     for pick in [rng.integers(0, len(n), each)]]
            data, size, target = (np.concatenate(x) for x in zip(*parts))
            t = int(size.max())
            adam.apply(self.gradients(data[:, :t], (np.arange(t) < size[:, None]).astype(np.float32), target))

    def sums(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each piece, the sum of its positions' probabilities."""
        out = np.zeros((len(size), len(self.languages)), np.float32)
        order = np.argsort(size, kind="stable")
        for at in range(0, len(order), 2048):
            own = order[at:at + 2048]
            t = int(size[own].max())
            mask = (np.arange(t) < size[own, None]).astype(np.float32)
            out[own] = (self.positions(data[own, :t], mask)[0] * mask.T[:, :, None]).sum(0)
        return out


def pieces_of(texts: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of all words, and the pieces' bounds by text."""
    words = B.words_of(texts)
    n = (words.ends - words.starts + PIECE - 1) // PIECE
    first = np.cumsum(n) - n
    inner = np.arange(int(n.sum())) - np.repeat(first, n)
    starts = np.repeat(words.starts, n) + inner * PIECE
    ends = np.minimum(starts + PIECE, np.repeat(words.ends, n))
    return starts, ends, np.concatenate([first, [len(starts)]])[words.bounds]


def _rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each piece's bytes as a row, filled up with what follows (masked later)."""
    return data[np.minimum(starts[:, None] + np.arange(PIECE), max(len(data) - 1, 0))]


def with_letters(texts: B.Texts) -> np.ndarray:
    """Which texts have a letter."""
    ascii_letter = np.zeros(256, np.int64)
    ascii_letter[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    found = B.sums_between(ascii_letter[texts.data], texts.bounds) > 0
    for i in np.flatnonzero(~found & (np.diff(texts.bounds) > 0)).tolist():
        found[i] = any(map(str.isalpha, texts.data[texts.bounds[i]:texts.bounds[i + 1]].tobytes().decode()))
    return found


def _draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pieces drawn from each text, as rows of PIECE bytes, and their lengths."""
    for rows, texts in B.text_slices(batches):
        starts, ends, bounds = pieces_of(texts)
        own, bounds = drawn(bounds, SAMPLE_PIECES)
        data, at = _rows(texts.data, starts[own], ends[own]), bounds.tolist()
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("lang"), pa.array([data[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
             B.list_array((ends - starts)[own].astype(np.int32), bounds)], ["doc_id", "lang", "data", "sizes"])


def train(docs: DataFrame) -> ByteTagger:
    """Learns from a bounded sample of documents outside the held-out fold that have a text and a language.

    About SAMPLE_DOCS documents of a language are chosen by a hash of doc_id, one text a doc_id, and of
    a text SAMPLE_PIECES pieces at most, drawn over the whole of it.
    """
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.col("lang").cast("string").alias("lang"))
            .filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)))
    chosen, bound = sample(rows, "lang", SAMPLE_DOCS)
    found = (one_text_each(chosen, "lang", bound)
             .mapInArrow(B.tidy(_draw), "doc_id long, lang string, data binary, sizes array<int>").toArrow().sort_by("doc_id").to_pylist())
    languages = sorted({r["lang"] for r in found})
    tagger = ByteTagger(languages)
    words = []
    for language in languages:
        own = [r for r in found if r["lang"] == language]
        words.append((np.frombuffer(b"".join(r["data"] for r in own), np.uint8).reshape(-1, PIECE),
                      np.array([n for r in own for n in r["sizes"]], np.int64)))
    if any(len(n) for _, n in words):
        tagger.fit(words)
    return tagger


class _Known:
    """Sums of pieces seen before, by hash; starts again when LIMIT pieces are held."""

    def __init__(self, tagger: ByteTagger):
        self.tagger, self.rows, self.sums = tagger, {}, np.zeros((0, len(tagger.languages)), np.float32)

    def of(self, texts: B.Texts, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        keys, first, place = np.unique(B.SpanHasher(texts.data)(starts, ends), return_index=True, return_inverse=True)
        if len(self.rows) > LIMIT:
            self.rows, self.sums = {}, self.sums[:0]
        keys = keys.tolist()
        rows = list(map(self.rows.get, keys))
        if None in rows:
            new = [i for i, r in enumerate(rows) if r is None]
            at = first[new]
            self.sums = np.concatenate([self.sums, self.tagger.sums(_rows(texts.data, starts[at], ends[at]), (ends - starts)[at])])
            for i in new:
                rows[i] = self.rows[keys[i]] = len(self.rows)
        return self.sums[np.array(rows, np.int64)][place]


def predict(texts: B.Texts, known: _Known) -> tuple[list[str], np.ndarray]:
    """The language of each text and its probability."""
    languages = known.tagger.languages
    starts, ends, bounds = pieces_of(texts)
    label, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not languages or not len(starts):
        return label, score
    sums = known.of(texts, starts, ends).astype(np.float64)
    total = np.concatenate([np.zeros((1, len(languages))), np.cumsum(sums, 0)])
    pooled = total[bounds[1:]] - total[bounds[:-1]]
    mean = pooled / np.maximum(pooled.sum(1, keepdims=True), 1e-9)
    best = mean.argmax(1)
    for i in np.flatnonzero(with_letters(texts)).tolist():
        label[i], score[i] = languages[best[i]], min(float(mean[i, best[i]]), 1.0)
    return label, score


def _label(tagger: ByteTagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(tagger)
        for rows, texts in B.text_slices(batches):
            label, score = predict(texts, known)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(label, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])
    return run


def languages(docs: DataFrame, tagger: ByteTagger | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    A text that is null or has no letter is `und` with score 0, and so is every text if nothing can be
    learned (an empty table, no labels). A null doc_id is neither held out nor learned from. Repeated
    rows give a row each; only doc_id, text and, for learning, lang are read.
    """
    session_of(docs)
    tagger = tagger or train(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(B.tidy(_label(tagger)), "doc_id long, held_out boolean, lang_pred string, score double")


def _known_only(tagger: ByteTagger):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = _Known(tagger), len(tagger.languages)
        for rows, texts in B.text_slices(batches):
            keep = with_letters(texts)
            if n > 1:
                label, score = predict(texts, known)
                keep &= np.array([x != UNKNOWN for x in label]) & (score * n >= ABOVE_CHANCE)
            yield rows.filter(pa.array(keep))
    return run


def identified(docs: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose language can be told.

    Texts that are null, empty or without a letter go, and so do those for which the network's best
    language has less than ABOVE_CHANCE times the probability that all languages alike would have. Where
    fewer than two languages can be learned, all texts with letters stay. Repeated rows and null
    doc_ids are judged like any other, texts are read whole, and an empty table stays empty.
    """
    session_of(docs)
    return docs.mapInArrow(B.tidy(_known_only(train(docs))), docs.schema)
