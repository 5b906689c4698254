"""The trained models against plain loops and differences, and what they learn from."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest

from hourmart.llm import batches as B
from hourmart.llm import language_id, quality_mil
from hourmart.llm.training import drawn, one_text_each


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x))


def doubles(model):
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    return model


def check_gradients(model, gradients, loss, seed: int) -> None:
    rng = np.random.default_rng(seed)
    for name, weights in model.weights.items():
        flat, gradient = weights.reshape(-1), np.asarray(gradients[name]).reshape(-1)
        largest = np.argsort(-np.abs(gradient))[:6]      # and some others
        for k in {*largest.tolist(), *rng.integers(0, len(flat), 6).tolist()}:
            before = flat[k]
            flat[k] = before + 1e-5
            up = loss()
            flat[k] = before - 1e-5
            down = loss()
            flat[k] = before
            assert (up - down) / 2e-5 == pytest.approx(gradient[k], rel=1e-4, abs=1e-6), (name, k)


def plain_layer(weights, d: str, word: bytes) -> list[list[float]]:
    h = language_id.STATES
    state, states = [0.0] * h, [None] * len(word)
    places = range(len(word)) if d == "f" else range(len(word) - 1, -1, -1)
    for i in places:
        x = [weights[d + "x"][word[i]][j] + weights[d + "c"][j] for j in range(3 * h)]
        u = [sum(state[k] * weights[d + "h"][k][j] for k in range(h)) for j in range(3 * h)]
        z = [sigmoid(x[j] + u[j]) for j in range(h)]
        r = [sigmoid(x[h + j] + u[h + j]) for j in range(h)]
        c = [math.tanh(x[2 * h + j] + r[j] * u[2 * h + j]) for j in range(h)]
        state = [z[j] * state[j] + (1 - z[j]) * c[j] for j in range(h)]
        states[i] = state
    return states


def test_labels_of_positions_against_a_plain_loop():
    tagger = doubles(language_id.ByteTagger(["de", "en", "fr"]))
    words = [b"a", "Straße".encode(), b"x" * language_id.PIECE]
    t = language_id.PIECE
    data = np.array([list(w.ljust(t, b" ")) for w in words], np.uint8)
    mask = (np.arange(t) < np.array([[len(w)] for w in words])).astype(np.float32)
    found = tagger.positions(data, mask)[0]
    for n, word in enumerate(words):
        forward, backward = plain_layer(tagger.weights, "f", word), plain_layer(tagger.weights, "b", word)
        for i in range(len(word)):
            both = forward[i] + backward[i]
            logits = [sum(b * tagger.weights["o"][k][j] for k, b in enumerate(both)) + tagger.weights["oc"][j] for j in range(3)]
            total = sum(map(math.exp, logits))
            assert found[i, n] == pytest.approx([math.exp(x) / total for x in logits], abs=1e-6)


def test_gradients_through_time():
    tagger = doubles(language_id.ByteTagger(["de", "en", "fr"]))
    rng = np.random.default_rng(4)
    data, sizes, target = rng.integers(97, 105, (4, 7)).astype(np.uint8), np.array([7, 1, 4, 6]), np.array([0, 2, 1, 0])
    mask = (np.arange(7) < sizes[:, None]).astype(np.float64)

    def loss() -> float:
        p = tagger.positions(data, mask)[0][:, np.arange(4), target]
        return float(-(np.log(p) * mask.T).sum() / mask.sum())

    check_gradients(tagger, tagger.gradients(data, mask, target), loss, 6)


BAG_TEXTS = ["a b c", "", "one two " * 100, "x" * 90 + " yes yes no"]


def test_bag_scores_against_a_plain_loop():
    scorer = doubles(quality_mil.BagScorer())
    w = scorer.weights
    x, bounds = quality_mil.passages(B.texts_of(pa.array(BAG_TEXTS)))
    assert np.diff(bounds).tolist() == [1, 1, 4, 1]
    found = scorer.forward(x, bounds)[0]
    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
        codes, energies = [], []
        for row in x[a:b]:
            code = [math.tanh(sum(row[f] * w["e"][f][j] for f in range(len(row))) + w["ec"][j]) for j in range(quality_mil.CODE)]
            t = [math.tanh(sum(code[j] * w["v"][j][g] for j in range(len(code)))) for g in range(quality_mil.GATE)]
            g = [sigmoid(sum(code[j] * w["u"][j][g] for j in range(len(code)))) for g in range(quality_mil.GATE)]
            codes.append(code)
            energies.append(sum(t[i] * g[i] * w["a"][i] for i in range(quality_mil.GATE)))
        total = sum(map(math.exp, energies))
        pooled = [sum(math.exp(e) / total * c[j] for e, c in zip(energies, codes)) for j in range(quality_mil.CODE)]
        assert found[n] == pytest.approx(sigmoid(sum(p * o for p, o in zip(pooled, w["o"])) + w["oc"][0]), abs=1e-6)


def test_gradients_of_the_attention():
    scorer = doubles(quality_mil.BagScorer())
    x, bounds = quality_mil.passages(B.texts_of(pa.array(BAG_TEXTS)))
    label = np.array([1.0, 0.0, 0.0, 1.0])

    def loss() -> float:
        p = scorer.forward(x, bounds)[0]
        return float(-np.log(np.where(label > 0, p, 1 - p)).mean() + 0.5e-5 * (scorer.weights["e"] ** 2).sum())

    check_gradients(scorer, scorer.gradients(x, bounds, label), loss, 8)


def test_members_are_drawn_over_the_whole_group():
    own, bounds = drawn(np.array([0, 3, 3, 1003]), 100)
    assert bounds.tolist() == [0, 3, 3, 103] and own[:3].tolist() == [0, 1, 2]
    rest = own[3:]
    assert len(set(rest.tolist())) == 100 and rest.min() >= 3 and rest.max() < 1003
    assert np.histogram(rest, 4, (3, 1003))[0].min() >= 10
    assert [x.tolist() for x in drawn(np.array([0, 3, 3, 1003]), 100)] == [own.tolist(), bounds.tolist()]
    assert [x.tolist() for x in drawn(np.array([0]), 5)] == [[], [0]]


def test_one_text_of_each_doc_id_is_learned_from(spark):
    rows = [(1, f"text {i}", "b" if i % 2 else "a") for i in range(50)] + [(2, "same", "b")] * 40 + [(2, "same", "a"), (3, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, label string").repartition(4)
    found = one_text_each(df, "label", 10).collect()
    assert sorted(r.doc_id for r in found) == [1, 2, 3]
    assert all((r.doc_id, r.text, r.label) in rows for r in found)
    assert sorted(found) == sorted(one_text_each(df.repartition(2), "label", 10).collect())
    assert one_text_each(df, "label", 2).count() == 2
    assert one_text_each(df, "label", 0).count() == 0


def test_learning_sees_the_end_of_a_long_text(spark):
    long_text = "ab " * 40_000 + "zq " * 40_000
    (row,) = language_id._draw(iter([pa.RecordBatch.from_pydict(
        {"doc_id": pa.array([1]), "lang": pa.array(["xx"]), "text": pa.array([long_text])})]))
    data = np.frombuffer(row["data"][0].as_py(), np.uint8).reshape(-1, language_id.PIECE)
    assert len(data) == language_id.SAMPLE_PIECES == len(row["sizes"][0])
    assert 0.4 < (data[:, 0] == ord("z")).mean() < 0.6
    (row,) = quality_mil._draw(iter([pa.RecordBatch.from_pydict(
        {"doc_id": pa.array([1]), "quality": pa.array([1], pa.int32()), "text": pa.array([long_text])})]))
    x = np.array(row["features"][0].as_py()).reshape(-1, quality_mil.FEATURES)
    assert len(x) == quality_mil.SAMPLE_PASSAGES and 0.2 < (x[:, ord("z")] > 0).mean() < 0.8
