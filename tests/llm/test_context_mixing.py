"""Scores of the context mixer against a plain loop over bits with counts in a dict."""

from __future__ import annotations

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from hourmart.llm import context_mixing as C


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def steps_of(text):
    """(byte, contexts) of each byte of a text and its end."""
    data, word = (text or "").encode() + b"\0", b""
    for i, byte in enumerate(data):
        yield byte, [data[max(0, i - k):i].rjust(k, b"\0") for k in C.ORDERS] + [word]
        word = b"" if byte in b" \t\n\x0b\x0c\r" else word + bytes([byte])


def bits_of(byte):
    for j in range(8):
        yield j, (byte | 256) >> (8 - j), byte >> (7 - j) & 1


def plain_scores(rows):
    counts = defaultdict(lambda: [0, 0])
    for doc_id, text in rows:
        if not held_out(doc_id):
            for byte, contexts in steps_of(text):
                for _, node, bit in bits_of(byte):
                    for k, context in enumerate(contexts):
                        counts[k, context, node][bit] += 1

    def odds(seen, own):
        zeros, ones = seen
        stored = max(-127, min(127, round(math.log((ones + C.PRIOR) / (zeros + C.PRIOR)) * C.LEVELS)))
        return (int(C.WITHOUT_OWN[stored + 128]) if own else stored) / C.LEVELS

    def run(text, start, own):
        """The log-probability, and (weights, length) of each segment's end."""
        total, ends, weights = 0.0, [], None
        for i, (byte, contexts) in enumerate(steps_of(text)):
            if i % C.SEGMENT == 0:
                if weights is not None:
                    ends.append((weights, C.SEGMENT))
                weights = start.copy()
            for j, node, bit in bits_of(byte):
                x = np.array([odds(counts.get((k, context, node), (0, 0)), own) for k, context in enumerate(contexts)])
                p = 1 / (1 + math.exp(-float(x @ weights[j])))
                total += math.log(p if bit else 1 - p)
                weights[j] += C.RATE * (bit - p) * x
        return total, [*ends, (weights, i % C.SEGMENT + 1)]

    first = np.full((8, C.CONTEXTS), C.START)
    ends = [e for doc_id, text in rows if not held_out(doc_id) for e in run(text, first, True)[1]]
    learned = sum(w * n for w, n in ends) / sum(n for _, n in ends)
    return [run(text, learned, False)[0] / math.log(10) for _, text in rows]


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    words = ["the", "cat", "sat", "été", "4711", "on", "mat", "中文", "thereupon", "x" * 70]
    rows = [(i, " ".join(rnd.choice(words) + rnd.choice(["", ",", str(rnd.randint(0, 99))]) for _ in range(rnd.choice([1, 20, 70])))) for i in range(30)]
    return rows + [(40, ""), (41, None), (None, "no number"), (3, rows[3][1]), (50, "\t\n  a"), (51, "".join(chr(rnd.randint(1, 500)) for _ in range(1500)))]


def test_scores_are_those_of_a_plain_loop(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id or -1, r.score) for r in C.language_scores(docs).collect())
    expected = sorted((doc_id or -1, score) for (doc_id, _), score in zip(texts, plain_scores(texts)))
    assert [k for k, _ in found] == [k for k, _ in expected]
    assert np.allclose([s for _, s in found], [s for _, s in expected], rtol=1e-4)


def test_scores_do_not_depend_on_slices(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    one, many = (sorted((r.doc_id or -1, round(r.score, 6)) for r in C.language_scores(docs.repartition(n)).collect()) for n in (1, 7))
    assert one == many


def test_thinned_odds_come_back():
    rng = np.random.default_rng(2)
    key = np.unique((rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 256, 3000).astype(np.uint64))
    odds = C._state_odds(key, rng.integers(0, 9, len(key)))
    assert np.array_equal(C._filled(C._thinned(odds, key), key), odds)
    rows = odds.view(np.int8).reshape(-1, 8)
    assert len(np.unique(np.stack([key >> np.uint64(8), rows[:, 0].view(np.uint8)], 1), axis=0)) == len(np.unique(key >> np.uint64(8)))


def test_streams_have_the_contexts_of_plain_texts():
    texts = ["one two  one", "", "a", "été\tx" * 40, "one", "\n\n"]
    stream = C.Stream(C.B.texts_of(C.pa.array(texts)))
    plain = [(byte, contexts) for text in texts for byte, contexts in steps_of(text)]
    assert stream.data.tolist() == [byte for byte, _ in plain]
    assert stream.chain.tolist() == [int.from_bytes(contexts[-2][::-1] + bytes([byte])) for byte, contexts in plain]
    for k, hashes in enumerate(stream.contexts):
        assert len({(contexts[k], int(h)) for (_, contexts), h in zip(plain, hashes)}) == len({contexts[k] for _, contexts in plain}) == len(set(hashes.tolist()))


def test_places_are_found_where_slots_are_shared():
    keys = np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64)
    keys = np.unique(keys)[::-1]
    asked = np.random.default_rng(4).integers(0, len(keys), 20000)
    places = C.Places(keys)
    assert len(places.tables) > 2 and np.array_equal(places(keys[asked]), asked)
    places.rest |= dict(zip(keys.tolist(), range(len(keys))))
    places.tables = places.tables[:1]           # what tables leave is found too
    assert np.array_equal(places(keys[asked]), asked)


def test_rounds_ask_for_each_order_once():
    chain, n = C._counted(C.Stream(C.B.texts_of(C.pa.array(["one two three four " * 9, "two"]))).chain)
    assert sorted(k for numbers in C.ROUNDS for k in numbers) == list(range(C.CONTEXTS))
    batch = C.pa.RecordBatch.from_arrays([C.pa.array(["s"]), *(C.pa.array([x]) for x in C._packed(chain, n))], ["slice", "keys", "times"])
    rounds = [list(C._asked([k for k in numbers if k < len(C.ORDERS)])(iter([batch]))) for numbers in C.ROUNDS]
    found = {k: [] for k in range(len(C.ORDERS))}
    for rows in sum(rounds, []):
        for row in rows.to_pylist():
            found[row["context"]] += zip(*(x.tolist() for x in C._unpacked(row["keys"], row["times"])))
    for k, order in enumerate(C.ORDERS):
        hashed = C._hashed(C._shorter(chain, max(C.ORDERS), order), order).tolist()
        counts = defaultdict(int)
        for key, times in zip(hashed, n.tolist()):
            counts[key] += times
        assert found[k] == sorted(counts.items())


def test_lists_thinned_together_are_those_thinned_alone():
    rng = np.random.default_rng(6)
    lists = [np.unique((rng.integers(0, 9, n).astype(np.uint64) << np.uint64(24)) | rng.integers(0, 256, n).astype(np.uint64)) for n in (1, 300, 40)]
    odds = [C._state_odds(key, rng.integers(0, 9, len(key))) for key in lists]
    together = C._thinned(np.concatenate(odds), np.concatenate(lists), np.cumsum([0, *map(len, lists[:-1])]))
    assert np.array_equal(together, np.concatenate([C._thinned(o, key) for o, key in zip(odds, lists)]))


def test_words_meet_their_counts_in_their_buckets():
    slices = {"one": C._counted(C._word_hashes(C.B.texts_of(C.pa.array(["The the cat"])))[0]),
              "two": C._counted(C._word_hashes(C.B.texts_of(C.pa.array(["the mat", ""])))[0])}
    slices["asks"] = slices["one"][0], 0 * slices["one"][1]
    rows = sorted(((r["bucket"], name, r["keys"], r["times"]) for name, (key, n) in slices.items() for r in C._bucket_rows(C.WORDS, key, n).to_pylist()))
    batch = C.pa.RecordBatch.from_arrays([C.pa.array([name for _, name, _, _ in rows]), C.pa.array([C.WORDS] * len(rows)),
                                          *(C.pa.array([r[k] for r in rows]) for k in (0, 2, 3))], ["slice", *C._PAIRS])
    found = defaultdict(list)
    for answers in C._answers(iter([batch])):
        for r in answers.to_pylist():
            found[r["slice"]] += [C._from_planes(r["odds"]).tolist()]
    assert np.sum(found.pop(C.TOTALS), axis=0).tolist() == [5, 3]           # words, and distinct ones
    assert {name: sorted(sum(n, [])) for name, n in found.items()} == {"one": [1, 3], "two": [1, 3], "asks": [1, 3]}
