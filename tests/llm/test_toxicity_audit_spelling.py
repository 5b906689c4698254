"""Toxicity, filter audit and spelling variants against plain versions, and on awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm import filter_audit, importance_rules, queries, spelling, toxicity
from tests.llm.cases import words_of

LARGER = "/root/testdata/sf0.1"        # toxic words of the rarer languages are too few below
DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


# ---------------------------------------------------------------- quality rules
def test_a_filter_on_the_rules_repeats_no_work(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    found = importance_rules.quality_rules(docs, labels)
    plan = found.filter("not base_failed and n_words > 3").join(labels, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 0 and found.count() == docs.count()


# ---------------------------------------------------------------- toxicity
def plain_sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    found = []
    for piece in re.finditer(r"[^.!?\n]+", text or ""):
        words = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", piece.group()))
        if words:
            found.append((piece.start() + words[0].start(), piece.start() + words[-1].end(), {w.group() for w in words}))
    return found


def fold(word: str) -> str:
    return word.translate({c: c + 32 for c in range(65, 91)})


def bucket(word: str) -> int:
    data = np.frombuffer(fold(word).encode(), np.uint8)
    h = B.SpanHasher(data, B.FOLDED_VALUES)(np.array([0]), np.array([len(data)])) ^ toxicity._KINDS[0]
    return int(h[0] >> np.uint64(64 - toxicity.BUCKET_BITS))


def scorer_for(weights: dict[str, float]) -> toxicity.NoisyOr:
    by_bucket = {bucket(w): v for w, v in weights.items()}
    made = toxicity.NoisyOr(np.array(sorted(by_bucket)))
    made.weights[:-1] = [by_bucket[k] for k in sorted(by_bucket)]
    return made


def test_scores_and_spans_against_plain_sentences(spark, docs, rows_in, none):
    weights = {"the": 1.5, "thing3": 9.0, "été": 3.0, "word": 7.0, "4711": -2.0, "line": 6.5}
    scorer, labels = scorer_for(weights), spark.createDataFrame([], LABELS)
    found = Counter()
    for r in toxicity.toxicity(docs, labels, scorer).collect():
        found[r.doc_id, round(r.score, 9), r.predicted, r.n_sentences, tuple((s.start, s.length, round(s.score, 9)) for s in r.offending)] += 1
    expected = Counter()
    for row in rows_in:
        parts = plain_sentences(row[1])
        odds = [toxicity.FIRST_BIAS + sum(weights.get(w, 0) for w in {fold(w) for w in p[2]}) for p in parts]
        each = [1 / (1 + np.exp(-o)) for o in odds] or [1 / (1 + np.exp(-toxicity.FIRST_BIAS))]
        score = 1 - np.prod([1 - p for p in each])
        spans = tuple((a, b - a, round(p, 9)) for (a, b, _), p in zip(parts, each) if p >= 0.5)
        expected[row[0], round(score, 9), int(score >= 0.5), len(parts), spans] += 1
    assert found == expected
    assert any(spans for *_, spans in expected)
    assert toxicity.toxicity(none, labels, scorer).count() == 0


def test_gradients_of_the_noisy_or():
    rng = np.random.default_rng(2)
    texts = B.texts_of(pa.array(["a b. b c! d", "c", "", "a d. e e"]))
    bags, label, share = toxicity.sentences(texts), np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    scorer = toxicity.NoisyOr(np.unique(bags.bucket))
    scorer.weights, scorer.bias = rng.normal(size=len(scorer.weights)), -0.7

    def loss() -> float:
        score = scorer.scores(bags)[0]
        return float((-np.where(label > 0, np.log(score), np.log(1 - score)) * share).mean())

    by_weight, by_bias = scorer.gradients(scorer.slots(bags.bucket), bags.sentence, bags.owner, label, share)
    for k in range(len(scorer.weights)):
        scorer.weights[k] += 1e-6
        up = loss()
        scorer.weights[k] -= 2e-6
        assert (up - loss()) / 2e-6 == pytest.approx(by_weight[k], abs=1e-6)
        scorer.weights[k] += 1e-6
    scorer.bias += 1e-6
    up = loss()
    scorer.bias -= 2e-6
    assert (up - loss()) / 2e-6 == pytest.approx(by_bias, abs=1e-6)


def test_toxicity_on_the_held_out_fold(spark):
    labels = queries.table(spark, LARGER, "labels")
    found = queries.op11_toxicity(spark, LARGER).filter("held_out").join(labels, "doc_id")
    caught = {r[0]: r[1] for r in found.groupBy("toxic").agg(F.avg("predicted")).collect()}
    assert caught[1] > 0.85 and caught[0] < 0.01


def test_offending_sentences_are_those_planted(spark):
    rnd = random.Random(4)
    plain = [f"w{i}" for i in range(200)]
    rows, marks, planted = [], [], {}
    for i in range(400):
        parts = [" ".join(rnd.choice(plain) for _ in range(8)) for _ in range(rnd.randint(1, 20))]
        bad = rnd.randrange(len(parts)) if i % 4 == 0 else None
        if bad is not None:
            parts[bad] += " vile"
            planted[i] = bad
        rows.append((i, ". ".join(parts) + "é.", "s"))
        marks.append((i, 1, int(bad is not None)))
    docs, labels = spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(marks, LABELS)
    text = {r[0]: r[1] for r in rows}
    spans = {}
    for r in toxicity.toxic_sentences(docs, labels).collect():
        spans.setdefault(r.doc_id, []).append(text[r.doc_id][r.start:r.start + r.length])
    assert set(spans) == set(planted)
    assert all(len(s) == 1 and s[0].endswith(("vile", "vileé")) for s in spans.values())


def test_toxicity_without_labels(spark, docs):
    found = toxicity.toxicity(docs, spark.createDataFrame([], LABELS)).filter("n_sentences < 2").collect()
    assert {round(r.score, 12) for r in found} == {round(float(1 / (1 + np.exp(-toxicity.FIRST_BIAS))), 12)}
    assert {r.predicted for r in found} == {0}


def test_repeated_labels_and_rows_are_learned_from_once(spark, docs, rows_in):
    marks = [(r[0], 1, k % 2) for k, r in enumerate(rows_in)] * 3 + [(None, 1, 1), (3, 1, None), (10 ** 6, 1, 1)]
    a, b = (Counter((r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(x, spark.createDataFrame(marks, LABELS)).collect())
            for x in (docs, docs.repartition(5)))
    assert a == b and all(0 <= score <= 1 for _, score in a)


# ---------------------------------------------------------------- filter audit
def plain_audit(rows: list[tuple], marks: list[tuple]) -> Counter:
    first, good, toxic = {}, set(), set()
    for doc_id, text, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(doc_id, first.get(text or "", doc_id))
    for doc_id, quality, bad in marks:
        if doc_id is not None:
            good |= {doc_id} if quality == 1 else set()
            toxic |= {doc_id} if bad == 1 else set()
    judged = []
    for doc_id, text, source in rows:
        text = text or ""
        w = words_of(text)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "D" * any(c in "#$%&*|" for c in text)
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "E" * (doc_id is not None and doc_id > first[text])
        judged.append((source or "", fails, doc_id in good, doc_id in toxic))
    found = Counter()
    for part in {j[0] for j in judged}:
        own, rows_of, shares = [j[1:] for j in judged if j[0] == part], [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [j for j in left if letter in j[0]]
                left = [j for j in left if letter not in j[0]]
                shares[letter] += len(gone)
                rows_of.append((part, order, step, len(left), len(gone), sum(letter in j[0] for j in own) - len(gone),
                                sum(j[0] == letter for j in own), sum(j[1] for j in gone), sum(j[2] for j in gone)))
        for r in rows_of:
            found[(*r, shares[r[1][r[2] - 1]])] += 1
    return found


def test_audit_against_plain_filters(spark, docs, rows_in, none):
    rnd = random.Random(3)
    rows = [(r[0], r[1], r[3]) for r in rows_in] + [(900 + i, "WORD a # b c", rnd.choice(["", None, "x"])) for i in range(30)]
    marks = [(r[0], rnd.choice([0, 1, None]), rnd.choice([0, 1])) for r in rows[:60]] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    made = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("digest", "part", "mask", "n", "steps", "good")})
    labels = spark.createDataFrame(marks, LABELS)
    names = ["part", "filter_order", "step", *filter_audit._COUNTS, "shapley"]
    found = filter_audit.filter_audit(made.repartition(4), labels)
    assert found.columns == names
    assert Counter(tuple(r) for r in found.collect()) == plain_audit(rows, marks)
    assert filter_audit.filter_audit(none, labels).count() == 0


def test_every_order_is_named_once(spark):
    found = spark.range(1).select(filter_audit.all_orders().alias("o")).first().o
    assert found == sorted(map("".join, permutations("ABCDE")))


# ---------------------------------------------------------------- spelling
def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def plain_variants(rows: list[tuple]) -> set[tuple]:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = fold(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, found in close.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None

    def root(w: str) -> str:
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(close[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def variants_of(df) -> list[tuple]:
    return [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]


def test_variants_against_all_pairs(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcéÿ×") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    base += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abcde", "abcd", "éabcd", "abcdé", "z" * 63, "z" * 64, "z" * 65, "z" * 66, "z" * 64 + "a",
             "z" * 30 + "y" + "z" * 33, "z" * 30 + "y" + "z" * 34, "z" * 70 + "ab" + "z" * 3000, "z" * 70 + "ab" + "z" * 3001, "z" * 70 + "aé" + "z" * 3000]
    for w in base[:40]:
        at, c = rnd.randrange(len(w)), rnd.choice("abcé")
        base.append(rnd.choice([w[:at] + w[at + 1:], w[:at] + c + w[at:], w[:at] + c + w[at + 1:]]))
    often = [rnd.choice([1, 1, 3, 12]) for _ in base]
    rows = [(i, rnd.choice([" ", ", ", "\n", "1"]).join(rnd.choices(base, often, k=40))) for i in range(60)]
    rows += [(i, " ".join(w.upper() if w.isascii() else w for w in base)) for i in range(100, 103)]
    rows += [(None, " ".join(base)), (5, None), (6, ""), rows[0], rows[0]]
    made = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "near", "level", "run")})
    found = variants_of(spelling.spelling_variants(made.repartition(3)))
    expected = plain_variants(rows)
    assert len(found) == len(set(found)) and set(found) == expected
    assert sum(1 for r in expected if r[1]) > 20 and any(r[1] and r[1] != r[2] for r in expected)


def test_variants_of_awkward_rows(spark, docs, rows_in, none):
    assert set(variants_of(spelling.spelling_variants(docs))) == plain_variants([r[:2] for r in rows_in])
    assert spelling.spelling_variants(none).count() == 0
