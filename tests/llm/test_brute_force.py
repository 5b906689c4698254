"""Operators against plain versions of their contracts on awkward rows, and on empty tables."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourmart.llm import (
    context_mixing, decontaminate, edit_counts, importance_rules, language_id, near_dedup, quality_mil, records, suffix_dedup, word_bpe,
)
from tests.llm.cases import folded, words_of

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def shingle_set(text):
    w = words_of(folded(text))
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def components_of(rows):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(rows))]


def test_near_duplicates(docs, rows_in):
    sets, root = components_of(rows_in)
    expected = Counter()
    for i, r in enumerate(rows_in):
        ids = [x[0] for x, o in zip(rows_in, root) if o == root[i] and x[0] is not None]
        low = min(ids) if ids and sets[i] else r[0]
        expected[(r[0], len(sets[i]), low, r[0] is not None and r[0] == low)] += 1
    assert counted(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_one_row_of_each_component_stays(docs, rows_in):
    kept = near_dedup.deduplicated(docs)
    assert kept.schema == docs.schema
    sets, root = components_of(rows_in)
    found = kept.collect()
    assert len([r for r in found if shingle_set(r.text)]) == len({o for s, o in zip(sets, root) if s})


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 1 << 62, 300, dtype=np.uint64), rng.integers(0, 1 << 62, 100, dtype=np.uint64)
    a, b = np.concatenate([common, own[:50]]), np.concatenate([common, own[50:]])
    rows = near_dedup.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 350, 700, 701]))
    assert abs((rows[0] == rows[1]).mean() - 0.75) < 0.08
    assert (rows != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_a_pair_stays_if_an_earlier_band_agrees_in_low_bytes_only(spark):
    import pyarrow as pa

    full = np.arange(2 * near_dedup.SIZE, dtype=np.uint64).reshape(2, -1) << np.uint64(8)      # all low bytes agree, so all pass
    full[1, near_dedup.BAND:] = full[0, near_dedup.BAND:]              # the bands are shared, but for the first
    keys = near_dedup.band_keys(full[:, :near_dedup.BANDED])
    assert (keys[0] == keys[1]).tolist() == [False] + [True] * (near_dedup.BANDED // near_dedup.BAND - 1)
    number = 1
    group = pa.RecordBatch.from_pydict({
        "band": [int(keys[0, number].view(np.int64))] * 2, "i": [0, 0], "j": [0, 0], "number": [number] * 2, "own": [0, 0], "set_key": [7, 5],
        "label": [7, 5], "distance": [0.2, 0.2], "sketch": [x.tobytes() for x in full.astype(np.uint8)],
        "bands": keys.view(np.int64).tolist()})
    later = group.set_column(0, "band", pa.array([int(keys[0, number + 1].view(np.int64))] * 2))
    assert not sum(x.num_rows for x in near_dedup._pairs_of(iter([later])))         # it comes once
    found = [(a, b) for x in near_dedup._pairs_of(iter([group])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())]
    assert found == [(5, 7)]


def test_contamination(spark, docs, rows_in):
    items = [(1, rows_in[40][1]), (2, " ".join(rows_in[46][1].split()[10:25])), (10, "end"), (11, "..."), (12, None), (None, "été"), (2, "of the")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def words(text):
        return words_of("".join(c if c.isalnum() and c.isascii() or ord(c) > 127 else " " for c in folded(text)))

    expected = Counter()
    for r in rows_in:
        w, hit, names = words(r[1]), set(), set()
        for name, text in items:
            x = words(text)
            n = min(len(x), 10)
            for k in range(len(x) - n + 1 if x else 0):
                for i in range(len(w) - n + 1):
                    if w[i:i + n] == x[k:k + n]:
                        hit |= set(range(i, i + n))
                        names |= {str(name)} if name is not None else set()
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected[(r[0], len(w), len(hit), len(names), digest, len(hit) > 0)] += 1
    found = decontaminate.contamination(docs, benchmark)
    assert counted(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    clean = decontaminate.decontaminated(docs, benchmark)
    assert clean.schema == docs.schema
    assert clean.count() == sum(n for k, n in expected.items() if not k[-1])


def test_blocks_of_items_give_the_same(spark, docs, rows_in, monkeypatch):
    benchmark = spark.createDataFrame([(i, rows_in[i][1]) for i in range(30, 48)], "item_id long, text string")
    columns = ["doc_id", "n_hit", "n_items", "items_sha256", "longest_match"]
    whole = counted(decontaminate.contamination(docs, benchmark), *columns)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert counted(decontaminate.contamination(docs, benchmark), *columns) == whole


def test_base_scores(docs, rows_in):
    def tokens(text):
        return words_of(folded(text)) + [None]

    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows_in]
    counts = Counter(t for r, h in zip(rows_in, held) if not h for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for r, h in zip(rows_in, held):
        w = tokens(r[1])
        base = sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        expected[(r[0], h, len(w), sum(counts[t] > 0 for t in w), n, round(base, 5))] += 1
    found = context_mixing.language_scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == expected
    assert all(r.score < 0 and math.isfinite(r.score) for r in found)


def test_bit_probabilities_sum_to_one():
    from hourmart.llm import batches as B
    import pyarrow as pa

    tables = [np.random.default_rng(k).integers(-90, 90, 1 << context_mixing.TABLE_BITS).astype(np.int8) for k in range(context_mixing.CONTEXTS)]
    # the empty text and all texts that begin with one of 127 bytes share what 7 of 8 bits leave
    one = np.exp(context_mixing.log_probabilities(B.texts_of(pa.array([""])), tables))[0]
    two = np.exp(context_mixing.log_probabilities(B.texts_of(pa.array([chr(c) for c in range(1, 128)])), tables))
    assert 0 < one < 1 and 0 < two.sum() < 1


def test_scores_do_not_depend_on_neighbours():
    from hourmart.llm import batches as B
    import pyarrow as pa

    tables = [np.random.default_rng(k).integers(-90, 90, 1 << context_mixing.TABLE_BITS).astype(np.int8) for k in range(context_mixing.CONTEXTS)]
    texts = ["one text", "", "another text " * 100, "é"]
    together = context_mixing.log_probabilities(B.texts_of(pa.array(texts)), tables)
    alone = [context_mixing.log_probabilities(B.texts_of(pa.array([t])), tables)[0] for t in texts]
    assert np.allclose(together, alone)


def test_tables_grow_with_the_states(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    from hourmart.llm import batches as B
    from hourmart.llm.staging import Steps

    rng = np.random.default_rng(3)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 2000)) + "ab" * 3000 for _ in range(20)] + ["", None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    tables = context_mixing.bit_model(rows, Steps(spark))
    streams = [context_mixing.Stream(B.texts_of(pa.array([t], pa.string()))) for t in texts]
    for k in range(context_mixing.CONTEXTS):
        counts = Counter((int(c) >> 8, node) for s in streams for c, x in zip(s.contexts[k], s.data)
                         for node in ((int(x) | 256) >> j for j in range(8, 0, -1)))
        assert 1 << tables.bits[k] >= 2 * len(counts)
    assert len(set(tables.bits)) > 1 and len(tables.bits) == 5
    whole = B.texts_of(pa.array(texts, pa.string()))
    scores = context_mixing.log_probabilities(whole, tables)
    monkeypatch.setattr(context_mixing, "HELD_BYTES", 1000)        # read part by part
    parted = context_mixing.Tables(tables.files, tables.bits)
    assert np.array_equal(context_mixing.log_probabilities(whole, parted), scores) and parted.rest


def test_token_records(docs, rows_in):
    tokenizer = Tokenizer.from_file(BYTES)
    found = records.token_records(docs, BYTES).collect()
    expected = Counter()
    for r in rows_in:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        expected[(r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])


@pytest.fixture
def small_files(spark):
    """Small inputs keep several files."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_records_in_shuffled_order(spark, docs, rows_in, tmp_path, monkeypatch, small_files):
    monkeypatch.setattr(records, "OPEN_FILES", 2)
    folder, index = f"{tmp_path}/files", f"{tmp_path}/index"
    records.write_records(docs, BYTES, folder, index)
    rows, width = spark.read.parquet(index), records._encoder(BYTES)[1]
    assert rows.select("part").distinct().count() > 2
    order = records.shuffled(rows, 5)
    found, places = records.fetch(order, folder, width).collect(), order.collect()
    assert [(r.part, r.offset, r.doc_id) for r in found] == [(r.part, r.offset, r.doc_id) for r in places]
    assert places == records.shuffled(rows, 5).collect() != records.shuffled(rows, 6).collect()
    tokenizer = Tokenizer.from_file(BYTES)
    expected = Counter((r[0], *tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0) for r in rows_in)
    assert Counter((r.doc_id, *r.ids) for r in found) == expected
    some = rows.filter("doc_id % 7 = 3")
    assert counted(records.fetch(some, folder, width), "part", "offset") == counted(some, "part", "offset")
    assert records.fetch(rows.limit(0), folder, width).collect() == []
    with pytest.raises(Exception, match="the index does not fit the files|checksum"):
        records.fetch(rows.withColumn("length", F.col("length") + 1), folder, width).collect()


def test_files_are_read_back_by_a_task_each(spark, docs, tmp_path, small_files):
    folder, index = f"{tmp_path}/files", f"{tmp_path}/index"
    records.write_records(docs, BYTES, folder, index)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = spark.read.parquet(index).select("part").distinct().count()
    found = records.read_records(spark, folder, index, records._encoder(BYTES)[1])
    assert files > 2 and found.groupBy(F.spark_partition_id()).count().count() == files


def test_checksums():
    def plain(data):
        c = 0xFFFFFFFF
        for x in data:
            c ^= x
            for _ in range(8):
                c = (c >> 1) ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    assert plain(b"123456789") == 0xE3069283
    data = np.random.default_rng(1).integers(0, 256, 9000).astype(np.uint8)
    spans = [(0, 9), (3, 259), (3, 260), (100, 9000), (5, 9), (256, 768)]
    a, b = (np.array(x) for x in zip(*spans))
    assert records.crc32c(data, a, b).tolist() == [plain(data[x:y].tobytes()) for x, y in spans]
    raw, at = records.frame(data, np.array([0, 20, 20 + 8, 9000]))
    starts, ends, done = records.unframe(raw)
    assert done == len(raw) and [raw[x:y].tobytes() for x, y in zip(starts, ends)] == [data[:20].tobytes(), data[20:28].tobytes(), data[28:].tobytes()]
    raw[at[1] + 13] ^= 1
    with pytest.raises(ValueError):
        records.unframe(raw)


def plain_repeats(rows):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    counts = Counter(t[i:i + 400] for _, t in texts for i in range(len(t) - 399))
    for doc_id, t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        spans = sum(bool(gone[i] and (i == 0 or not gone[i - 1])) for i in range(len(t)))
        yield doc_id, len(t), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(t, gone) if not g)).hexdigest()


def test_repeated_bytes(docs, rows_in):
    found = suffix_dedup.repeated_bytes(docs)
    assert counted(found, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == Counter(plain_repeats(rows_in))
    cut = suffix_dedup.without_repeats(docs)
    assert cut.schema == docs.schema and cut.count() == len(rows_in)


def test_the_pipeline_cuts_repeated_passages_of_51_words(spark, docs):
    import corpus_pipeline

    words = [f"{c}{d}{c}{d}" for c in "bcdfghj" for d in "aeiouxyz"][:51]
    passage = " ".join(words)
    assert corpus_pipeline.PASSAGE < len(passage) < 260
    texts = [f"{a * 30} {passage} {b * 30}" for a, b in (("1", "2"), ("3", "4"))] + ["5" * 500, passage[:230] + "6" * 90]
    rows = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    stage = dict(corpus_pipeline.STAGES)["suffix_dedup"]
    size, encoded = corpus_pipeline.PASSAGE, [t.encode() for t in texts]
    counts = Counter(t[i:i + size] for t in encoded for i in range(len(t) - size + 1))
    expected = {}
    for doc_id, t in enumerate(encoded):
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if counts[t[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        expected[doc_id] = bytes(x for x, g in zip(t, gone) if not g).decode()
    found = {r.doc_id: r.text for r in stage(spark, rows, "").collect()}
    assert found == expected and passage not in found[0] + found[1] and found[3] == texts[3]


def test_only_chosen_suffixes_get_a_row_for_each_start(spark, monkeypatch):
    """A filter that lets all suffixes pass, as one does that is full, costs a row for each of them and no more."""
    written, keep, made, rng = {}, suffix_dedup.Steps.keep, suffix_dedup.Filter.__init__, random.Random(5)
    letters = lambda n: "".join(rng.choices("abcdefghij ", k=n))      # noqa: E731
    passage = letters(450)
    texts = [letters(3000) for _ in range(20)] + [letters(700) + passage + letters(rng.randint(0, 500)) for _ in range(4)]
    rows = list(enumerate(texts)) + [(30, passage), (31, None), (32, ""), (20, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    expected = Counter(plain_repeats(rows))

    def counting(self, df, name, *args, **kwargs):
        step = keep(self, df, name, *args, **kwargs)
        written[name] = step.count()
        return step

    def full(self, hashes):
        made(self, hashes)
        self.words[:] = 0xFFFFFFFF

    monkeypatch.setattr(suffix_dedup.Steps, "keep", counting)
    assert counted(suffix_dedup.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    exact = dict(written)
    monkeypatch.setattr(suffix_dedup.Filter, "__init__", full)
    assert counted(suffix_dedup.repeated_bytes(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected
    assert written["suffixes"] > 2 * exact["suffixes"] and 0 < written["pairs"] == exact["pairs"]


def test_filters_grow_with_their_hashes(spark):
    n = 6_000_000
    hashes = spark.range(0, n, 1, 8).select(F.shiftrightunsigned(F.xxhash64("id"), 6).alias("hash"))      # uneven highest bits
    found = suffix_dedup.Filter(hashes)
    own = hashes.limit(1000).toPandas().hash.to_numpy().view(np.uint64)
    others = spark.range(n, n + 100_000).select(F.shiftrightunsigned(F.xxhash64("id"), 6).alias("hash")).toPandas().hash.to_numpy().view(np.uint64)
    assert found.has(own).all() and found.has(others).mean() < 0.02
    assert len(suffix_dedup.Filter(hashes.limit(0)).words) < len(found.words) <= 1 << (suffix_dedup.FILTER_BITS - 5)


def test_word_bpe(docs, rows_in):
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = Counter()
    for r in rows_in:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += 1
    assert counted(word_bpe.bpe_round_trip(docs, WORDS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_pair_check_agrees_with_merging():
    bpe = word_bpe.WordBpe(WORDS)
    rng = np.random.default_rng(2)
    open_tokens = np.array([i for s, i in bpe.proposals.items() if not s.endswith(word_bpe.WORD_END)])
    a, b = rng.choice(open_tokens, 4000), rng.choice(list(bpe.proposals.values()), 4000)
    plain = [bpe.merged(bpe.symbols(bpe.strings[x]) + bpe.symbols(bpe.strings[y])) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == plain
    long = [bpe.vocab[c] for c in "thethingandthenotherthing" * 4]
    assert bpe._merged_long(long) == bpe.merged(long[:0] + long) and len(long) > word_bpe.SHORT


def test_edit_counts_match_counting_anew():
    import random

    counter = edit_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rnd = random.Random(5)

    def text(n):
        return "".join(rnd.choice("abcde 'strel'   \n\t01234!?é中") for _ in range(rnd.randint(0, n)))

    for _ in range(600):
        x = text(rnd.choice([5, 60, 900]))
        tree = edit_counts.CountTree(x, counter)
        for _ in range(rnd.randint(1, 5)):
            a = rnd.randint(0, len(x))
            b, new = min(len(x), a + rnd.choice([0, 2, 40, 300])), text(rnd.choice([0, 3, 40]))
            tree.edit(a, b, new)
            x = x[:a] + new + x[b:]
        assert tree.text() == x
        assert tree.tokens[1] == len(counter.encoding.encode_ordinary(x)) and tree.pieces[1] == len(counter.pattern.findall(x))


def test_edited_counts_of_a_table(docs, rows_in):
    found = edit_counts.edited_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    counter = edit_counts.Counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

    def tokens(text):
        return len(counter.encoding.encode_ordinary(text))

    expected = Counter((r[0], tokens(r[1] or ""), len(edit_counts.MASKED.findall(r[1] or "")), tokens(edit_counts.MASKED.sub("<masked>", r[1] or "")))
                       for r in rows_in)
    assert counted(found, "doc_id", "n_tokens", "n_edits", "n_tokens_after") == expected


def test_masking_is_counted():
    text = "write to someone.else@example.org or 4785380592391139, key " + "0a" * 20
    assert [text[a:b] for a, b, _ in edit_counts.masking_edits(text)][::-1] == ["someone.else@example.org", "4785380592391139", "0a" * 20]


def test_quality_rules_base(spark, docs, rows_in):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 40, 2)] + [(1, 1), (1, 1), (3, 1), (None, 1)], "doc_id long, quality int")
    expected = Counter()
    for r in rows_in:
        text = r[1] or ""
        w = words_of(text)
        windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words_of(x)]
        expected[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again),
                  len(w) < 20 or 100 * len(again) > 30 * len(w))] += 1
    found = importance_rules.quality_rules(docs, labels)
    assert counted(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert not [r for r in found.collect() if r.kept and r.base_failed]


def test_languages_of_awkward_rows(docs, rows_in):
    found = language_id.languages(docs).collect()
    assert len(found) == len(rows_in)
    by_text = {(r[0], r[1]) for r in rows_in if r[1] is None or not any(map(str.isalpha, r[1]))}
    assert sum(r.lang_pred == "und" for r in found) == sum((r[0], r[1]) in by_text for r in rows_in)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "fr", "und") for r in found)
    assert language_id.identified(docs).schema == docs.schema


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (near_dedup.near_duplicates(none), near_dedup.deduplicated(none), decontaminate.contamination(none, benchmark),
               decontaminate.decontaminated(none, benchmark), context_mixing.language_scores(none), records.token_records(none, BYTES),
               suffix_dedup.repeated_bytes(none), suffix_dedup.without_repeats(none), language_id.languages(none), language_id.identified(none),
               quality_mil.quality_scores(none, labels), word_bpe.bpe_round_trip(none, WORDS), importance_rules.quality_rules(none, labels),
               edit_counts.edited_counts(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)):
        assert df.collect() == []


def test_nothing_to_learn_from(spark, docs, rows_in):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in language_id.languages(unlabelled).collect()} == {"und"}
    lettered = sum(any(map(str.isalpha, r[1] or "")) for r in rows_in)      # these stay though nothing was learned
    assert language_id.identified(unlabelled).count() == lettered
    assert language_id.identified(unlabelled.withColumn("lang", F.lit("en"))).count() == lettered
    scores = quality_mil.quality_scores(docs, labels).collect()
    assert len(scores) == len(rows_in) and all(0 <= r.score <= 1 for r in scores)
    rules = importance_rules.quality_rules(docs, labels).collect()
    assert all(r.kept != r.base_failed for r in rules)


def test_columns_may_have_any_names(docs):
    names = ("run_first", "run_key", "RUN_LAST", "row_key_", "run_key_", "row_key")
    named = docs.withColumns({c: F.lit(7) for c in names})
    cut, deduplicated = suffix_dedup.without_repeats(named, length=60), near_dedup.deduplicated(named)
    plain_cut, plain = suffix_dedup.without_repeats(docs, length=60), near_dedup.deduplicated(docs)
    for found, other in ((cut, plain_cut), (deduplicated, plain)):
        assert found.columns == named.columns
        rows = found.collect()
        assert all(r[c] == 7 for r in rows for c in names)
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in other.collect())
