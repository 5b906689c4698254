"""Held-out accuracy of the trained operators, SQL checks, and the pipeline's stages."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourmart.llm import queries
from tests.llm.test_brute_force import components_of
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


def test_language_accuracy_on_the_held_out_fold(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "lang")
    found = queries.op6_language_id(spark, SF).filter("held_out").join(docs, "doc_id")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_quality_on_the_held_out_fold(spark):
    labels = queries.table(spark, SF, "labels")
    found = queries.op7_quality_mil(spark, SF).filter("held_out").join(labels, "doc_id")
    mean = {r[0]: r[1] for r in found.groupBy("quality").agg(F.avg("score")).collect()}
    assert mean[1] - mean[0] > 0.4
    assert found.filter("quality = 1").agg(F.avg("predicted")).first()[0] > 0.95


def test_ratio_rules_keep_good_documents(spark):
    labels = queries.table(spark, SF, "labels").filter("toxic = 0")
    found = queries.op10_quality_rules(spark, SF).filter("not base_failed").join(labels, "doc_id")
    share = {r[0]: r[1] for r in found.groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share[1] > 0.99 and share[0] < 0.2


def test_scores_beat_chance_by_far(spark):
    found = queries.op3_context_mixing(spark, SF)
    assert found.filter("held_out").agg(F.avg("bits_per_byte")).first()[0] < 3.0


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = queries.table(spark, SF, "documents").filter("doc_id < 120")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, SF, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    stage = dict(corpus_pipeline.STAGES)
    _, root = components_of(data)
    kept = stage["near_dedup"](spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in kept) == sorted(min(d[0] for d, o in zip(data, root) if o == x) for x in set(root))
    counts = Counter(r.text.encode()[i:i + 400] for r in kept for i in range(len(r.text.encode()) - 399))
    cut = stage["suffix_dedup"](spark, spark.createDataFrame(kept, docs.schema), str(tmp_path)).collect()
    before = {r.doc_id: r.text.encode() for r in kept}
    for r in cut:
        t = before[r.doc_id]
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if counts[t[i:i + 400]] > 1:
                gone[i:i + 400] = b"\1" * 400
        assert r.text == bytes(x for x, g in zip(t, gone) if not g).decode(errors="ignore")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in kept}
