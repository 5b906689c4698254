"""Streams over several micro-batches: merged moments, retries, and a job that is lost on the way."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from tests.oracle import compare, connect

from hourmart.catalogue import stream_queries
from hourmart.catalogue.bindings import HOUR
from hourmart.model import Panel
from hourmart.operators.stats import daily_stats, merged_moments, moments, stats_of_moments
from hourmart.sources.tables import Warehouse
from hourmart.streaming.daily import merge_batch

SF = "/root/testdata/sf0.001"
PANEL = Panel("entity", "full_date", None, (("temp", "temp"), ("rain", "rain")))


def readings(spark, seed: int, n: int, days: int = 4):
    rnd = random.Random(seed)
    rows = [(rnd.choice("ab"), date(2024, 1, 1) + timedelta(days=rnd.randrange(days)), rnd.choice([None, 1e6 + rnd.random()]),
             rnd.choice([None, rnd.random()])) for _ in range(n)]
    return spark.createDataFrame(rows, "entity string, full_date date, temp double, rain double")


def rounded(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.collect())


def stats(rows):
    return rounded(daily_stats(rows, PANEL).select(stats_of_moments(moments(rows, PANEL), PANEL).columns))


def test_merged_moments_are_those_of_all_rows(spark):
    a, b, none = readings(spark, 1, 40), readings(spark, 2, 7), readings(spark, 3, 0)
    both = a.unionByName(b)
    for old, new, whole in ((a, b, both), (a, none, a), (none, b, b)):
        merged = merged_moments(moments(old, PANEL), moments(new, PANEL), PANEL)
        assert rounded(stats_of_moments(merged, PANEL)) == stats(whole)


def test_batches_lost_half_way_are_merged_once(spark, tmp_path):
    store, parts = Warehouse(spark, str(tmp_path)), [readings(spark, s, 30) for s in range(3)]
    merge_batch(store, "stats", parts[0], 0, PANEL)
    before = store.read("stats").collect()
    merge_batch(store, "stats", parts[1], 1, PANEL)
    # one day as it was before batch 1, as if the job had been lost before that day was replaced
    day = date(2024, 1, 2)
    store.overwrite_partitions("stats", spark.createDataFrame(
        [r for r in before if r.full_date == day], store.read("stats").schema), ["full_date"])
    for _ in range(2):
        merge_batch(store, "stats", parts[1], 1, PANEL)
    merge_batch(store, "stats", parts[2], 2, PANEL)
    merge_batch(store, "stats", readings(spark, 9, 0), 3, PANEL)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = store.read("stats")
    assert rounded(stats_of_moments(found, PANEL)) == stats(whole)
    assert found.count() == whole.select("entity", "full_date").distinct().count()


def test_output_does_not_grow_with_batches(spark, monkeypatch):
    kept, run = [], stream_queries.run_moments

    def watched(stream, panel, store, *rest):
        kept.append(store)
        run(stream, panel, store, *rest)

    monkeypatch.setattr(stream_queries, "run_moments", watched)
    stream_queries.q_stream_moments(spark, SF).collect()
    table = kept[0].read("stats")
    events = spark.read.parquet(f"{SF}/events.parquet")
    groups = events.select("event_type", F.to_date("ts")).distinct().count()
    assert table.count() == groups and table.agg(F.max("merged_upto")).first()[0] == stream_queries.PIECES - 1


def test_a_lost_job_goes_on_from_its_checkpoint(spark, monkeypatch):
    runs, run = [], stream_queries.run_ingest

    def watched(*args):
        try:
            run(*args)
            runs.append("whole")
        except StreamingQueryException:
            runs.append("lost")
            raise

    monkeypatch.setattr(stream_queries, "run_ingest", watched)
    found = stream_queries.q_stream_restart(spark, SF)
    assert runs == ["lost", "whole"]
    assert compare(found, connect(SF), stream_queries.ORACLES["stream_restart"]) is None


@pytest.mark.parametrize("panel", [HOUR])
def test_panels_without_rain_have_moments_too(spark, panel):
    rows = spark.createDataFrame([("a", date(2024, 1, 1), 2.0), ("a", date(2024, 1, 1), 4.0)], "entity string, full_date date, value double")
    assert [tuple(r)[2:] for r in stats_of_moments(moments(rows, panel), panel).collect()] == [(3.0, pytest.approx(2 ** 0.5), 2.0, 4.0)]
