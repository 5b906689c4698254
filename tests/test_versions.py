"""Whole versions of a table: what readers see during, after and without a finished refresh."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from hourmart.sources.tables import Warehouse


@pytest.fixture
def store(spark, tmp_path):
    return Warehouse(spark, str(tmp_path))


def rows(spark, n: int):
    return spark.range(n).withColumn("year", (F.col("id") % 3).cast("int"))


def test_a_reader_goes_on_with_the_version_it_began_with(spark, store):
    store.refresh("t", rows(spark, 10), ["year"])
    reader = store.read("t").where("id < 5")
    for n in (20, 30):
        store.refresh("t", rows(spark, n), ["year"])
    assert reader.count() == 5 and store.read("t").count() == 30
    assert [n for n, _ in store.commits("t")] == [0, 1, 2]


def test_a_table_may_be_refreshed_from_itself(spark, store):
    store.refresh("t", rows(spark, 10))
    store.refresh("t", store.read("t").unionByName(store.read("t")))
    assert store.read("t").count() == 20


@pytest.mark.parametrize("lost_in", ["write", "commit"])
def test_a_lost_job_leaves_one_whole_version(spark, store, monkeypatch, lost_in):
    store.refresh("t", rows(spark, 10))
    with monkeypatch.context() as m, pytest.raises(Exception, match="lost"):
        if lost_in == "commit":
            def lose(*_):
                raise RuntimeError("lost")
            m.setattr(Warehouse, "_commit", lose)
            store.refresh("t", rows(spark, 99))
        else:
            broken = rows(spark, 99).withColumn("id", F.when(F.col("id") == 98, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
            store.refresh("t", broken)
    assert store.read("t").count() == 10
    store.refresh("t", rows(spark, 7))
    assert store.read("t").count() == 7


def test_two_writers_with_one_number_give_one_of_both(spark, store):
    store.refresh("t", rows(spark, 1))
    versions = [store._new_version() for _ in range(2)]
    for n, v in zip((5, 6), versions):
        rows(spark, n).write.parquet(f"{store.home('t')}/{v}")
    for v in versions:      # both saw commit 0 as the last
        files, marker = store._hadoop(f"{store.home('t')}/_commits/{1:012d}.{v}")
        files.create(marker, False).close()
    assert store.read("t").count() == (5, 6)[versions.index(max(versions))]
    store.refresh("t", rows(spark, 8))
    assert store.read("t").count() == 8


def test_vacuum_keeps_the_newest_versions(spark, store, tmp_path):
    for n in (1, 2, 3, 4):
        store.refresh("t", rows(spark, n))
    rows(spark, 9).write.parquet(f"{store.home('t')}/{store._new_version()}")        # left by a lost job
    before = store.read("t")
    store.vacuum("t", keep=2)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("v-")]) == 2
    assert len(store.commits("t")) == 2 and before.count() == store.read("t").count() == 4
    store.refresh("t", rows(spark, 5))
    assert store.read("t").count() == 5
    store.vacuum("absent")


def test_partitions_go_into_the_current_version(spark, store):
    store.overwrite_partitions("t", rows(spark, 9), ["year"])
    store.refresh("t", rows(spark, 6), ["year"])
    older = store.path("t")
    store.overwrite_partitions("t", spark.createDataFrame([(100, 1)], "id long, year int"), ["year"])
    assert store.path("t") == older
    assert sorted(r.id for r in store.read("t").collect()) == [0, 2, 3, 5, 100]
    assert store.has_rows("t", "year = 1") and not store.has_rows("u", "year = 1")
    assert store.read("u", store.read("t").schema).isEmpty()
