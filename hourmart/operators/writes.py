"""Write semantics as whole-table transforms: replace, insert, upsert, update, delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hourmart.functions.numeric import is_true


def replace_groups(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Every group named in ``incoming`` is dropped, then ``incoming`` is added."""
    touched = incoming.select(*keys).distinct()
    return existing.join(touched, keys, "left_anti").unionByName(incoming)


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` plus the incoming rows whose key it lacks."""
    fresh = latest_per_key(incoming, keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh)


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the greatest in ``order`` (default: all other columns).

    An aggregate, so many copies of one key combine on the map side.
    """
    rest = [c for c in rows.columns if c not in keys]
    if not rest:
        return rows.distinct()
    fields = list(dict.fromkeys((order or []) + rest))
    kept = rows.groupBy(*keys).agg(F.max(F.struct(*fields)).alias("_row"))
    return kept.select(*[
        F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], update: list[str]
           ) -> DataFrame:
    """Insert new keys; for known keys set only the ``update`` columns.

    Both sides have one row per key (see :func:`latest_per_key`). A NULL coming
    in overwrites, as an assignment would.
    """
    others = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*others).alias("_old"))
    new = incoming.select(*keys, F.struct(*others).alias("_new"))
    inserted = F.col("_old").isNull()
    updated = F.col("_new").isNotNull()

    def value(column: str) -> Column:
        take_new = (inserted | updated) if column in update else inserted
        return F.when(take_new, F.col(f"_new.{column}")).otherwise(F.col(f"_old.{column}"))

    joined = old.join(new, keys, "full_outer")
    return joined.select(*[
        F.col(c) if c in keys else value(c).alias(c) for c in existing.columns])


def conditional_update(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Set columns on the rows the predicate holds for; unknown counts as no."""
    hit = is_true(where)
    return rows.withColumns({
        c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def conditional_delete(rows: DataFrame, where: Column) -> DataFrame:
    return rows.where(~is_true(where))


def delete_keys(rows: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(doomed.select(*keys).distinct(), keys, "left_anti")


def add_column_if_missing(rows: DataFrame, column: str, default: Column) -> DataFrame:
    return rows if column in rows.columns else rows.withColumn(column, default)
