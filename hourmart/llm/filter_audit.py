"""Audit of how five filters act on one another, over every order in which they can be applied.

Each document fails some of the filters; documents of a part with the same failures and labels are one
counted cell, at most 32 masks a part. Each mask cell is folded across the array of all 120 orders with
`aggregate` and `transform` into 600 weighted structs (order, step), and the cells of a part are merged
by elementwise sums. All of it is DataFrame functions; texts are read once and are never shuffled, only
their digests are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmart.llm.staging import Steps, session_of

FILTERS = "ABCDE"
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
SYMBOLS = "#$%&*|"
_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    # one struct, taken apart by a lambda: the words are made once
    by_words = F.transform(F.array(words), lambda w: F.when(F.size(w) < MIN_WORDS, _bit("A")).otherwise(0)
                           + F.when(100 * F.size(F.array_distinct(w)).cast("long") < DISTINCT_PERCENT * F.size(w).cast("long"), _bit("B")).otherwise(0))[0]
    upper = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return (by_words + F.when(100 * upper > UPPER_PERCENT * F.length(text).cast("long"), _bit("C")).otherwise(0)
            + F.when(text.rlike(f"[{SYMBOLS}]"), _bit("D")).otherwise(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, steps: Steps) -> DataFrame:
    """(part, mask, n, good, toxic): documents by their part and the set of filters they fail.

    Copies are found by digest. A digest may be that of very many rows: they are counted by (digest,
    part, mask, labels) before any digest's rows meet, so few rows a digest are left.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.sha2(text, 256).alias("digest"), failures(text).alias("mask"))
    marks = (labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    by = ["digest", "part", "mask", "good", "toxic"]
    marked = rows.join(marks, "doc_id", "left").na.fill(0, ["good", "toxic"])
    by_id = marked.groupBy("doc_id", *by).agg(F.count("*").alias("n"))
    groups = steps.keep(by_id.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")), "groups")
    lowest = groups.groupBy("digest").agg(F.min("first.doc_id").alias("lowest"))
    passing = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    split = groups.join(lowest, "digest").select(*by, "n", passing.alias("passing"))
    split = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("passing").alias("n")),
        F.struct((F.col("mask") + _bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))))
    return split.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def all_orders() -> Column:
    """Every order of FILTERS as a string, in alphabetical order."""
    letters = F.array(*[F.lit(x) for x in FILTERS])
    return reduce(lambda found, _: F.flatten(F.transform(found, lambda p: F.transform(
        F.filter(letters, lambda x: ~F.contains(p, x)), lambda x: F.concat(p, x)))), FILTERS, F.array(F.lit("")))


def _fold(orders: Column, cell: DataFrame) -> Column:
    """The cell's 600 structs: per order and step what its documents add to each count."""
    n, good, toxic, mask = F.col("n"), F.col("good"), F.col("toxic"), F.col("mask")
    zero = F.lit(0).cast("long")
    bits = F.create_map(*[F.lit(y) for x in FILTERS for y in (x, _bit(x))])

    def step(done: Column, order: Column, at: Column) -> Column:
        letter = F.substr(order, at, F.lit(1))
        bit = bits[letter]
        fails = mask.bitwiseAND(bit) != 0
        here = fails & ~done["gone"]
        return F.struct((done["gone"] | fails).alias("gone"), F.concat(done["steps"], F.array(F.struct(
            order.alias("filter_order"), at.alias("step"), letter.alias("letter"),
            F.when(~(done["gone"] | fails), n).otherwise(zero).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"),
            F.when(fails & done["gone"], n).otherwise(zero).alias("redundant"), F.when(mask == bit, n).otherwise(zero).alias("unique_fails"),
            F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost")))).alias("steps"))

    kind = "array<struct<filter_order:string,step:int,letter:string," + ",".join(f"{c}:bigint" for c in _COUNTS) + ">>"
    start = F.struct(F.lit(False).alias("gone"), F.from_json(F.lit("[]"), kind).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(
        F.sequence(F.lit(1), F.lit(len(FILTERS))), start, lambda done, at: step(done, order, at), lambda done: done["steps"])))


def _sums(a: Column, b: Column) -> Column:
    return F.struct(a["filter_order"].alias("filter_order"), a["step"].alias("step"), a["letter"].alias("letter"),
                    *[(a[c] + b[c]).alias(c) for c in _COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, and seven counts.

    `docs` has (doc_id, text, source), `labels` (doc_id, quality, toxic). A part is a source; null and
    empty sources are one part. Null and empty texts fail A and are copies of one another. Of rows with
    the same text those with the smallest doc_id pass E, all of them if that doc_id is repeated; a null
    doc_id passes E, has no labels and makes nobody a copy. A doc_id labelled more than once counts as
    good, or toxic, if any label says so. Repeated rows count each; other columns are ignored, and an
    empty table has no parts and no rows.
    """
    steps = Steps(session_of(docs))
    counted = steps.keep(cells(docs, labels, steps), "cells")
    orders = docs.sparkSession.range(1).select(all_orders().alias("orders")).scalar()      # 120 strings
    folded = counted.withColumn("orders", orders)
    folded = folded.select("part", _fold(F.col("orders"), folded).alias("steps"))
    # at most 32 cells a part are listed
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("cells")).select("part", F.aggregate(
        F.slice("cells", 2, F.size("cells")), F.col("cells")[0], lambda a, b: F.zip_with(a, b, _sums)).alias("steps"))
    merged = merged.withColumn("shapley", F.map_from_entries(F.transform(
        F.array(*[F.lit(x) for x in FILTERS]), lambda x: F.struct(x, F.aggregate(
            F.filter("steps", lambda s: s["letter"] == x), F.lit(0).cast("long"), lambda total, s: total + s["removed"])))))
    found = merged.select("part", "shapley", F.inline("steps"))
    found = found.select("part", "filter_order", "step", *_COUNTS, F.col("shapley")[F.col("letter")].alias("shapley"))
    return steps.last(found, "audit")
