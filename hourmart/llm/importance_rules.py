"""Quality rules with hashed n-gram log-likelihood ratios, in DataFrame functions alone.

Two multinomials over hashed word unigrams and bigrams are counted: one over trusted documents
(labelled as of good quality), one over the raw corpus (all documents). A document's score is the
mean log ratio of its n-grams' buckets; a fixed threshold decides, for every document alike. Weights
are whole micro-units, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmart.llm.staging import Steps, session_of

BUCKETS = 16384
ALPHA = 0.5               # added to each bucket's count
SCALE = 1_000_000         # units of a weight
THRESHOLD = -100_000      # lowest mean weight of a kept document
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _count_of(text: Column, characters: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{characters}]+", ""))


def short_hashes(found: Column) -> Column:
    """The leading 28 bits of each word's md5."""
    return F.transform(found, lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))


def joined(hashes: Column, reach: int) -> Column:
    """Hash of each entry and the one `reach` further on; of 1, 2 and 4 they make that of 8 words."""
    return F.zip_with(hashes, F.slice(hashes, reach + 1, F.size(hashes)), lambda a, b: F.xxhash64(a, b))


def with_buckets(rows: DataFrame) -> DataFrame:
    """Turns `short` into `grams`: buckets of all unigrams, then of all bigrams.

    An array that is used more than once is a column of a step of its own, so it is worked out once.
    """
    rows = rows.withColumn("pairs", F.zip_with("short", F.slice("short", 2, F.size("short")),
                                               lambda a, b: ((a.cast("long") * 31 + b + 1) % BUCKETS).cast("int")))
    return rows.withColumn("grams", F.concat(
        F.transform("short", lambda h: (h % BUCKETS).cast("int")),
        F.slice("pairs", 1, F.greatest(F.size("pairs") - 1, F.lit(0))))).drop("short", "pairs")


def weights(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row: the weight of each bucket as an array. Without trusted documents all weights are 0.

    `docs` has (doc_id, text), `trusted` doc_ids without repeats. Buckets are counted before they
    are shuffled, and there are BUCKETS of them whatever the input.
    """
    # labels grow with the corpus: the join sorts and merges at every size instead of changing its plan
    marked = docs.join(trusted.withColumn("good", F.lit(1)).hint("merge"), "doc_id", "left")
    hashed = marked.select("good", words(F.col("text")).alias("words")).select("good", short_hashes(F.col("words")).alias("short"))
    # the outer form, whose empty rows match no bucket below: a plain explode puts a test for empty
    # arrays under all the steps above and so works them out again
    grams = with_buckets(hashed).select("good", F.explode_outer("grams").alias("bucket"))
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("good").alias("good"))
    all_buckets = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    filled = all_buckets.join(counted, "bucket", "left").na.fill(0, ["raw", "good"])
    listed = filled.agg(F.sort_array(F.collect_list(F.struct("bucket", "good", "raw"))).alias("rows"),
                        F.sum("good").alias("goods"), F.sum("raw").alias("raws"))
    share = BUCKETS * ALPHA

    def weight(row: Column) -> Column:
        ratio = F.log((row["good"] + ALPHA) / (F.col("goods") + share)) - F.log((row["raw"] + ALPHA) / (F.col("raws") + share))
        return F.when(F.col("goods") == 0, F.lit(0)).otherwise(F.round(ratio * SCALE)).cast("long")

    return listed.select(F.transform("rows", weight).alias("weights"))


def repeat_words(hashes: Column, sorted_windows: Column) -> Column:
    """Words inside windows whose hash is found twice or more; sorted_windows: (hash, place) in order."""
    last = F.size(sorted_windows) - 1
    places = F.array_sort(F.transform(
        F.filter(F.transform(sorted_windows, lambda w, i: F.struct(
            w["place"].alias("place"),
            ((i > 0) & (sorted_windows[F.greatest(i - 1, F.lit(0))]["hash"] == w["hash"])
             | (i < last) & (sorted_windows[F.least(i + 1, last)]["hash"] == w["hash"])).alias("again"))),
            lambda w: w["again"]), lambda w: w["place"]))
    none = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(
        places, none,
        lambda a, p: F.struct((p + WINDOW).alias("upto"), (a["n"] + p + WINDOW - F.greatest(a["upto"], p)).alias("n")),
        lambda a: a["n"])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, weight.

    `labels` has (doc_id, quality). weight is the mean weight of the document's n-grams in
    micro-units, rounded down (0 without words). A null or empty text has no words and fails the base
    rules. Rows with a repeated or null doc_id are judged one by one, and doc_ids that are labelled
    more than once count once; a null doc_id is never trusted. Other columns are ignored. The rows
    are written once and read from there, whatever is filtered or joined afterwards.
    """
    spark = session_of(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    trusted = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    table = weights(texts, trusted).scalar()

    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    rows = texts.select(
        "doc_id", words(F.col("text")).alias("words"),
        _count_of(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"), lines.alias("lines"))
    rows = rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"), short_hashes(F.col("words")).alias("short"))
    for reach in (1, 2, 4):      # one step each, so that no array is worked out twice
        rows = rows.withColumn("windows", joined(F.col("hashes" if reach == 1 else "windows"), reach))
    rows = rows.withColumn("windows", F.slice("windows", 1, F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")))
    rows = rows.withColumn("repeated", F.size(F.array_distinct("windows")) < F.size("windows"))
    rows = rows.withColumn("windows", F.when(F.col("repeated"), F.array_sort(F.transform(
        "windows", lambda h, i: F.struct(h.alias("hash"), i.alias("place"))))))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.when(
        F.col("repeated"), repeat_words(F.col("hashes"), F.col("windows"))), F.lit(0)).cast("long"))
    rows = with_buckets(rows.drop("windows", "repeated", "hashes"))
    rows = rows.withColumn("table", table)
    total = F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.col("table")[g])
    rows = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        F.when(F.size("grams") == 0, F.lit(0.0)).otherwise(total / F.size("grams")).alias("mean"))
    judged = rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("mean") >= THRESHOLD)).alias("kept"), F.floor("mean").alias("weight"))
    # written, because a filter on the result would be pushed below the steps and put all of them in its place
    return Steps(spark).last(judged, "judged")
