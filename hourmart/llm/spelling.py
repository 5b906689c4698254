"""Spelling variants: words one edit apart, found by walking a trie as a relation.

The trie is a table of edges (level, parent, letter, child), one for the words and one for the words
read backwards; nodes are hashes of their prefixes. States (word, position, node, edits) are joined
with the edges of one level after the other: a state without an edit goes on by a foreign letter as an
insertion, a replacement or a deletion, one with an edit only by its own next letter. Those that end
on a word are neighbours. An edit in the back half of a word is found in the forward trie, one in the
front half in the backward trie, so no state starts near the root, where nodes have many children.

Each node has a sketch of the suffixes below it, two sets of 64 bits; a state whose own rest is not in
both is a dead end and is not written. Chance matches of hashes end when neighbours are compared.
Words longer than LEVELS letters would take a round for each letter. They meet by hashes of themselves
with one letter left out, and are compared in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.staging import Steps, session_of

RUN = r"[A-Za-zÀ-ÿ]+"
TYPO = 97                     # a run whose checksum this divides loses a letter
MIN_LETTERS, MIN_COUNT = 5, 3
FORM_RATIO = 2
LEVELS = 64
_UPPER, _LOWER, _END = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "$"


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words of all documents, after the letters that checksums name are deleted."""
    text = F.translate(F.col("text").cast("string"), _UPPER, _LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= MIN_LETTERS)
    sum_ = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (sum_ % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(sum_ % TYPO == 0, shorter).otherwise(F.col("run")).alias("word"))
    return (words.filter(F.length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= MIN_COUNT))


def _node(way: Column, prefix: Column) -> Column:
    return F.xxhash64(way, prefix)


def _rest(letters: Column, at: Column) -> Column:
    """Hash of what is left from a place on."""
    return F.xxhash64(F.substr(letters, at + 1))


def _set(hashed: Column, shift: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.call_function("shiftright", hashed, F.lit(shift)).bitwiseAND(F.lit(63)).cast("int"))


def _may_hold(hashed: Column) -> Column:
    """Whether the child's sketch has the hash of the rest."""
    return ((F.col("low").bitwiseAND(_set(hashed, 0)) != 0) & (F.col("high").bitwiseAND(_set(hashed, 6)) != 0))


def _both_ways(words: DataFrame) -> DataFrame:
    """(way, letters, size): each word forward and backward, with an end mark after its letters."""
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("letters")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("letters")))
    found = words.select(F.inline(ways))
    return found.select("way", F.concat("letters", F.lit(_END)).alias("letters"), F.length("letters").alias("size"))


def _start(size: Column) -> Column:
    """The level at which a word's own states begin: from half of it on, forward and backward."""
    half = F.floor(size / 2).cast("int")
    return F.when(F.col("way") == 0, half).otherwise(size - half)


def edges(words: DataFrame) -> DataFrame:
    """(parent, letter, child, low, high, level) of both tries, as far up as a neighbour's states begin."""
    way, letters, size = F.col("way"), F.col("letters"), F.col("size")
    level = F.col("level")
    steps = _both_ways(words).select("way", "letters", F.explode(F.sequence(_start(size - 1), size)).alias("level"))
    steps = steps.select(
        "level", _node(way, F.substr(letters, F.lit(1), level)).alias("parent"), F.substr(letters, level + 1, F.lit(1)).alias("letter"),
        _node(way, F.substr(letters, F.lit(1), level + 1)).alias("child"), _rest(letters, level + 1).alias("rest"))
    return steps.groupBy("level", "parent", "letter", "child").agg(
        F.bit_or(_set(F.col("rest"), 0)).alias("low"), F.bit_or(_set(F.col("rest"), 6)).alias("high")).select(
        "parent", "letter", "child", "low", "high", "level")


def _advance(states: DataFrame, branches: DataFrame, level: int) -> DataFrame:
    """States one level further on: (way, letters, shift, node, done); shift is position less level.

    A letter that equals the next own one is no foreign letter, so an edit within a run of equal
    letters is made once, after the run.
    """
    letters, shift, letter = F.col("letters"), F.col("shift"), F.col("letter")
    at = F.lit(level) + F.coalesce(shift, F.lit(0))
    own = states.select("way", "letters", "shift", "node",
                        F.substr(letters, at + 1, F.lit(1)).alias("next"), F.substr(letters, at + 2, F.lit(1)).alias("second"),
                        _rest(letters, at).alias("rest0"), _rest(letters, at + 1).alias("rest1"), _rest(letters, at + 2).alias("rest2"))
    met = own.join(branches, F.col("node") == F.col("parent"))
    fresh = shift.isNull()
    foreign, goes_on = letter != F.col("next"), letter != _END
    ways = F.array(
        F.when(~fresh & ~foreign & _may_hold(F.col("rest1")), shift),
        F.when(fresh & foreign & goes_on & _may_hold(F.col("rest0")), F.lit(-1)),
        F.when(fresh & foreign & goes_on & (F.col("next") != _END) & _may_hold(F.col("rest1")), F.lit(0)),
        F.when(fresh & foreign & (letter == F.col("second")) & (F.col("next") != _END) & _may_hold(F.col("rest2")), F.lit(1)))
    return met.select("way", "letters", F.explode(F.array_compact(ways)).alias("shift"), F.col("child").alias("node"), (letter == _END).alias("done"))


def trie_neighbours(words: DataFrame, steps: Steps) -> DataFrame:
    """(word, near) candidates of words of up to LEVELS letters, level by level."""
    spark = words.sparkSession
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    path = steps.path("edges")
    edges(words).hint("rebalance", "level").write.partitionBy("level").parquet(path)      # a level is read by itself
    steps.live.append(path)
    trie = spark.read.schema("parent long, letter string, child long, low long, high long, level int").parquet(path)
    both = steps.keep(_both_ways(words), "both_ways")
    none = spark.createDataFrame([], "way int, letters string, shift int, node long, done boolean")
    reached, frontier = [], none
    for level in range(MIN_LETTERS // 2, longest + 1):
        own = both.filter((_start(F.col("size")) <= level) & (F.col("size") >= level)).select(
            "way", "letters", F.lit(None).cast("int").alias("shift"), _node(F.col("way"), F.substr("letters", F.lit(1), F.lit(level))).alias("node"))
        states = own.unionByName(frontier.filter("not done").select("way", "letters", "shift", "node"))
        frontier = steps.keep(_advance(states, trie.filter(F.col("level") == level).drop("level"), level), "frontier")
        reached.append(frontier)
    if not reached:
        return spark.createDataFrame([], "word string, near string")
    ends = spark.read.schema(none.schema).parquet(*[r._written_at for r in reached]).filter("done")
    named = both.select(_node(F.col("way"), F.col("letters")).alias("node"), F.col("way").alias("of"), F.col("letters").alias("other"))
    met = ends.join(named, "node").filter("way = of")

    def plain(c: str) -> Column:
        bare = F.substr(c, F.lit(1), F.length(c) - 1)
        return F.when(F.col("way") == 0, bare).otherwise(F.reverse(bare))

    return met.select(plain("letters").alias("word"), plain("other").alias("near"))


def _left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, id): hash of each word (place -1) and of the word without each of its letters."""
    for rows in batches:
        texts = B.texts_of(rows.column("word"))
        for number, id_ in enumerate(rows.column("id").to_pylist()):
            data = texts.data[texts.bounds[number]:texts.bounds[number + 1]]
            first = np.flatnonzero((data & 0xC0) != 0x80)
            last = np.append(first[1:], len(data))
            up = B._power_tables(len(data))[0]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(B.BYTE_VALUES[data] * up[:len(data)])])
            # what follows the letter moves back by the letter's bytes
            down = B._power_tables(8)[1][last - first]
            keys = np.concatenate([sums[-1:], sums[first] + (sums[-1] - sums[last]) * down])
            for a in range(0, len(keys), 1 << 16):
                part = keys[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(B.mix(part).view(np.int64)), pa.array(np.arange(a - 1, a - 1 + len(part))), pa.array(np.full(len(part), id_))], ["key", "place", "id"])


def long_neighbours(words: DataFrame, steps: Steps) -> DataFrame:
    """(word, near) candidates of which at least one is longer than LEVELS letters."""
    long = words.filter(F.length("word") >= LEVELS).select("word", F.xxhash64("word").alias("id"))
    if long.filter(F.length("word") > LEVELS).isEmpty():
        return words.sparkSession.createDataFrame([], "word string, near string")
    keys = steps.keep(long.repartition("id").mapInArrow(_left_out, "key long, place long, id long"), "left_out")
    whole, cut = keys.filter("place < 0").select("key", F.col("id").alias("other")), keys.filter("place >= 0")
    # letters at one place are few, so the rows of a key and place are
    pairs = (cut.join(whole, "key").select("id", "other")
             .unionByName(cut.join(cut.select("key", "place", F.col("id").alias("other")), ["key", "place"]).filter("id < other").select("id", "other"))
             .distinct())
    pairs = pairs.unionByName(pairs.select(F.col("other").alias("id"), F.col("id").alias("other")))
    found = pairs.join(long, "id").join(long.select(F.col("id").alias("other"), F.col("word").alias("near")), "other")
    return found.filter((F.length("word") > LEVELS) | (F.length("near") > LEVELS)).select("word", "near")


def roots(forms: DataFrame, steps: Steps) -> DataFrame:
    """(word, root): the last word reached by following (word, form); each round doubles the way gone.

    A form occurs more often than its word, so no way leads back.
    """
    ahead = steps.keep(forms.select("word", F.col("form").alias("root")), "ahead")
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = steps.keep(ahead.join(beyond, "root", "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "ahead")
        steps.drop(ahead)
        ahead = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return ahead
        ahead._written_at = step._written_at


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    `docs` has (doc_id, text). Words are runs of Latin letters of at least MIN_LETTERS code points with
    at least MIN_COUNT occurrences; near words differ by exactly one letter put in, left out or
    replaced. The form is the near word with the most occurrences, the smallest of several, if it has
    FORM_RATIO times the word's own; the root is the last form's form. Words without near words have
    n_near 0 and are their own root. Null and empty texts have no words; a null doc_id counts as an
    empty one in checksums; repeated rows count each. Texts and words of any length are taken whole;
    other columns are ignored, and an empty table has no rows.
    """
    steps = Steps(session_of(docs))
    words = steps.keep(word_counts(docs), "words")
    found = (trie_neighbours(words.filter(F.length("word") <= LEVELS), steps)
             .unionByName(long_neighbours(words, steps))
             .filter(F.expr("levenshtein(word, near, 1)") == 1))
    counted = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # both tries may find a pair; by word alone, so that the grouping below needs no other shuffle
    pairs = found.join(counted, "near").repartition("word").dropDuplicates(["word", "near"])
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = F.col("best").isNotNull() & (-F.col("best.less") >= FORM_RATIO * F.col("n"))
    rows = steps.keep(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
        F.when(enough, -F.col("best.less")).alias("form_n")), "forms")
    ended = roots(rows.filter("form is not null"), steps)
    return steps.last(rows.join(ended, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
