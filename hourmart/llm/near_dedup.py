"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document is the set of its 5-word shingles. Its sketch has SIZE coordinates. In round r every
element is thrown into a bin by a hash of its own, each bin keeps its lowest (round, hash) value,
and the rounds stop once all bins are filled; from round SIZE on, all elements go into bin r - SIZE,
so after 2 * SIZE rounds no bin can be empty. Two sets agree in a coordinate with a probability
equal to their similarity, and the filled bins give the average the bounds of sampling without
replacement. The first BANDED coordinates are cut into bands; documents that share a band are
compared, on their whole sketches where there are many, and on their full sets.

With 32 bands of 4, a pair at similarity 0.75 shares no band with probability 5e-6, at 0.8 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.components import components
from hourmart.llm.staging import Steps, free_name, session_of

SHINGLE = 5
PERCENT = 75
SIZE = 512            # coordinates of a sketch, a power of two
BANDED = 128          # those that make up the bands
BAND = 4              # coordinates of a band
AGREEING = 340        # coordinates that must agree before two full sets are compared: 4.5 deviations below 0.75
SLICE_BYTES, SLICE_ROWS = 1 << 20, 1 << 10      # texts that are sketched together
BLOCK = 512           # members of a bucket that are handled side by side

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(texts: B.Texts, length: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in rising order, text by text, and their bounds."""
    words = B.words_of(texts)
    hashes = B.SpanHasher(texts.data, B.FOLDED_VALUES)(words.starts, words.ends)
    counts = np.diff(words.bounds)
    shingles = B.runs_of(hashes, length)
    text = words.text[:len(shingles)]
    inside = np.arange(len(shingles)) + length <= words.bounds[1:][text]
    shingles, text = shingles[inside], text[inside]
    few = np.flatnonzero((counts > 0) & (counts < length))
    if len(few):      # the whole sequence as one shingle
        whole = np.array([B.runs_of(hashes[words.bounds[i]:words.bounds[i + 1]], int(counts[i]))[0] for i in few], np.uint64)
        shingles, text = np.concatenate([shingles, whole]), np.concatenate([text, few])
        order = np.argsort(text, kind="stable")
        shingles, text = shingles[order], text[order]
    order = B.by_group(text, shingles)
    shingles, text = shingles[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
    shingles, text = shingles[new], text[new]
    return shingles, np.searchsorted(text, np.arange(len(texts) + 1))


def sketches(values: np.ndarray, bounds: np.ndarray, size: int = SIZE) -> np.ndarray:
    """One row of `size` coordinates for each set; rows of empty sets stay at the highest value."""
    n = len(bounds) - 1
    bins = np.full(n * size, _EMPTY, np.uint64)
    rounds = B.seeds(2 * size, 5000)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    for r in range(2 * size):
        if not len(values):
            break
        h = B.mix(values ^ rounds[r])
        at = (h & np.uint64(size - 1)).astype(np.int64) if r < size else r - size
        np.minimum.at(bins, owner * size + at, (h >> np.uint64(12)) | np.uint64(r << 52))
        if r < 4 or r % 8 == 0:      # a later round changes no filled bin, so sets may go on for a while
            sets = np.flatnonzero(np.diff(owner, prepend=-1))
            full = np.zeros(n, bool)
            full[owner[sets]] = (bins.reshape(n, size)[owner[sets]] != _EMPTY).all(1)
            still = ~full[owner]
            if not still.all():
                values, owner = values[still], owner[still]
    return bins.reshape(n, size)


def band_keys(rows: np.ndarray, band: int = BAND) -> np.ndarray:
    """One key for each band of each sketch; the band's number is part of the key."""
    n, size = rows.shape
    parts = rows.reshape(n, size // band, band)
    key = np.broadcast_to(B.seeds(size // band, 9000), parts.shape[:2]).copy()
    for j in range(band):
        key = B.mix(key * np.uint64(31) + parts[:, :, j])
    return key


def set_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A key of each whole set."""
    sums = B.sums_between(B.mix(values ^ np.uint64(0x5DEECE66D)), bounds)
    return B.mix(sums + np.diff(bounds).astype(np.uint64))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # 4 KB of sketch a row, however short its text is
    for rows, texts in B.text_slices(batches, limit=SLICE_BYTES, rows=SLICE_ROWS):
        values, bounds = shingle_sets(texts)
        counts = np.diff(bounds)
        rows_of = sketches(values, bounds)
        keys = band_keys(rows_of[:, :BANDED])
        full = counts > 0
        where = np.arange(len(full) + 1) * keys.shape[1]
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("row_key"), pa.array(counts.astype(np.int64)),
             pa.array(set_keys(values, bounds).view(np.int64), mask=~full),
             B.list_array(keys.ravel().view(np.int64), where, ~full),
             pa.array([x.tobytes() for x in rows_of.astype(np.uint8)], pa.binary(), mask=~full)],
            ["doc_id", "row_key", "n_shingles", "set_key", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in B.text_slices(batches, limit=SLICE_BYTES):
        values, bounds = shingle_sets(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(set_keys(values, bounds).view(np.int64)), B.list_array(values.view(np.int64), bounds)],
            ["set_key", "shingles"])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with their distance (1 - similarity) and whether they are linked, by their full sets."""
    left = sets.select(F.col("set_key").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("set_key").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("common")
    return both.select("a", "b", (1 - F.col("common") / union).alias("distance"), (100 * F.col("common") >= PERCENT * union).alias("linked"))


def _row_key() -> Column:
    """A key of a row's doc_id and text; rows that share it are repeats of each other."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def _labelled(docs: DataFrame, steps: Steps) -> DataFrame:
    """(doc_id, row_key, n_shingles, label) of all rows: a label for each component, null for empty sets."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _row_key().alias("row_key"))
    described = steps.keep(
        texts.mapInArrow(B.tidy(_describe), "doc_id long, row_key long, n_shingles long, set_key long, bands array<long>, sketch binary"), "described")
    members = described.filter("set_key is not null")
    rows = members.groupBy("set_key").agg(F.first("bands").alias("bands")).select(F.explode("bands").alias("band"), "set_key")
    rows = steps.keep(rows, "bands")
    shared = rows.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    together = steps.keep(rows.join(shared, "band"), "together")
    steps.drop(rows)
    # the text that copies were made from shares more bands with them than they do with each other
    weight = together.groupBy("set_key").agg(F.sum("n").alias("weight"))
    order = F.shiftleft("weight", 24) + F.col("set_key").bitwiseAND(0xFFFFFF)
    hubs = (together.select("band", "set_key").join(weight, "set_key").groupBy("band")
            .agg(F.max_by("set_key", order).alias("hub")))
    buckets = steps.keep(together.select("band", "set_key").join(hubs, "band"), "buckets")
    steps.drop(together)

    candidates = buckets.select("set_key").distinct()
    owners = members.join(candidates, "set_key", "left_semi").groupBy("set_key").agg(F.min("row_key").alias("row_key"))
    chosen = texts.join(owners.select("row_key").distinct(), "row_key", "left_semi")
    sets = chosen.mapInArrow(B.tidy(_sets), "set_key long, shingles array<long>")
    sets = steps.keep(sets.dropDuplicates(["set_key"]), "sets")

    stars = (buckets.filter("set_key <> hub").select(F.col("hub").alias("a"), F.col("set_key").alias("b")).distinct())
    spokes = steps.keep(compared(stars, sets), "spokes")
    links = spokes.filter("linked").select("a", "b")
    labels = components(links, steps)
    near = compared(_crossing(buckets, spokes, labels, described), sets).filter("linked").select("a", "b")
    links = steps.keep(links.unionByName(near), "links")
    steps.drop(buckets, sets)
    labels = components(links, steps)

    return steps.last(
        described.select("doc_id", "row_key", "n_shingles", "set_key")
        .join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
        .select("doc_id", "row_key", "n_shingles", F.coalesce("label", "set_key").alias("label")), "labelled")


def near_duplicates(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept.

    Documents with equal sets are one class from the start, so a group of exact copies costs one
    member. Within a bucket (documents that share a band) every member is first compared with one
    hub, the member that shares most buckets. Linked members then need no comparison with each
    other; of the pairs that the links so far leave in different components, all are tested on their
    sketches and then on their full sets. No link between different components is lost and a group
    of near copies is never expanded into all its pairs.

    A null or empty text, or one without words, has an empty set and links with nothing. A repeated
    doc_id gives a row for each of its rows. A null doc_id is no candidate for component_id and is
    never kept. An empty table gives no rows. Other columns are ignored.
    """
    found = _labelled(docs, steps or Steps(session_of(docs)))
    lowest = found.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return found.join(lowest, "label", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """The documents, with all their columns, of which one row of each component stays: the lowest doc_id.

    Documents with empty sets, null and empty texts among them, all stay. Of rows that share doc_id and
    text one stays; a null doc_id stays only where its component has no other. Texts are read whole; an
    empty table stays empty, and columns may have any names.
    """
    found = _labelled(docs, steps or Steps(session_of(docs)))
    first = (found.filter("label is not null").groupBy("label")
             .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("row")).select("row.row_key"))
    stay = first.unionByName(found.filter("label is null").select("row_key")).distinct()
    key = free_name("row_key", docs.columns)
    keyed = docs.withColumn(key, _row_key()).join(stay.withColumnRenamed("row_key", key), key, "left_semi")
    return keyed.dropDuplicates([key]).drop(key)


def _crossing(buckets: DataFrame, spokes: DataFrame, labels: DataFrame, described: DataFrame) -> DataFrame:
    """Pairs of a bucket's members that were not compared yet, lie in different components and may be linked.

    Buckets are cut into blocks and every two blocks meet in one group, so a group is bounded whatever
    the bucket's size; inside a group only pairs that pass the tests of :func:`_pairs_of` become rows.
    """
    members = (buckets.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
               .select("band", "hub", "set_key", F.coalesce("label", "set_key").alias("label")))
    mixed = (members.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
             .filter("n > 2 and low <> high").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    spokes = spokes.select(F.col("a").alias("hub"), F.col("b").alias("set_key"), "distance")
    sketch = described.filter("set_key is not null").groupBy("set_key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"))
    open_rows = members.join(mixed, "band").join(spokes, ["hub", "set_key"]).join(sketch, "set_key")
    own = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    blocked = (open_rows.withColumn("own", own).withColumn("other", other)
               .select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       "own", "set_key", "label", "distance", "sketch", "bands"))
    keys = ["band", "i", "j"]
    return blocked.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(B.tidy(_pairs_of), "a long, b long")


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each group (band, i, j); rows come sorted by group.

    A pair is left out if it is in one component already; if an earlier band has it too, by its whole
    key (sketches hold the low bytes of coordinates, which also agree by chance); if the two distances
    to the hub differ by more than a link allows (distances obey the triangle inequality); or if so few
    coordinates agree that a linked pair falls below with a probability under 4e-6.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        keys = np.stack([table.column(c).to_numpy() for c in ("band", "i", "j")])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        yield from _pairs_in(table.slice(0, last), cuts)
        rest = table.slice(last).combine_chunks().to_batches()[0] if table.num_rows > last else None
    if rest is not None:
        yield from _pairs_in(pa.Table.from_batches([rest]), np.array([rest.num_rows]))


def _pairs_in(table: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    column = {c: table.column(c).to_numpy() for c in ("i", "j", "own", "set_key", "label", "distance")}
    raw = b"".join(table.column("sketch").to_pylist())
    coordinates = np.frombuffer(raw, np.uint8).reshape(table.num_rows, SIZE)
    band = table.column("band").to_numpy()
    bands = pa.concat_arrays(table.column("bands").chunks).flatten().to_numpy().reshape(table.num_rows, -1)
    found_a, found_b = [], []
    for start, end in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
        label, distance, own = (column[c][start:end] for c in ("label", "distance", "own"))
        inside = column["i"][start] == column["j"][start]
        x, y = np.nonzero((label[:, None] != label[None, :]) & (np.abs(distance[:, None] - distance[None, :]) <= 1 - PERCENT / 100 + 1e-9)
                          & (inside | (own[:, None] < own[None, :])))
        if inside:
            x, y = x[x < y], y[x < y]
        for at in range(0, len(x), 1 << 13):
            p, q = x[at:at + (1 << 13)] + start, y[at:at + (1 << 13)] + start
            take = (coordinates[p] == coordinates[q]).sum(1) >= AGREEING
            p, q = p[take], q[take]
            first = (bands[p] == bands[q]).argmax(1)
            take = bands[p, first] == band[start]
            found_a.append(column["set_key"][p[take]])
            found_b.append(column["set_key"][q[take]])
    if found_a:
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
