"""Language-model scores by online logistic mixing of hashed-context bit predictors.

Texts are predicted bit by bit. Each context (the last 1, 2, 3 or 5 bytes, or the word so far; hashed to 40
bits) and the bits of the byte so far name a state; its counts of zeros and ones, over all training documents,
give a log-odds. A mixer adds the log-odds with weights and turns the sum into a probability. The bit's place
in the byte gates which set of weights is used, and after each bit the set moves along the gradient of the
coding cost. Every SEGMENT bytes the weights start anew from those learned over the training texts, so all
segments of many texts are scored side by side; contexts reach over segments, not over documents. Each text
ends with a zero byte.

Texts are dealt into slices. The distinct pairs of a context and a byte of every slice go to the bucket of
their context, where they are added up once, and the log-odds go back by slice. So every state is counted and
read once, however many slices there are. Words of the base score take the same way. :func:`bit_model` makes tables of hashed slots of the same counts,
for scoring texts elsewhere with :func:`log_probabilities`; states that share a slot share their counts there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.records import _store
from hourmart.llm.staging import Steps, session_of
from hourmart.llm.training import fold

FOLDS, HELD_OUT = 5, 1
ORDERS = (1, 2, 3, 5)              # bytes of the contexts; the last context is the word so far
CONTEXTS = len(ORDERS) + 1
TABLE_BITS = 18                    # of a slot's number, at the least; see table_bits
BUCKET_BITS = 10                   # a table's slots are counted, stored and read in so many parts (as a power of two)
HELD_PAIRS = 1 << 22               # pairs of a context and a byte that a task holds before it sends them on
HELD_BYTES = 1 << 26               # of stored tables that are held; what is beyond is read part by part for each slice
DEALT_BYTES = 1 << 25              # of texts in a slice at the most, but for its last texts; its distinct pairs are bounded by HELD_PAIRS
SCORED_BYTES = 1 << 20             # of texts that are scored side by side, or one longer text
SEGMENT = 512
ANSWERED_PAIRS = 1 << 16           # of several slices, that are packed together
LOGGED = 16                        # bytes whose costs are multiplied before their log is taken: (1 + e^40)^16 is below 1e308
RATE = 0.02
START = 0.3                        # first weight of every context in learning
PRIOR = 0.3                        # added to both counts of a slot
LEVELS = 16                        # steps of a stored log-odds for each unit
ROUNDS = ([*range(len(ORDERS))], [len(ORDERS)])      # contexts that are answered together; words come last
WORDS = CONTEXTS                   # stands for whole words, lower-cased, among numbers of contexts
TOTALS = "totals"                  # stands for all slices among their names
CHAINS = -1                        # stands for the contexts of all orders among numbers of contexts

_BYTE = np.uint64(0xFF)
_UPPER = np.uint64((1 << 64) - (1 << 24))      # of a hashed context; more bits than any slot's number has


class Stream:
    """The bytes of texts, each followed by a zero byte, the bytes before each of them, and its hashed contexts."""

    def __init__(self, texts: B.Texts):
        self.bounds = texts.bounds + np.arange(len(texts.bounds))
        n, longest = int(self.bounds[-1]), max(ORDERS)
        begin = self.bounds[:-1]
        # texts with `longest` zeros before each, so eight bytes read from so far back hold the bytes before
        inside = np.ones(n + longest * len(begin) + 8, bool)
        inside[np.add.outer(begin + longest * np.arange(len(begin)), np.arange(longest)).ravel()] = False
        inside[len(inside) - 8:] = False
        filled = inside.copy()
        filled[self.bounds[1:] + longest * np.arange(1, len(begin) + 1) - 1] = False
        padded = np.zeros(len(inside), np.uint8)
        padded[filled] = texts.data
        self.data = padded[inside]
        back = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 8,), (1,))[inside[longest:len(inside) - 8 + longest]]
        # the longest order's bytes, the last one first, so a shift leaves those of a shorter order
        self.chain = ((back << np.uint64(8)) & np.uint64((1 << (8 * longest + 8)) - 1)) | self.data
        # the word so far starts behind the last blank, or where the text starts
        new = np.ones(n, bool)
        np.logical_not(B.IN_WORD[self.data[:-1]], out=new[1:])
        new[begin] = True
        self.word = B.SpanHasher(self.data).beginnings(np.flatnonzero(new))
        self.word &= _UPPER

    @property
    def contexts(self) -> list[np.ndarray]:
        return [_hashed(_shorter(self.chain, max(ORDERS), k), k) & ~_BYTE for k in ORDERS] + [self.word]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Each byte with the bytes before it, and with the hashed word so far."""
        return self.chain, self.word | self.data


def _shorter(pairs: np.ndarray, longer: int, order: int) -> np.ndarray:
    """Of pairs of so many bytes and a byte: those of a shorter order's bytes and the byte."""
    return pairs if longer == order else ((pairs >> np.uint64(8 * (1 + longer - order))) << np.uint64(8)) | (pairs & _BYTE)


def _hashed(pairs: np.ndarray, order: int) -> np.ndarray:
    """Of pairs of an order's bytes and a byte: the hash of the bytes, and the byte."""
    return (B.mix((pairs >> np.uint64(8)) + np.uint64(order << 56)) & _UPPER) | (pairs & _BYTE)


def _by_bit() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    byte = np.arange(256)
    place = np.arange(8)[:, None]
    bits = (byte >> (7 - place)) & 1
    return (byte >> (8 - place)) | (1 << place), bits, (1 - 2 * bits).astype(np.float32)


#: For each place of a bit and each byte: the bits before it with a leading one, to be joined with a context's
#: slot by exclusive or; the bit; and -1 for a one, 1 for a zero.
NODES, BITS, SIGNS = _by_bit()


def table_bits(states: int) -> int:
    """Bits of a slot's number in a table for so many counted states: at least two slots for each."""
    return max(TABLE_BITS, int(2 * states - 1).bit_length() if states else 0)


def _slots(context: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each hashed context, and the slot in it where its states are; the node goes in by exclusive or."""
    slot = (context >> np.uint64(64 - bits)).astype(np.int64)
    return slot >> (bits - BUCKET_BITS), slot & ((1 << (bits - BUCKET_BITS)) - 1)


def _odds(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stored log-odds of counted bits."""
    odds = (ones + PRIOR) / (zeros + PRIOR)
    np.log(odds, out=odds)
    odds *= LEVELS
    np.rint(odds, out=odds)
    return np.minimum(np.maximum(odds, -127), 127).astype(np.int8)


def _without_own() -> np.ndarray:
    """For a stored log-odds of a state that has seen one bit only: its log-odds before the last time."""
    seen = _odds(np.zeros(2000), np.arange(2000))
    found = np.arange(-128, 128).astype(np.int8)
    for now, before in zip(seen[:0:-1].tolist(), seen[-2::-1].tolist()):
        found[128 + now], found[128 - now] = before, -before
    return found


WITHOUT_OWN = _without_own()
_BEFORE = np.roll(WITHOUT_OWN, -128)      # by the byte of a stored log-odds


def _merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their times."""
    key, n = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable" if len(keys) > 1 else None)      # several lists are in rising order, which a merge makes use of
    key, n = key[order], n[order]
    first = _firsts(key)
    return key[first], np.add.reduceat(n, first)


def _firsts(key: np.ndarray) -> np.ndarray:
    """Where keys in rising order are not the one before."""
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return np.flatnonzero(new)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and how often each is there."""
    key = np.sort(keys)
    first = _firsts(key)
    return key[first], np.diff(np.append(first, len(key)))


def _placed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order, and the place of each key among them."""
    order = np.argsort(keys)
    key = keys[order]
    first = _firsts(key)
    place = np.empty(len(key), np.int32)
    place[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(key))))
    return key[first], place


_PAIRS = ["context", "bucket", "keys", "times"]


def _planes(rows: np.ndarray) -> bytes:
    """Numbers of 64 bits, packed; bytes of the same place go side by side."""
    return _zstd()[0].compress(np.ascontiguousarray(rows.view(np.uint8).reshape(-1, 8).T))


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_zstd()[1].decompress(raw), np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


@lru_cache(maxsize=1)
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(key: np.ndarray, n: np.ndarray) -> tuple[bytes, bytes]:
    # neighbours of a sorted list differ in their low bytes
    return _planes(np.diff(key, prepend=np.uint64(0))), _zstd()[0].compress(n.astype(np.int64))


def _unpacked(keys: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(_from_planes(keys), dtype=np.uint64), np.frombuffer(_zstd()[1].decompress(times), np.int64)


class Pairs:
    """Distinct pairs of a slice of the texts, bytes with the bytes before them and with the hashed word so far, and its words; and how often."""

    def __init__(self) -> None:
        self.parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
        self.held = self.size = 0

    def add(self, stream: Stream, counted: np.ndarray | None = None, words: tuple[np.ndarray, B.Words] | None = None) -> None:
        """Adds the pairs of texts, and their hashed words; those of texts that are not `counted` are there without a time."""
        found = [(pair, stream.bounds) for pair in stream.pairs()] + ([(words[0], words[1].bounds)] if words else [])
        for part, (keys, bounds) in zip(self.parts, found):
            if counted is None or counted.all():
                part.append(_counted(keys))
            else:
                inside = np.repeat(counted, np.diff(bounds))
                other, _ = _counted(keys[~inside])
                part += [_counted(keys[inside]), (other, np.zeros(len(other), np.int64))]
        self.size += len(stream.data)
        self._hold()

    def merge(self) -> None:
        self.parts = [[_merged(*map(list, zip(*part)))] if part else [] for part in self.parts]
        self._hold()

    def _hold(self) -> None:
        self.held = sum(len(key) for part in self.parts[:2] for key, _ in part)       # words are fewer than pairs with them

    def full(self) -> bool:
        if self.held > HELD_PAIRS:
            self.merge()
            if 2 * self.held > HELD_PAIRS:
                return True
        return self.size >= DEALT_BYTES

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for chain, n in self.parts[0]:
            yield from _orders(chain, n, range(len(ORDERS)))
        for word, n in self.parts[1]:
            yield _bucket_rows(len(ORDERS), word, n)


def _bucket_rows(number: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    bucket = (key >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(key)).tolist()
    made = [_packed(key[a:b], n[a:b]) for a, b in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(made), number, np.int32)), pa.array(bucket[cuts[:-1]].astype(np.int32)),
         pa.array([x for x, _ in made], pa.binary()), pa.array([x for _, x in made], pa.binary())], _PAIRS)


def _orders(chain: np.ndarray, n: np.ndarray, numbers: Iterable[int]) -> Iterator[pa.RecordBatch]:
    """The rows of these orders; shorter ones are sums of longer ones."""
    longer = max(ORDERS)
    for number in sorted(numbers, reverse=True):
        order = ORDERS[number]
        if order < longer:
            chain, n = _merged([_shorter(chain, longer, order)], [n])
            longer = order
        yield _bucket_rows(number, *_merged([_hashed(chain, order)], [n]))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = Pairs()
    for _, texts in B.text_slices(batches):
        pairs.add(Stream(texts))
        if pairs.full():
            yield from pairs.rows()
            pairs = Pairs()
    yield from pairs.rows()


_DEALT = "doc_id long, held_out boolean, text string, slice string, context int, bucket int, keys binary, times binary"


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of texts with the name of their slice, and behind those of a slice the rows of its pairs.

    Texts that are held out ask for their pairs and add nothing to their times. Names are new in every
    attempt of a task, so what a lost attempt has left is met by nobody.
    """
    def filled(found: pa.RecordBatch, name: str) -> pa.RecordBatch:
        n = found.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.array([name] * n, pa.string()) if f.name == "slice" else found.column(f.name) if f.name in found.schema.names else pa.nulls(n, f.type)
             for f in _DEALT_SCHEMA], schema=_DEALT_SCHEMA)

    def done() -> Iterator[pa.RecordBatch]:
        pairs.merge()
        for chain, n in pairs.parts[0]:
            keys, times = _packed(chain, n)
            yield filled(pa.RecordBatch.from_arrays(
                [pa.array([CHAINS], pa.int32()), pa.array([0], pa.int32()), pa.array([keys], pa.binary()), pa.array([times], pa.binary())], _PAIRS), name)
        for number, part in ((len(ORDERS), pairs.parts[1]), (WORDS, pairs.parts[2])):
            for word, n in part:
                yield filled(_bucket_rows(number, word, n), name)

    pairs, name = Pairs(), uuid.uuid4().hex
    for rows, texts in B.text_slices(batches):
        pairs.add(Stream(texts), ~rows.column("held_out").to_numpy(zero_copy_only=False), _word_hashes(texts))
        yield filled(rows, name)
        if pairs.full():
            yield from done()
            pairs, name = Pairs(), uuid.uuid4().hex
    yield from done()


def _asked(numbers: Iterable[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, keys, times in zip(*(batch.column(c).to_pylist() for c in ("slice", "keys", "times"))):
                for found in _orders(*_unpacked(keys, times), numbers):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * found.num_rows, pa.string()), *found.columns], ["slice", *_PAIRS])
    return run


_DEALT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("text", pa.string()), ("slice", pa.string()),
    ("context", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("times", pa.binary())])


def _states(key: np.ndarray) -> int:
    """Distinct contexts with the bits so far among pairs in rising order."""
    return sum(1 + int(np.count_nonzero(np.diff(key >> np.uint64(8 - j)))) for j in range(8)) if len(key) else 0


def _table_part(key: np.ndarray, n: np.ndarray, bits: int) -> np.ndarray:
    """The stored log-odds of all slots of a bucket, from its pairs."""
    _, slot = _slots(key & ~_BYTE, bits)
    byte = (key & _BYTE).astype(np.intp)
    counts = np.zeros(2 << (bits - BUCKET_BITS), np.int64)
    for node, bit in zip(NODES, BITS):
        np.add.at(counts, 2 * (slot ^ node[byte]) + bit[byte], n)
    return _odds(counts[::2], counts[1::2])


def _sum_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bucket's pairs and its number of states, from rows that come one after the other."""
    at, keys, times = None, [], []

    def done() -> pa.RecordBatch:
        key, n = _merged(keys, times)
        packed = _packed(key, n)
        return pa.RecordBatch.from_arrays(
            [pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([packed[0]], pa.binary()),
             pa.array([packed[1]], pa.binary()), pa.array([_states(key)], pa.int64())], [*_PAIRS, "states"])

    for batch in batches:
        for context, bucket, key, n in zip(*(batch.column(c).to_pylist() for c in _PAIRS)):
            if (context, bucket) != at:
                if at:
                    yield done()
                at, keys, times = (context, bucket), [], []
            key, n = _unpacked(key, n)
            keys.append(key)
            times.append(n)
            if sum(map(len, keys)) > 2 * len(keys[0]) + (1 << 16):
                merged = _merged(keys, times)
                keys, times = [merged[0]], [merged[1]]
    if at:
        yield done()


def _table_parts(bits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for context, bucket, key, n in zip(*(batch.column(c).to_pylist() for c in _PAIRS)):
                key, n = _unpacked(key, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([context], pa.int32()), pa.array([bucket], pa.int32()), pa.array([_table_part(key, n, bits[context]).tobytes()], pa.binary())],
                    ["context", "bucket", "odds"])
    return run


class Tables:
    """Log-odds tables in files of the shared folder; tasks read them part by part."""

    def __init__(self, files: list[str], bits: list[int]):
        self.files, self.bits, self.held = files, bits, None

    def _rows(self, files: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        for file in files:
            store, path = _store(file)
            with store.open_input_file(path) as source:
                for batch in pyarrow.parquet.ParquetFile(source, buffer_size=1 << 20).iter_batches(batch_size=16, columns=["context", "bucket", "odds"]):
                    for context, bucket, odds in zip(*(batch.column(c) for c in ("context", "bucket", "odds"))):
                        yield context.as_py(), bucket.as_py(), np.frombuffer(odds.as_buffer(), np.int8)

    def parts(self) -> Iterator[tuple[int, int, np.ndarray]]:
        if self.held is None:
            self.held, self.rest, size = [], [], 0
            for file in self.files:
                if size > HELD_BYTES:
                    self.rest.append(file)
                    continue
                for row in self._rows([file]):
                    if size <= HELD_BYTES:
                        self.held.append((row[0], row[1], row[2].copy()))
                        size += len(row[2])
                    elif file not in self.rest:
                        self.rest.append(file)      # its first rows are then met twice, with the same result
        yield from self.held
        yield from self._rows(self.rest)


def bit_model(training: DataFrame, steps: Steps) -> Tables:
    """Log-odds tables of all contexts, counted over all training texts.

    Tasks send sorted pairs of contexts and bytes, which are added up bucket by bucket and tell how many
    states there are; a table has at least twice as many slots. The driver holds the sizes alone.
    """
    layout = "context int, bucket int, keys binary, times binary"
    pairs = training.select("text").mapInArrow(_pair_counts, layout)
    dealt = pairs.repartition("context", "bucket").sortWithinPartitions("context", "bucket")
    summed = steps.keep(dealt.mapInArrow(_sum_pairs, layout + ", states long"), "pairs")
    states = {r[0]: r[1] for r in summed.groupBy("context").agg(F.sum("states")).collect()}
    bits = [table_bits(states.get(k, 0)) for k in range(CONTEXTS)]
    odds = steps.keep(summed.mapInArrow(_table_parts(bits), "context int, bucket int, odds binary"), "odds")
    steps.drop(summed)
    return Tables(odds.inputFiles(), bits)


def _stored_odds(stream: Stream, tables: Tables | list[np.ndarray]) -> np.ndarray:
    """A row for each byte and a number for each context: the log-odds that it gives for each of the eight bits."""
    found = np.zeros((len(stream.data), CONTEXTS, 8), np.int8)
    if isinstance(tables, list):
        bits = [len(t).bit_length() - 1 for t in tables]
        parts = ((k, b, t.reshape(1 << BUCKET_BITS, -1)[b]) for k, t in enumerate(tables) for b in range(1 << BUCKET_BITS))
    else:
        bits, parts = tables.bits, tables.parts()
    dealt = []
    for context, size in zip(stream.contexts, bits):
        bucket, slot = _slots(context & ~_BYTE, size)
        bucket = bucket.astype(np.uint16)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        bounds = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1 << BUCKET_BITS))])
        dealt.append((order, bounds, slot[order].astype(np.int32)))
    nodes = np.ascontiguousarray(NODES.T)
    for k, b, odds in parts:
        order, bounds, slot = dealt[k]
        own = slice(bounds[b], bounds[b + 1])
        if own.start < own.stop:
            at = order[own]
            found[at, k] = odds[slot[own][:, None] ^ nodes[stream.data[at]]]
    return found.reshape(len(stream.data), CONTEXTS * 8).view(np.uint64)


class Lanes:
    """Segments of texts side by side: the places of their first bytes, then of their second ones, and so on; long ones come first."""

    def __init__(self, bounds: np.ndarray):
        sizes = np.diff(bounds)
        n = (sizes + SEGMENT - 1) // SEGMENT
        text = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(sizes[text] - inner * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")        # lanes that end leave from the back
        self.length, self.text = length[order], text[order]
        start = (bounds[text] + inner * SEGMENT)[order]
        self.live = np.searchsorted(-self.length, -np.arange(int(self.length[0])), "left")
        self.places = np.concatenate([start[:live] + t for t, live in enumerate(self.live.tolist())])


def _mixed(lanes: Lanes, turned: list[np.ndarray], start_weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Each text's log-probability, and the sum of all segments' last weights with the number of bytes as their own weight.

    `turned` has arrays with a row for each byte in the order of the lanes and a number for each context: the
    log-odds of its eight bits, turned to speak for the bit that is there. Bits of a place in the byte have
    weights of their own, so the eight places move side by side.
    """
    first = np.full((8, CONTEXTS), START) if start_weights is None else start_weights
    weights = np.empty((CONTEXTS, 8 * len(lanes.text)), np.float32)        # for log-odds in stored steps, negative
    weights[:] = np.tile((-first / LEVELS).astype(np.float32).T, len(lanes.text))
    rate, one, most = np.float32(RATE / LEVELS ** 2), np.float32(1), np.float32(40)
    total, cost = np.zeros(len(lanes.text), np.float64), np.ones(8 * len(lanes.text), np.float64)
    odds, moves, now, mixed = np.empty_like(weights), np.empty_like(weights), weights, np.empty(weights.shape[1], np.float32)
    at, logged = 0, cost

    def log() -> None:
        live = len(logged) // 8
        total[:live] -= np.log(logged).reshape(live, 8).sum(1)
        logged[:] = 1

    for t, live in enumerate(lanes.live.tolist()):
        if t % LOGGED == 0 and t:
            log()
            logged = cost[:8 * live]
        if len(mixed) > 8 * live:
            now, odds, moves, mixed = weights[:, :8 * live], odds[:, :8 * live], moves[:, :8 * live], mixed[:8 * live]
        k = 0
        for part in turned:
            of = part[at:at + live].T
            odds[k:k + len(of)] = np.ascontiguousarray(of).view(np.int8)
            k += len(of)
        at += live
        np.einsum("kl,kl->l", odds, now, out=mixed)
        np.minimum(mixed, most, out=mixed)
        np.exp(mixed, out=mixed)                # odds against the bit
        mixed += one                            # one over the bit's probability
        cost[:8 * live] *= mixed
        np.divide(rate, mixed, out=mixed)
        mixed -= rate                           # minus the probability of the other bit
        np.multiply(odds, mixed, out=moves)
        now += moves
    log()
    ends = np.einsum("klj,l->jk", weights.reshape(CONTEXTS, -1, 8), lanes.length.astype(np.float64)) * -LEVELS
    return np.bincount(lanes.text, total), ends, len(lanes.places)


def log_probabilities(texts: B.Texts, tables: Tables | list[np.ndarray], start_weights: np.ndarray | None = None) -> np.ndarray:
    """The natural log of each text's probability, its end included, by tables as they are stored."""
    stream = Stream(texts)
    lanes = Lanes(stream.bounds)
    odds = _stored_odds(stream, tables)
    turned = odds.view(np.int8).reshape(-1, CONTEXTS, 8) * _TURNS.take(stream.data, axis=0)[:, None, :]
    return _mixed(lanes, [turned.reshape(len(odds), -1).view(np.uint64).take(lanes.places, axis=0)], start_weights)[0]


_SPREAD = np.uint64(0x9E3779B97F4A7C15)      # odd


class Places:
    """Where each of some distinct numbers of 64 bits is, found by its hash; only numbers that are there may be looked for.

    A number that is alone in its slot is known by that; those that share slots are dealt anew into the next table.
    """

    def __init__(self, keys: np.ndarray):
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        place, spread = np.arange(len(keys), dtype=np.int32), _SPREAD
        while len(place) and len(self.tables) < 24:
            shift = np.uint64(64 - max(8, int(4 * len(place)).bit_length()))
            slot = ((keys * spread) >> shift).view(np.int64)
            table = np.full(1 << (64 - int(shift)), -1, np.int32)
            table[slot] = place
            lost = table.take(slot) != place
            table[slot[lost]] = -1
            self.tables.append((spread, shift, table))
            shared = np.flatnonzero(table.take(slot) < 0)
            place, keys, spread = place[shared], keys[shared], B.mix(np.array([spread]))[0] | np.uint64(1)
        self.rest = dict(zip(keys.tolist(), place.tolist()))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = more = None
        for spread, shift, table in self.tables:
            found = table.take(((keys * spread) >> shift).view(np.int64))
            open_ = np.flatnonzero(found < 0)
            if at is None:
                at, more = found, open_
            else:
                at[more] = found
                more = more[open_]
            if not len(more):
                return at
            keys = keys[open_]
        at[more] = [self.rest[key] for key in keys.tolist()]
        return at


def _file_rows(store: pyarrow.fs.FileSystem, path: str, columns: list[str], wanted: pa.compute.Expression) -> dict[int, list[tuple]]:
    """By context: (bucket, bytes) of the wanted rows of a file, in the order of buckets."""
    found: dict[int, list[tuple]] = {}
    with store.open_input_file(path) as source:
        for batch in pyarrow.parquet.ParquetFile(source).iter_batches(columns=columns):
            for context, *row in zip(*(c.to_pylist() for c in batch.filter(wanted).select(["context", "bucket", columns[-1]]).columns)):
                found.setdefault(context, []).append(tuple(row))
    return {context: sorted(rows) for context, rows in found.items()}


class Answers:
    """The log-odds of all pairs of one slice, from the file that was written for it; `dealt` is the file with its rows."""

    def __init__(self, folder: str, dealt: str, name: str, own: bool):
        store, path = _store(dealt)
        keys = _file_rows(store, path, ["slice", "context", "bucket", "keys"],
                          (pa.compute.field("slice") == name) & pa.compute.field("context").isin([CHAINS, len(ORDERS), WORDS]))
        store, base = _store(folder)
        found: dict[int, list[tuple]] = {}
        for info in store.get_file_info(pyarrow.fs.FileSelector(f"{base}/slice={name}")):
            if info.base_name.endswith(".parquet"):
                for context, rows in _file_rows(store, info.path, ["context", "bucket", "odds"], pa.compute.field("context") >= 0).items():
                    found[context] = sorted(found.get(context, []) + rows)

        def odds_of(context: int, pairs: np.ndarray) -> np.ndarray:
            rows = np.concatenate([_from_planes(odds) for _, odds in found[context]])
            if len(rows) != len(pairs):
                raise ValueError(f"the answers do not fit slice {name}")
            odds = _filled(rows, pairs)
            if own:       # texts that were counted themselves
                odds = _BEFORE.take(odds.view(np.uint8)).view(np.uint64)
            return (odds.view(np.int8).reshape(-1, 8) * _TURNS.take((pairs & _BYTE).astype(np.intp), axis=0)).view(np.uint64).ravel()

        chains, words, whole = (np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(_from_planes(k), dtype=np.uint64) for _, k in keys.get(context, []))])
                                for context in (CHAINS, len(ORDERS), WORDS))
        self.chain_odds = np.empty((len(chains), len(ORDERS)), np.uint64)
        pairs, place, longer = chains, None, max(ORDERS)
        for number in range(len(ORDERS) - 1, -1, -1):
            order = ORDERS[number]
            if order < longer:
                pairs, at = _placed(_shorter(pairs, longer, order))
                place, longer = at if place is None else at.take(place), order
            hashed, at = _placed(_hashed(pairs, order))
            odds = odds_of(number, hashed).take(at)
            self.chain_odds[:, number] = odds if place is None else odds.take(place)
        self.chains, self.words, self.word_odds = Places(chains), Places(words), odds_of(len(ORDERS), words)
        self.whole = whole, np.concatenate([np.zeros(0, np.uint64), *(_from_planes(n) for _, n in found.get(WORDS, []))]).view(np.int64)

    def __call__(self, stream: Stream, lanes: Lanes) -> list[np.ndarray]:
        chain, word = (places(pair).take(lanes.places) for places, pair in zip((self.chains, self.words), stream.pairs()))
        return [self.chain_odds.take(chain, axis=0), self.word_odds.take(word)[:, None]]

    def times(self, words: np.ndarray) -> np.ndarray:
        """How often each hashed word is in all training texts."""
        keys, n = self.whole
        order, times = np.argsort(words), np.empty(len(words), np.int64)
        times[order] = n.take(np.searchsorted(keys, words[order]))      # in rising order, a quicker search
        return times


def _state_odds(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Stored log-odds of the eight states of each pair; pairs are in rising order, so those of a state are neighbours."""
    found = np.empty((len(key), 8), np.int8)
    other, total, byte = _unlike(key), np.concatenate([[0], np.cumsum(n)]), (key & _BYTE).astype(np.uint8)
    for j in range(8):
        first = np.flatnonzero(other >= np.uint64(1 << (8 - j)))
        end = np.append(first[1:], len(key))
        ones = np.add.reduceat(n * ((byte >> (7 - j)) & 1), first)
        found[:, j] = np.repeat(_odds(total[end] - total[first] - ones, ones), end - first)
    return found.view(np.uint64).ravel()


def _unlike(key: np.ndarray, begin: np.ndarray | int = 0) -> np.ndarray:
    """The bits in which numbers differ from the one before; all bits where a list begins."""
    other = np.empty_like(key)
    np.bitwise_xor(key[1:], key[:-1], out=other[1:])
    other[begin] = ~np.uint64(0)
    return other


_TURNS = np.ascontiguousarray(-SIGNS.T).astype(np.int8)


def _thinned(odds: np.ndarray, key: np.ndarray, begin: np.ndarray | int = 0) -> np.ndarray:
    """The log-odds of pairs in rising order, for packing: each state once, for the bit that is there, less the next state's.

    Several lists may come one after the other; `begin` tells where.
    """
    rows = odds.view(np.int8).reshape(-1, 8) * _TURNS.take((key & _BYTE).astype(np.intp), axis=0)
    rows[:, :7] -= rows[:, 1:]
    other = _unlike(key, begin)
    for j in range(8):
        rows[other < np.uint64(1 << (8 - j)), j] = 0       # the pair before has this state too
    return rows.view(np.uint64).ravel()


def _filled(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """What :func:`_thinned` was given."""
    odds = np.cumsum(rows.view(np.int8).reshape(-1, 8)[:, ::-1], axis=1, dtype=np.int8)[:, ::-1]
    odds = odds * _TURNS.take((key & _BYTE).astype(np.intp), axis=0)
    other = _unlike(key)
    for j in range(8):
        first = np.flatnonzero(other >= np.uint64(1 << (8 - j)))
        odds[:, j] = np.repeat(odds[first, j], np.diff(np.append(first, len(key))))
    return np.ascontiguousarray(odds).view(np.uint64).ravel()


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every slice the log-odds of its pairs in each bucket, and the times of its words, in their order; rows come by bucket.

    For words also the sum of their times and how many are there, as of a slice TOTALS.
    """
    at, names, keys, times = None, [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        key, n = _merged(keys, times)
        if at[0] == WORDS:
            yield answer([TOTALS, *names], [_planes(np.array([n.sum(), np.count_nonzero(n)]).view(np.uint64)),
                                            *(_planes(n.take(np.searchsorted(key, k)).view(np.uint64)) for k in keys)])
            return
        odds = _state_odds(key, n)
        made, cuts = [], np.cumsum([0, *map(len, keys)])
        for some in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(cuts[:-1] // ANSWERED_PAIRS)) + 1):      # lists of several slices at once
            own = np.concatenate([keys[i] for i in some])
            begin = cuts[some] - cuts[some[0]]
            rows = _thinned(odds.take(np.searchsorted(key, own)), own, begin)
            made += [_planes(rows[a:b]) for a, b in zip(begin, np.append(begin[1:], len(own)))]
        yield answer(names, made)

    def answer(names: list[str], made: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(np.full(len(names), at[0], np.int32)), pa.array(np.full(len(names), at[1], np.int32)),
             pa.array(made, pa.binary())], ["slice", "context", "bucket", "odds"])

    for batch in batches:
        for name, context, bucket, key, n in zip(*(batch.column(c).to_pylist() for c in ("slice", *_PAIRS))):
            if (context, bucket) != at:
                if at:
                    yield from done()
                at, names, keys, times = (context, bucket), [], [], []
            key, n = _unpacked(key, n)
            names.append(name)
            keys.append(key)
            times.append(n)
    if at:
        yield from done()


def answered(dealt: DataFrame, steps: Steps) -> str:
    """The folder of the answers to the slices of `dealt`, a step that :func:`_deal` made.

    Every state is counted once over all slices, and what a slice asked for goes back to it. No states
    go through the driver or to all tasks. Orders, words so far and words have rounds of their
    own, so that shuffle files of half the pairs are there at once.
    """
    folder = steps.path("answers")
    for numbers in (*ROUNDS, [WORDS]):
        asked = dealt.filter(F.col("context").isin([k for k in numbers if k >= len(ORDERS)])).select("slice", *_PAIRS)
        orders = [k for k in numbers if k < len(ORDERS)]
        if orders:
            asked = asked.unionByName(dealt.filter(f"context = {CHAINS}").select("slice", "keys", "times").mapInArrow(
                B.tidy(_asked(orders)), "slice string, context int, bucket int, keys binary, times binary"))
        found = (asked.repartition("context", "bucket").sortWithinPartitions("context", "bucket")
                 .mapInArrow(B.tidy(_answers), "slice string, context int, bucket int, odds binary"))
        found.repartition("slice").write.mode("append").partitionBy("slice").parquet(folder)
        del asked, found
        steps.release()
    return folder


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, pa.RecordBatch]]:
    """The rows of the batches, those of one slice at once."""
    for batch in batches:
        names = batch.column("slice").to_pylist()
        cuts = [0] + [i for i in range(1, len(names)) if names[i] != names[i - 1]] + [len(names)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield names[a], batch.column("file")[a].as_py(), batch.slice(a, b - a)


def _answered(batches: Iterator[pa.RecordBatch], folder: str, own: bool) -> Iterator[tuple[pa.RecordBatch, B.Texts, Answers]]:
    answers, name = None, None
    for now, file, batch in _by_slice(batches):
        if now != name:
            answers = None          # one slice is held at a time
            answers, name = Answers(folder, file, now, own), now
        for rows, texts in B.text_slices(iter([batch]), limit=SCORED_BYTES):
            yield rows, texts, answers


def _last_weights(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((8, CONTEXTS)), 0
        for _, texts, answers in _answered(batches, folder, True):
            stream = Stream(texts)
            lanes = Lanes(stream.bounds)
            _, weights, size = _mixed(lanes, answers(stream, lanes), None)
            total, n = total + weights, n + size
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(total.size)), pa.array(total.ravel()), pa.array(np.full(total.size, n))], ["place", "weight", "n"])
    return run


def learned_weights(training: DataFrame, folder: str) -> np.ndarray | None:
    """The mean of the weights that segments of all training texts end with; None without such texts.

    The texts are among those that were counted, so states that have seen one bit only lose it once.
    """
    found = (training.select("text", "slice", "file").mapInArrow(B.tidy(_last_weights(folder)), "place long, weight double, n long")
             .groupBy("place").agg((F.sum("weight") / F.sum("n")).alias("weight")).orderBy("place").collect())
    return np.array([r.weight for r in found]).reshape(8, CONTEXTS) if found else None


def _word_hashes(texts: B.Texts) -> tuple[np.ndarray, B.Words]:
    words = B.words_of(texts)
    return B.SpanHasher(texts.data, B.FOLDED_VALUES)(words.starts, words.ends), words


def word_totals(spark: SparkSession, folder: str) -> tuple[int, int]:
    """Of all training texts: the number of words, and of distinct ones. The driver gets two numbers of each bucket."""
    found = (spark.read.schema("context int, bucket int, odds binary, slice string").parquet(folder)
             .filter((F.col("slice") == TOTALS) & (F.col("context") == WORDS)).select("odds").collect())
    return tuple(sum(int(_from_planes(r.odds)[k]) for r in found) for k in (0, 1))


def _score(folder: str, n: int, v: int, ends: int, start_weights: np.ndarray | None):
    def share(times):
        return np.log10((times + 0.5) / (n + 0.5 * (v + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts, answers in _answered(batches, folder, False):
            hashes, found = _word_hashes(texts)
            times = answers.times(hashes)
            stream = Stream(texts)
            lanes = Lanes(stream.bounds)
            log = _mixed(lanes, answers(stream, lanes), start_weights)[0]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(found.bounds) + 1),
                 pa.array(B.sums_between((times > 0).astype(np.int64), found.bounds) + int(ends > 0)), pa.array(np.full(len(texts), n, np.int64)),
                 pa.array(B.sums_between(share(times), found.bounds) + share(ends)),
                 pa.array(log / np.log(10)), pa.array(-log / np.log(2) / np.maximum(np.diff(texts.bounds), 1))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])
    return run


def language_scores(docs: DataFrame, steps: Steps | None = None) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Words meet their counts in their buckets, as the states of contexts do. A null text counts as
    empty: its end alone is a token. A null doc_id is in no held-out fold and is learned from.
    Repeated rows give a row each; without training documents every word is unknown. Other columns
    are ignored.
    """
    spark = session_of(docs)
    steps = steps or Steps(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    dealt = steps.keep(rows.mapInArrow(B.tidy(_deal), _DEALT), "dealt", compression="zstd")
    texts = dealt.filter("context is null").select("doc_id", "held_out", "text", "slice", F.col("_metadata.file_path").alias("file"))
    ends = texts.filter("not held_out").count()
    answers = answered(dealt, steps)
    n, v = word_totals(spark, answers)
    start_weights = learned_weights(texts.filter("not held_out"), answers)
    scored = steps.keep(texts.mapInArrow(
        B.tidy(_score(answers, n + ends, v + int(ends > 0), ends, start_weights)),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"), "scored")
    steps.drop(dealt)
    steps.remove(answers)
    return scored
