"""Token ids as length-delimited binary records with a separate offset index.

A file is a sequence of records. A record is

    length       8 bytes, little endian: bytes of the message
    length sum   4 bytes: masked CRC-32C of the length
    message      doc_id as 8 bytes (NO_ID for null), then the ids, ID_BYTES bytes each, little endian
    message sum  4 bytes: masked CRC-32C of the message

The index, a Parquet table, has the file number, offset and length of every record, so a shuffled
reader (`shuffled`, `fetch`) gets any record with one ranged read. Files are in ascending doc_id order, within a file
and from one file number to the next.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourmart.llm import batches as B
from hourmart.llm.span_cache import SpanCache
from hourmart.llm.staging import Steps, session_of

END_ID = 0                    # appended to each document
NO_ID = -(1 << 63)            # stands for a null doc_id
READ_BYTES = 1 << 22          # files are read in parts of this size
HELD_SPANS = 1 << 20          # encoded spans that a worker keeps; with fewer, most of a task's spans are encoded again
OPEN_FILES = 16               # of a task that reads by the index
_POLYNOMIAL = 0x82F63B78      # CRC-32C, reflected
_MASK_DELTA = 0xA282EAD8
_CHUNK = 256                  # bytes whose sums are worked out side by side


@lru_cache(maxsize=1)
def _crc_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Byte tables for 8 bytes at a time, and tables that move a sum over 2**k chunks of zero bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(_POLYNOMIAL), step >> 1).astype(np.uint32)
    tables = [step]
    for _ in range(7):
        tables.append(step[tables[-1] & 0xFF] ^ (tables[-1] >> 8))

    def table_of(move) -> np.ndarray:
        return np.stack([move((np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32)) for k in range(4)])

    def over_chunk(c: np.ndarray) -> np.ndarray:
        for _ in range(_CHUNK):
            c = step[c & 0xFF] ^ (c >> 8)
        return c

    moves = [table_of(over_chunk)]
    for _ in range(31):
        last = moves[-1]
        moves.append(table_of(lambda c: _move(last, _move(last, c))))
    return np.stack(tables), moves


def _move(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    return table[0][c & 0xFF] ^ table[1][(c >> 8) & 0xFF] ^ table[2][(c >> 16) & 0xFF] ^ table[3][c >> 24]


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32C of many spans (4 bytes at least) of a byte array.

    Spans are cut into chunks that end where the span ends; leading zero bytes change nothing, so
    the first chunk is filled up with them. The sums of all chunks advance side by side and are then
    moved to the end of their span and joined.
    """
    tables, moves = _crc_tables()
    n = (ends - starts + _CHUNK - 1) // _CHUNK
    owner = np.repeat(np.arange(len(n)), n)
    behind = np.repeat(np.cumsum(n), n) - 1 - np.arange(len(owner))      # chunks after this one
    total = np.zeros(len(starts), np.uint32)
    lanes = np.arange(_CHUNK)
    for at in range(0, len(owner), 4096):
        own, left = owner[at:at + 4096], behind[at:at + 4096]
        where = (ends[own] - (left + 1) * _CHUNK)[:, None] + lanes
        skip = starts[own][:, None] - where                              # over 0 before the span
        block = np.where(skip > 0, 0, data[np.maximum(where, 0)])
        block[(skip <= 0) & (skip > -4)] ^= 0xFF                         # the starting value of the sum
        c = np.zeros(len(own), np.uint32)
        for i in range(0, _CHUNK, 8):
            b = block[:, i:i + 8].astype(np.uint32)
            c = (tables[7][b[:, 0] ^ (c & 0xFF)] ^ tables[6][b[:, 1] ^ ((c >> 8) & 0xFF)]
                 ^ tables[5][b[:, 2] ^ ((c >> 16) & 0xFF)] ^ tables[4][b[:, 3] ^ (c >> 24)]
                 ^ tables[3][b[:, 4]] ^ tables[2][b[:, 5]] ^ tables[1][b[:, 6]] ^ tables[0][b[:, 7]])
        for k in range(int(left.max()).bit_length()):
            far = np.flatnonzero((left >> k) & 1)
            c[far] = _move(moves[k], c[far])
        np.bitwise_xor.at(total, own, c)
    return total ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


def frame(messages: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The records of messages that lie one after the other, and the records' bounds."""
    sizes = np.diff(bounds)
    starts = np.concatenate([[0], np.cumsum(sizes + 16)])
    out = np.empty(int(starts[-1]), np.uint8)
    lengths = sizes.astype("<u8").view(np.uint8)
    count = np.arange(len(sizes)) * 8
    heads = np.concatenate([lengths.reshape(-1, 8), masked(crc32c(lengths, count, count + 8)).astype("<u4").view(np.uint8).reshape(-1, 4)], axis=1)
    tails = masked(crc32c(messages, bounds[:-1], bounds[1:])).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts[:-1, None] + np.arange(12)] = heads
    out[starts[1:, None] - 4 + np.arange(4)] = tails
    for a, b, at in zip(bounds[:-1].tolist(), bounds[1:].tolist(), starts.tolist()):
        out[at + 12:at + 12 + b - a] = messages[a:b]
    return out, starts


def unframe(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Starts and ends of the messages of all whole records at the front of raw, and where these end."""
    starts, ends, at, n = [], [], 0, len(raw)
    view = memoryview(raw)
    while at + 12 <= n:
        size = int.from_bytes(view[at:at + 8], "little")
        if at + 16 + size > n:
            break
        starts.append(at + 12)
        ends.append(at + 12 + size)
        at += 16 + size
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)

    def sums(where: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(raw[where[:, None] + np.arange(4)]).view("<u4").ravel()

    if (len(starts) and (np.any(masked(crc32c(raw, starts - 12, starts - 4)) != sums(starts - 4))
                         or np.any(masked(crc32c(raw, starts, ends)) != sums(ends)))):
        raise ValueError("a record's checksum does not match")
    return starts, ends, at


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or path; local URIs may come with one slash."""
    if folder.startswith("file:/"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(folder)


def _file(base: str, part: int) -> str:
    return f"{base}/part-{part:06d}.records"


def piece_spans(texts: B.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans that cover the texts and can be encoded one by one, and the spans' bounds by text.

    Byte-level pre-tokens never reach over white space but for one leading blank, and never join an
    ASCII letter with punctuation other than an apostrophe. So a text can be cut before a single
    blank between two characters that are no white space, and before punctuation after a letter.
    Bytes near lead bytes of Unicode white space (C2, E1-E3) are not cut at.
    """
    data, n = texts.data, len(texts.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts.bounds), np.int64)
    kind = _KINDS[data]
    lead = (kind & 1).astype(bool)
    cut = np.zeros(n, bool)
    if n > 4:
        solid = (kind & 2).astype(bool)
        cut[3:-1] = ((data[3:-1] == 0x20) & solid[2:-2] & solid[4:] & ~lead[1:-3] & ~lead[:-4] & ~lead[4:])
        cut[1:] |= ((kind[1:] & 8) > 0) & ((kind[:-1] & 4) > 0)
    cut[texts.bounds[:-1][texts.bounds[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, texts.bounds)


_KINDS = np.zeros(256, np.uint8)
_KINDS[[0xC2, 0xE1, 0xE2, 0xE3]] |= 1
_KINDS[0x21:0x7F] |= 2
_KINDS[0x80:] |= 2
_KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] |= 4
_KINDS[[b for b in [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)] if b != 0x27]] |= 8


@lru_cache(maxsize=2)
def _encoder(path: str) -> tuple[SpanCache, int]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (SpanCache(lambda strings: [e.ids for e in tokenizer.encode_batch_fast(strings, add_special_tokens=False)], HELD_SPANS),
            2 if tokenizer.get_vocab_size() <= 1 << 16 else 4)


def encoded(texts: B.Texts, path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids of all texts, each with the end id, their bounds, and the bytes an id takes in a file."""
    cache, width = _encoder(path)
    starts, ends, spans = piece_spans(texts)
    if b"<|" in texts.data.tobytes():        # special tokens are found in the whole text
        raw, found = texts.data.tobytes(), []
        for a, b in zip(texts.bounds.tolist(), texts.bounds[1:].tolist()):
            found.append(cache.make([raw[a:b].decode()])[0])
        bounds = np.concatenate([[0], np.cumsum([len(f) for f in found])])
        ids = np.array([i for f in found for i in f], np.uint32)
    else:
        ids, inner = cache.encode(texts, starts, ends)
        bounds = inner[spans]
    ids = np.insert(ids, bounds[1:], END_ID)
    return ids, bounds + np.arange(len(bounds)), width


def _writer(folder: str, path: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, found, offset = TaskContext.get().partitionId(), [], 0
        store, base = _store(folder)
        # an attempt writes a file of its own and moves it to its place; a later attempt puts the same bytes there
        own = f"{base}/attempt-{part:06d}-{uuid.uuid4().hex}"
        out = None
        for rows, texts in B.text_slices(batches):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(own)
            ids, bounds, width = encoded(texts, path)
            n = len(texts)
            doc_ids = rows.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
            head, body = doc_ids.view(np.uint8).reshape(n, 8), ids.astype(f"<u{width}").view(np.uint8)
            ends = bounds * width
            sizes = np.diff(ends) + 8
            at = np.concatenate([[0], np.cumsum(sizes)])
            messages = np.empty(int(at[-1]), np.uint8)
            messages[at[:-1, None] + np.arange(8)] = head
            for i, (a, b) in enumerate(zip(ends.tolist(), ends[1:].tolist())):
                messages[at[i] + 8:at[i + 1]] = body[a:b]
            records, places = frame(messages, at)
            out.write(records)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part, np.int64)), rows.column("doc_id"), pa.array(offset + places[:-1]),
                 pa.array(np.diff(places)), pa.array(np.diff(bounds))],
                ["part", "doc_id", "offset", "length", "n_tokens"])
            offset += len(records)
        if out is not None:
            out.close()
            store.move(own, _file(base, part))
    return write


def write_records(docs: DataFrame, path: str, folder: str, index: str) -> None:
    """Writes the files into `folder` and the index to `index`; a null text counts as empty.

    Rows are dealt by ranges of (doc_id, hash of the text), so files follow each other in doc_id
    order and rows that share a doc_id are spread and have a fixed order. Every file is written by
    one task and put in place when whole, so a lost executor leaves no half file.
    """
    session_of(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    key = F.xxhash64("text")
    dealt = rows.repartitionByRange("doc_id", key).sortWithinPartitions("doc_id", key)
    (dealt.mapInArrow(_writer(folder, path), "part long, doc_id long, offset long, length long, n_tokens long")
     .write.parquet(index))


def _reader(folder: str, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("start").to_pylist()):
                with store.open_input_stream(_file(base, part)) as file:
                    rest = b""
                    while more := file.read(max(READ_BYTES, len(rest))):
                        raw = np.frombuffer(rest + more, np.uint8)
                        starts, ends, done = unframe(raw)
                        rest = raw[done:].tobytes()
                        if not len(starts):
                            continue
                        counts = (ends - starts - 8) // width
                        sums = [zlib.crc32(raw[a + 8:b].view(f"<u{width}").astype("<u4")) for a, b in zip(starts.tolist(), ends.tolist())]
                        ids = np.ascontiguousarray(raw[starts[:, None] + np.arange(8)]).view("<i8").ravel()
                        before = start + np.cumsum(counts) - counts
                        start = int(before[-1] + counts[-1])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(ids, mask=ids == NO_ID), pa.array(before), pa.array(counts), pa.array(np.array(sums, np.int64))],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])
                    if rest:
                        raise ValueError(f"file {part} ends within a record")
    return read


def read_records(spark: SparkSession, folder: str, index: str, width: int) -> DataFrame:
    """Per record of all files: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""
    sizes = spark.read.parquet(index).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))   # one row a file
    files = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    # a stated number of partitions, a file each; adaptive execution would merge rows as small as these into one task
    return files.repartition(max(sizes.count(), 1)).mapInArrow(
        _reader(folder, width), "doc_id long, start long, n_tokens long, ids_crc32 long")


def shuffled(index: DataFrame, seed: int = 0) -> DataFrame:
    """The index's records in a random order that depends on `seed` only, spread over partitions."""
    order = F.xxhash64(F.lit(seed), "part", "offset")
    return index.withColumn("place", order).repartitionByRange("place").sortWithinPartitions("place", "part", "offset")


def _fetcher(folder: str, width: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        files: OrderedDict[int, pyarrow.NativeFile] = OrderedDict()

        def record(part: int, offset: int, length: int) -> bytes:
            if part not in files:
                if len(files) >= OPEN_FILES:
                    files.popitem(last=False)[1].close()
                files[part] = store.open_input_file(_file(base, part))
            files.move_to_end(part)
            return files[part].read_at(length, offset)

        def made(places: list[tuple[int, int, int]], raw: list[bytes]) -> pa.RecordBatch:
            data = np.frombuffer(b"".join(raw), np.uint8)
            starts, ends, _ = unframe(data)
            if not np.array_equal(ends + 4, np.cumsum([length for _, _, length in places])):
                raise ValueError("the index does not fit the files")
            doc_ids = np.ascontiguousarray(data[starts[:, None] + np.arange(8)]).view("<i8").ravel()
            ids = np.concatenate([data[a + 8:b].view(f"<u{width}") for a, b in zip(starts.tolist(), ends.tolist())]).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum((ends - starts - 8) // width)])
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64()),
                 pa.array(doc_ids, mask=doc_ids == NO_ID), B.list_array(ids, bounds)], ["part", "offset", "doc_id", "ids"])

        places, raw, size = [], [], 0
        try:
            for batch in batches:
                for place in zip(*(batch.column(c).to_pylist() for c in ("part", "offset", "length"))):
                    places.append(place)
                    raw.append(record(*place))
                    size += len(raw[-1])
                    if size >= READ_BYTES:
                        yield made(places, raw)
                        places, raw, size = [], [], 0
            if places:
                yield made(places, raw)
        finally:
            for file in files.values():
                file.close()
    return read


def fetch(wanted: DataFrame, folder: str, width: int) -> DataFrame:
    """Per row of `wanted` (part, offset and length as the index has them), in its order: part, offset, doc_id, ids.

    One ranged read a record; its checksums are tested, and rows that no record fits raise. At most
    OPEN_FILES files are open in a task and READ_BYTES of records and one more held. No rows give none.
    """
    return wanted.select("part", "offset", "length").mapInArrow(
        _fetcher(folder, width), "part long, offset long, doc_id long, ids array<long>")


def token_records(docs: DataFrame, path: str, steps: Steps | None = None) -> DataFrame:
    """Encodes documents with the vocabulary file at `path`, writes the files and reads them back.

    Per document: doc_id, start, n_tokens (with the end id), ids_crc32, all from the files, with every
    checksum tested. Null and empty texts hold the end id alone. A null doc_id comes first. Repeated
    rows have a record each; an empty table has no files and no rows. Other columns are ignored.
    """
    spark = session_of(docs)
    steps = steps or Steps(spark)
    folder, index = steps.path("records"), steps.path("index")
    write_records(docs, path, folder, index)
    return read_records(spark, folder, index, _encoder(path)[1])
