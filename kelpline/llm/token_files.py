"""Token ids as binary files of patched frame-of-reference blocks.

A file is a row of frames, each of whole documents in ascending doc_id order:

    "PFR1" | frame bytes u32 | part u32 | frame number u32 | documents u32 | block size u32 | blocks u32 | ids u64
    doc_id i64 each (null: -2**63) | ids of each document u32 | index: where each block starts, and the last ends, u32
    blocks: minimum u32 | width u8 | 0 u8 | exceptions u16 | packed bits | places u16 each | values u32 each

A block's ids, less its minimum, are packed at a bit width that holds a percentile of them; the percentile (of
PERCENTILES) is the one that makes the block shortest.  Larger values stand in the exception list, with their places.
Spark's own writer makes the files, one for each range of doc_id, so its commit protocol holds if executors are lost;
its line end after each frame is skipped by the reader.  A file holds FILE_FRAMES frames at most, so readers hold a bounded
piece, however large the corpus; read_span decodes only the blocks of a range of ids, found by the index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelpline.llm.common import new_folder, stored
from kelpline.llm.tokens import tokenizer, word_vocabulary

HEAD = struct.Struct("<4sIIIIIIQ")
PERCENTILES = (0.5, 0.75, 0.9, 0.97, 1.0)
BLOCK = 512
FILE_FRAMES = 8
NULL_ID = -(1 << 63)
ENTRY = np.dtype([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("exceptions", "<u2")])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack_bits(rows: np.ndarray, w: int) -> np.ndarray:
    """The low w bits of each value of (n, size) rows, as (n, size * w / 8) bytes: eight values make w bytes."""
    eights = rows.reshape(-1, 8).astype(np.uint64) & np.uint64((1 << w) - 1)
    words = np.zeros((len(eights), max(1, -(-w // 8))), np.uint64)
    for k in range(8):
        word, shift = divmod(k * w, 64)
        words[:, word] |= eights[:, k] << np.uint64(shift)
        if shift + w > 64:
            words[:, word + 1] |= eights[:, k] >> np.uint64(64 - shift)
    return words.astype("<u8").view(np.uint8)[:, :w].reshape(len(rows), -1)


def unpack_bits(packed: np.ndarray, w: int, size: int) -> np.ndarray:
    """The (n, size) values of rows packed by pack_bits."""
    at = np.arange(size) * w
    padded = np.concatenate([packed, np.zeros((len(packed), 5), np.uint8)], axis=1)
    out = np.zeros((len(packed), size), np.uint64)
    for k in range((w + 14) // 8):
        out |= padded[:, at // 8 + k].astype(np.uint64) << np.uint64(8 * k)
    return ((out >> (at % 8).astype(np.uint64)) & np.uint64((1 << w) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, bytes]:
    """The index of block starts and the blocks of ids; the last block is filled up with its own last id."""
    if not len(ids):
        return np.zeros(1, np.uint32), b""
    n = -(-len(ids) // size)
    rows = np.full(n * size, ids[-1], np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, size)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    ranks = [max(0, int(np.ceil(q * size)) - 1) for q in PERCENTILES]
    widths = _bits(np.partition(rows, ranks, axis=1)[:, ranks])
    over = np.stack([(rows >> w[:, None].astype(np.uint32) > 0).sum(axis=1) for w in widths.T], axis=1)
    best = np.argmin(widths * size // 8 + 6 * over, axis=1)
    width = widths[np.arange(n), best]
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        for k, b in zip(at.tolist(), pack_bits(rows[at], int(w)), strict=True):
            packed[k] = b.tobytes()
    large = rows >> width[:, None].astype(np.uint32) > 0
    entries = np.zeros(n, ENTRY)
    entries["least"], entries["width"], entries["exceptions"] = least, width, large.sum(axis=1)
    row, place = np.nonzero(large)
    ends = np.cumsum(entries["exceptions"].astype(np.int64))
    heads, places, values = entries.tobytes(), place.astype("<u2").tobytes(), rows[row, place].astype("<u4").tobytes()
    blocks, i = [], 0
    for k, j in enumerate(ends.tolist()):
        blocks.append(heads[k * ENTRY.itemsize : (k + 1) * ENTRY.itemsize] + packed[k] + places[2 * i : 2 * j] + values[4 * i : 4 * j])
        i = j
    return np.cumsum([0, *map(len, blocks)]).astype("<u4"), b"".join(blocks)


def unpack_blocks(data: bytes, starts: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The ids of the blocks that begin at `starts` in data, blocks of one width at a time."""
    out = np.zeros((len(starts), size), np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = raw[starts[:, None] + np.arange(ENTRY.itemsize)].copy().view(ENTRY)[:, 0]
    for w in np.unique(heads["width"]).tolist():
        at = np.flatnonzero(heads["width"] == w)
        if not w:
            continue
        packed = raw[(starts[at] + ENTRY.itemsize)[:, None] + np.arange(w * size // 8)]
        out[at] = unpack_bits(packed, w, size)
    for k in np.flatnonzero(heads["exceptions"]).tolist():
        i, n = int(starts[k]) + ENTRY.itemsize + int(heads["width"][k]) * size // 8, int(heads["exceptions"][k])
        out[k, np.frombuffer(data, "<u2", n, i)] = np.frombuffer(data, "<u4", n, i + 2 * n)
    return out + heads["least"][:, None]


def frame(part: int, number: int, doc_ids: list, lengths: list[int], ids: np.ndarray, size: int = BLOCK) -> bytes:
    index, blocks = pack_blocks(ids, size)
    body = np.array([NULL_ID if i is None else i for i in doc_ids], "<i8").tobytes() + np.array(lengths, "<u4").tobytes()
    body += index.astype("<u4").tobytes() + blocks
    return HEAD.pack(b"PFR1", HEAD.size + len(body), part, number, len(doc_ids), size, len(index) - 1, len(ids)) + body


def frames(data: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, frame number, doc ids, lengths, ids) of each frame in a file."""
    at = 0
    while at + HEAD.size <= len(data):
        magic, length, part, number, docs, size, blocks, n = HEAD.unpack_from(data, at)
        if magic != b"PFR1":
            raise ValueError(f"no frame at byte {at}")
        p = at + HEAD.size
        doc_ids = np.frombuffer(data, "<i8", docs, p)
        lengths = np.frombuffer(data, "<u4", docs, p + 8 * docs)
        index = np.frombuffer(data, "<u4", blocks + 1, p + 12 * docs).astype(np.int64) + p + 12 * docs + 4 * (blocks + 1)
        yield part, number, doc_ids, lengths, unpack_blocks(data, index[:-1], size).reshape(-1)[:n]
        at += length + 1  # Spark's writer ends each row with a line end


def write_token_files(
    documents: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, frame_ids: int = 2_000_000
) -> None:
    """Encode whole texts and write their ids under path, in ascending doc_id order over the part files.

    documents: doc_id and text; other columns don't matter.  A null text counts as empty; rows with equal or null
    doc_id are all kept (nulls first, equal ones in the order of their texts).  An empty table writes no frames.
    frame_ids bounds what a task holds; a longer document is a frame of its own.
    """
    vocabulary = vocabulary or word_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        kept_ids: list = []
        kept: list[bytes] = []
        coder = tokenizer(vocabulary)
        width = coder.dtype.itemsize

        def made() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(kept), coder.dtype)
            return pa.RecordBatch.from_arrays([pa.array([frame(part, number, kept_ids, [len(x) // width for x in kept], ids)], pa.binary())], ["frame"])

        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc_id, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist(), end_id), strict=True):
                    kept_ids.append(doc_id)
                    kept.append(ids)
                    size += len(ids) // width
                    if size >= frame_ids:
                        yield made()
                        kept_ids, kept, size, number = [], [], 0, number + 1
        if kept:
            yield made()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = ordered.mapInArrow(encode, "frame binary")
    made.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", FILE_FRAMES).text(path)


def _bases(frames_of: DataFrame) -> DataFrame:
    """part, frame and base (ids in all frames before), from rows of part, frame and n (ids)."""
    # One row for each task that wrote, then the frames of each task by themselves.
    parts = frames_of.groupBy("part").agg(F.sum("n").alias("of_part"))
    before = F.sum("of_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.sum("n").over(Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1))
    return frames_of.withColumn("within", F.coalesce(within, F.lit(0))).join(parts, "part").select("part", "frame", (F.col("before") + F.col("within")).alias("base"))


def frame_heads(data: bytes) -> list[tuple[int, int, int, int]]:
    """(byte, part, frame number, ids) of each frame in a file."""
    at, out = 0, []
    while at + HEAD.size <= len(data):
        _, length, part, number, _, _, _, n = HEAD.unpack_from(data, at)
        out.append((at, part, number, n))
        at += length + 1
    return out


def ids_between(data: bytes, at: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of the frame at byte `at` of a file; only the blocks that hold them are decoded."""
    _, _, _, _, docs, size, blocks, n = HEAD.unpack_from(data, at)
    start, stop = max(0, start), min(n, stop)
    if start >= stop:
        return np.zeros(0, np.uint32)
    p = at + HEAD.size + 12 * docs
    first, last = start // size, -(-stop // size)
    index = np.frombuffer(data, "<u4", last - first, p + 4 * first).astype(np.int64) + p + 4 * (blocks + 1)
    return unpack_blocks(data, index, size).reshape(-1)[start - first * size : stop - first * size]


def read_span(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """The ids of all documents, laid end to end, from place `start` to `stop`: position (of the first) and ids, a row for
    each frame that holds some.  Frames outside of the span are passed over by their heads."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = [(name, *head) for head in frame_heads(data.as_py())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["path", "at", "part", "frame", "n"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, at, base in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids = ids_between(data, at, start - base, stop - base)
                if len(ids):
                    yield pa.RecordBatch.from_arrays([pa.array([max(start, base)]), pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))], ["position", "ids"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = stored(files.mapInArrow(heads, "path string, at long, part long, frame long, n long"), "token-heads")
    wanted = found.join(_bases(found.select("part", "frame", "n")), ["part", "frame"]).where((F.col("base") < stop) & (F.col("base") + F.col("n") > start))
    return files.join(wanted, "path").select("content", "at", "base").mapInArrow(decode, "position long, ids array<long>")


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of the files under path: doc_id, start, n_tokens, ids_crc32 and, if keep_ids, the ids themselves.

    start counts the ids of all documents before, over all files.
    """
    ids_type = ", ids array<int>" if keep_ids else ""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                for part, number, doc_ids, lengths, ids in frames(data.as_py()):
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(starts, ends, strict=True)]
                    columns = [
                        pa.array(np.full(len(ends), part, np.int64)),
                        pa.array(np.full(len(ends), number, np.int64)),
                        pa.array(doc_ids, mask=doc_ids == NULL_ID),
                        pa.array(starts),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(sums, pa.int64()),
                    ]
                    names = ["part", "frame", "doc_id", "within", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array([ids[i:j].astype(np.int32) for i, j in zip(starts, ends, strict=True)], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    files = spark.read.format("binaryFile").load(path).select("content")
    schema = "part long, frame long, doc_id long, within long, n_tokens long, ids_crc32 long" + ids_type
    docs = stored(files.mapInArrow(decode, schema), "token-index")
    starts = _bases(docs.groupBy("part", "frame").agg(F.sum("n_tokens").alias("n")))
    out = docs.join(starts, ["part", "frame"])
    kept = ["ids"] if keep_ids else []
    return out.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *kept)


def token_files(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files into the shared folder, read them back and return their documents."""
    path = new_folder(documents.sparkSession, "token-files")
    write_token_files(documents, path, vocabulary)
    return read_token_files(documents.sparkSession, path)
