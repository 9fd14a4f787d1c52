"""Sequence packing along a space-filling curve.

Each document's token ids are hashed into a vector, the vector is projected to a few dimensions, and the Hilbert key of
that point orders the corpus.  A range sort by the key deals the documents out; within each range, neighbours along the
curve are laid end to end and cut every `length` ids.  What is left at the end of a range is cut into sequences whose
lengths are powers of two, so no sequence needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stored
from kelpline.llm.tokens import tokenizer, word_vocabulary

DIMENSIONS = 3
BITS = 16
BUCKETS = 256


def projection(vocabulary: int, seed: int = 7) -> np.ndarray:
    """Row i: what one occurrence of token i adds to a document's point (signed hash bucket, then random projection)."""
    token = np.arange(vocabulary, dtype=np.uint64)
    mixed = (token + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    sign = np.where(mixed >> np.uint64(63), 1.0, -1.0)
    directions = np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS))
    return (directions[(mixed % np.uint64(BUCKETS)).astype(np.int64)] * sign[:, None]).astype(np.float32)


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer points (n, d), each coordinate of `bits` bits; d * bits is 63 at most.

    Gray-code form of the curve: undo the excess rotations from the top bit down, then interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where(x[d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents given end to end; each has one id at least."""
    starts = np.cumsum(lengths) - lengths
    points = np.stack([np.add.reduceat(column[ids], starts, dtype=np.float64) for column in table.T], axis=1)
    points /= np.sqrt(lengths * float(DIMENSIONS))[:, None]
    cells = np.clip((1 / (1 + np.exp(-points)) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert_keys(cells)


def curve_tokens(documents: DataFrame, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, n_tokens, curve_key and token_ids (bytes) of each document, written once in the shared folder."""
    vocabulary = vocabulary or word_vocabulary()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(vocabulary)
        table = projection(len(coder.ends))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                coded = coder.encode(some.column(1).to_pylist(), end_id)
                lengths = np.array([len(x) // coder.dtype.itemsize for x in coded], np.int64)
                keys = curve_keys(np.frombuffer(b"".join(coded), coder.dtype), lengths, table)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(lengths), pa.array(keys), pa.array(coded, pa.binary())],
                    ["doc_id", "n_tokens", "curve_key", "token_ids"],
                )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(encode, "doc_id long, n_tokens long, curve_key long, token_ids binary"), "curve-tokens")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"


def pack_sequences(documents: DataFrame, length: int = 2048, vocabulary: str | None = None, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most `length` ids (a power of two), neighbours on the curve together.

    documents: doc_id and text.  A null or empty text is its end id alone.  Rows with equal or null doc_id are packed
    each for itself; equal texts lie side by side, dealt over ranges by a hash of doc_id where they are many.  An
    empty table gives no pieces.  sequence_tokens is the length of the piece's sequence: `length` or a power of two.
    """
    vocabulary = vocabulary or word_vocabulary()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 32
        width = tokenizer(vocabulary).dtype
        held: list[tuple] = []  # pieces of the sequence that is not yet full
        size = 0
        out: list[tuple] = []

        def lay(pieces: list[tuple], total: int) -> None:
            nonlocal sequence
            offset = 0
            for doc_id, start, ids, tokens in pieces:
                out.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, sequence, offset, total))
                offset += len(ids)
            sequence += 1

        def made() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECE.split(", ")])

        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(raw, width)
                at = 0
                while at < len(ids):
                    take = min(len(ids) - at, length - size)
                    held.append((doc_id, at, ids[at : at + take], len(ids)))
                    at, size = at + take, size + take
                    if size == length:
                        lay(held, length)
                        held, size = [], 0
                if len(out) > 20_000:
                    yield made()
        while size:  # the rest: one sequence for each bit of its length
            total = 1 << (size.bit_length() - 1)
            pieces, room = [], total
            while room:
                doc_id, start, ids, tokens = held.pop(0)
                pieces.append((doc_id, start, ids[:room], tokens))
                if len(ids) > room:
                    held.insert(0, (doc_id, start + room, ids[room:], tokens))
                room -= min(room, len(ids))
            lay(pieces, total)
            size -= total
        if out:
            yield made()

    keyed = curve_tokens(documents, vocabulary, end_id).withColumn("salt", F.xxhash64("doc_id"))
    ordered = keyed.repartitionByRange("curve_key", "salt").sortWithinPartitions("curve_key", "salt", "token_ids")
    return ordered.select("doc_id", "token_ids").mapInArrow(pack, PIECE)
