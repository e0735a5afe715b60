"""Packing documents into token sequences along a space-filling curve.

A document's ids (and one end id) are cut into full sequences and a tail. Its hashed id counts, projected to three
dimensions, give a Hilbert key; tails are range-sorted by that key and laid end to end, so a sequence holds neighbours
on the curve. Full sequences need no neighbour. Only the last sequence of each range is shorter.

Null texts are empty texts: one piece with the end id alone. Repeated rows are separate documents; equal keys go by
doc_id. An empty table gives no pieces. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import coder
from .common import durable, slices

DIMENSIONS, BITS, HASHED = 3, 16, 256
#: Tail tokens that one range packs.
RANGE_TOKENS = 4_000_000
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def projection() -> np.ndarray:
    return np.random.default_rng(7).normal(size=(HASHED, DIMENSIONS)).astype(np.float32)


def hilbert(axes: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The position on the Hilbert curve of each row of unsigned coordinates (rows, dimensions)."""
    x = axes.T.astype(np.int64).copy()
    n = len(x)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    last = np.zeros_like(x[0])
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        last = np.where(x[n - 1] & q, last ^ (q - 1), last)
    x ^= last
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _counted(docs: DataFrame, path: str, end_id: int, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, project = coder(path), projection()
        end = c.dtype.type(end_id)
        for batch in slices(batches):
            vectors, tails, tokens, sums = np.zeros((batch.num_rows, HASHED), np.float32), [], [], []
            for i, part in enumerate(c.encode_all(batch.column(1).to_pylist())):
                ids = np.append(part, end)
                vectors[i] = np.bincount(ids % HASHED, minlength=HASHED)
                full = len(ids) // length * length
                sums.append([zlib.crc32(ids[a : a + length].astype("<u4").tobytes()) for a in range(0, full, length)])
                tails.append(ids[full:].tobytes())
                tokens.append(len(ids))
            vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
            axes = np.clip((vectors @ project + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(axes)), pa.array(tokens, pa.int64()), pa.array(sums, pa.list_(pa.int64())), pa.array(tails, pa.binary())], ["doc_id", "curve", "doc_tokens", "sums", "tail"])

    return docs.mapInArrow(run, "doc_id bigint, curve bigint, doc_tokens bigint, sums array<bigint>, tail binary")


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = 2) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    counted = durable(_counted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path, end_id, length), "tails")
    wide = F.col("doc_tokens") % length
    ranges = 1 + int((counted.agg(F.sum(wide)).first()[0] or 0) // RANGE_TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, at = coder(path), 0
        sequence = TaskContext.get().partitionId() << 32
        open_sequence = None
        for batch in batches:
            out: list[tuple] = []
            for doc, tokens, sums, tail in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for k, crc in enumerate(sums):
                    out.append((doc, k * length, length, crc, tokens, sequence, 0))
                    sequence += 1
                ids, start, done = np.frombuffer(tail, c.dtype).astype("<u4"), len(sums) * length, 0
                while done < len(ids):
                    if open_sequence is None:
                        open_sequence, at, sequence = sequence, 0, sequence + 1
                    piece = ids[done : done + length - at]
                    out.append((doc, start + done, len(piece), zlib.crc32(piece.tobytes()), tokens, open_sequence, at))
                    done, at = done + len(piece), at + len(piece)
                    if at == length:
                        open_sequence = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], [x.split()[0] for x in SCHEMA.split(", ")])

    laid = counted.repartitionByRange(ranges, "curve", "doc_id", "doc_tokens").sortWithinPartitions("curve", "doc_id", "doc_tokens", "tail")
    return laid.select("doc_id", "doc_tokens", "sums", "tail").mapInArrow(run, SCHEMA)
