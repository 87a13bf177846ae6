"""Corpus-wide lookups by key, as two Spark shuffles of packed arrays.

Counting or comparing billions of hashed keys row by row costs a JVM row per key. Here documents
are packed once into batches (``pack``); each batch asks for its distinct keys (``requests``: one
row per batch and key bucket, holding sorted packed keys); the bucket's task answers all batches
(``groupBy(bucket).applyInPandas``); and each batch is cogrouped with its answers by batch number.
A key that a third of the corpus shares reaches its bucket once per batch, since each batch
aggregates before the shuffle. Buckets are counted from the corpus size, so that a bucket and a batch stay small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import written

BATCH_BYTES = 6 << 20
PACKED = "batch long, apart boolean, docs binary"


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(blob: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(blob) as read:
        return read.read_next_batch()


def pack(docs: DataFrame, tag: str, batch_bytes: int = BATCH_BYTES, apart: str | None = None) -> DataFrame:
    """Write the rows of ``docs`` as (batch, apart, docs): compressed Arrow batches of about ``batch_bytes`` of its column ``text``.

    Rows for which the boolean column ``apart`` holds go to batches of their own.
    """

    def packed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq, held, size = TaskContext.get().partitionId() << 28, {False: [], True: []}, {False: 0, True: 0}

        def out(kind: bool) -> pa.RecordBatch:
            nonlocal seq
            whole = pa.Table.from_batches(held[kind]).combine_chunks().to_batches()[0]
            held[kind], size[kind], seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([seq]), pa.array([kind]), pa.array([_ipc(whole)], pa.binary())], ["batch", "apart", "docs"])

        for rows_in in rows:
            masks = [(False, None)] if apart is None else [(k, pc.equal(rows_in.column(apart), k)) for k in (False, True)]
            for kind, mask in masks:
                batch = rows_in if mask is None else rows_in.filter(mask)
                sizes, start = np.cumsum(np.diff(_offsets(batch.column("text")))), 0
                while start < batch.num_rows:
                    base = int(sizes[start - 1]) if start else 0
                    stop = min(batch.num_rows, int(np.searchsorted(sizes, base + batch_bytes - size[kind])) + 1)
                    held[kind].append(batch.slice(start, stop - start))
                    size[kind] += int(sizes[stop - 1]) - base
                    start = stop
                    if size[kind] >= batch_bytes:
                        yield out(kind)
        for kind in held:
            if held[kind]:
                yield out(kind)

    return written(docs.mapInArrow(packed, PACKED), tag)


def _offsets(texts: pa.Array) -> np.ndarray:
    kind, width = (np.int64, 8) if pa.types.is_large_string(texts.type) else (np.int32, 4)
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1, texts.offset * width).astype(np.int64) if len(texts) else np.zeros(1, np.int64)


def by_bucket(keys: np.ndarray, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket bounds in sorted 64-bit keys: the bucket is the key's place in ``n_buckets`` equal ranges of its top 32 bits."""
    edges = (np.arange(n_buckets + 1, dtype=object) * (1 << 32)) // n_buckets
    cuts = np.searchsorted(keys, edges[1:-1].astype(np.uint64) << np.uint64(32))
    return np.append(0, cuts), np.append(cuts, len(keys))


def planes(x: np.ndarray) -> bytes:
    """64-bit integers as byte planes, which the shuffle's compression shrinks well; planes that are zero throughout are left out."""
    u = x.view(np.uint64)
    width = max(1, (int(u.max()).bit_length() + 7) // 8) if len(u) else 1
    return bytes([width]) + np.ascontiguousarray(u.view(np.uint8).reshape(len(u), 8).T[:width]).tobytes()


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : len(raw)] = raw.T
    return out.view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences in byte planes."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


def answers_in_order(pdf, column: str, kind: type) -> np.ndarray:
    """A batch's answers from all buckets, in the order of its sorted keys."""
    if not len(pdf):
        return np.zeros(0, kind)
    return np.concatenate([unplanes(x, kind) for x in pdf.sort_values("bucket")[column]])
