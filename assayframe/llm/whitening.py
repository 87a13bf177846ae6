"""Embedding whitening by a one-sided Jacobi SVD.

Vectors are rounded to whole numbers, and each different one counts once. Their centred rows are compressed block by block to
one square triangle R (TSQR): a QR of each block, then QRs of a few triangles at a time. Plane rotations orthogonalise R's columns; the rotations
together give the components, the columns' lengths the standard deviations, without squaring the data as a covariance matrix does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, written

COMPONENTS, SCALE, FAN_IN, SWEEPS = 4, 256, 8, 60
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_vectors(vectors: pa.ListArray) -> tuple[pa.Array, pa.ListArray]:
    """(mask, vectors kept): floor(256 * c) of each entry as a long, without vectors that are null or hold a null or an entry that is not finite.

    What doesn't fit a long becomes the nearest double that does.
    """
    n = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    c = pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    kept = vectors.is_valid().to_numpy(zero_copy_only=False)
    kept[np.repeat(np.arange(len(n)), n)[~np.isfinite(c)]] = False
    x = np.clip(np.floor(c * SCALE)[np.repeat(kept, n)], -(2.0**63), np.nextafter(2.0**63, 0)).astype(np.int64)
    return pa.array(kept), pa.LargeListArray.from_arrays(np.append(0, np.cumsum(n[kept])), x)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled up with zeros."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if dims and len(at) and (at == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(at), dims), flat.dtype)
    out[np.repeat(np.arange(len(at)), at), np.arange(len(flat)) - np.repeat(np.cumsum(at) - at, at)] = flat
    return out


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a QR; fewer rows than columns stay fewer."""
    return np.linalg.qr(rows, mode="r") if len(rows) else rows


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, lengths) of a matrix's columns, by falling length: columns are rotated pair by pair until all are orthogonal.

    In each round half as many disjoint pairs as there are columns are rotated at once; a sweep of rounds meets every pair.
    """
    d = r.shape[1]
    n = d + d % 2
    u, v = np.zeros((max(len(r), 1), n)), np.eye(n)
    u[: len(r), :d] = r
    seats, tiny = np.arange(n), np.finfo(float).tiny
    for _ in range(SWEEPS):
        worst = 0.0
        for _ in range(n - 1):
            p, q = seats[: n // 2], seats[n // 2 :][::-1]
            x, y = u[:, p], u[:, q]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            off = np.abs(c) / np.maximum(np.sqrt(a) * np.sqrt(b), tiny)
            worst = max(worst, off.max(initial=0.0))
            turn = (off > 1e-16) & (c != 0)
            zeta = np.divide(b - a, 2 * c, out=np.zeros(len(c)), where=turn)
            t = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, t)
            sin = cos * t
            for m in (u, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = cos * x - sin * y, sin * x + cos * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if worst < 1e-13:  # before the sweep's own rotations
            break
    u, v = u[:, :d], v[:d, :d]
    size = np.sqrt((u * u).sum(0))
    order = np.argsort(-size, kind="stable")
    return v[:, order], size[order]


def dimension_sums(fit: DataFrame) -> DataFrame:
    """(dim, sum, n): exact sums of each dimension; a row a dimension and task is shuffled."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, object)
        for batch in rows:
            x = batch.column(0)
            dims = max(len(total), int(np.diff(x.offsets.to_numpy()).max(initial=0)))
            m = _matrix(x, dims)
            small = len(m) and np.abs(m.astype(float)).max(initial=0) * len(m) < 2**62
            total = np.append(total, np.zeros(dims - len(total), object)) + (m.sum(0).astype(object) if small else m.astype(object).sum(0) if len(m) else 0)
            n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int32()), pa.array([n, *total], pa.decimal128(38))], ["dim", "sum"])

    return fit.select("x").mapInArrow(run, "dim int, sum decimal(38,0)").groupBy("dim").agg(F.sum("sum").cast("decimal(38,0)").alias("sum"))


def tsqr(fit: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows: a triangle a task, then of ``FAN_IN`` at a time, level by level, until one is left."""
    dims = len(mean)

    def packed(r: np.ndarray, at: int) -> pd.DataFrame:
        return pd.DataFrame({"at": [at], "r": [r.tobytes()]})

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        r, held, size = np.zeros((0, dims)), [], 0
        for batch in rows:
            held.append(_matrix(batch.column(0), dims) - mean)
            size += len(held[-1])
            if size >= 4 * dims:
                r, held, size = triangle(np.vstack([r, *held])), [], 0
        r = triangle(np.vstack([r, *held]))
        yield pa.RecordBatch.from_pandas(packed(r, TaskContext.get().partitionId()))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(triangle(np.vstack([np.frombuffer(b).reshape(-1, dims) for b in pdf.sort_values("at")["r"]])), key[0])

    level, left = fit.select("x").mapInArrow(blocks, "at long, r binary"), fit.rdd.getNumPartitions()
    while left > 1:
        level = level.groupBy(F.floor(F.col("at") / FAN_IN).alias("above")).applyInPandas(merge, "at long, r binary")
        left = -(-left // FAN_IN)
    rows = level.collect()  # one square matrix of the dimensions
    return np.vstack([np.frombuffer(x.r).reshape(-1, dims) for x in rows] or [np.zeros((0, dims))])


def _white(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def product_sums(fit: DataFrame, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Sums over the fit list of (1, w) times (1, w), where w is the whitened vector."""
    k = axes.shape[1] + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in rows:
            m = _matrix(batch.column(0), len(mean))
            w = np.hstack([np.ones((len(m), 1)), _white(m, mean, axes)])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["at", "s"])

    out = np.zeros(k * k)
    for r in fit.select("x").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        out[r["at"]] = r.s
    return out.reshape(k, k)


def whiten(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each vector kept and each of the first components.

    Vectors that are null or hold a null, NaN or infinite entry are left out; a shorter vector counts as filled up with zeros. Components along which the
    vectors don't differ are left out: with one different vector or none there is no row. ``deviation`` is null where it doesn't fit a long.
    The driver gets the dimensions' sums, one square matrix of the dimensions, and sums of the components' products.
    """
    small_batches(df.sparkSession)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([whole_vectors(batch.column(0))[1].cast(pa.list_(pa.int64()))], ["x"])

    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    fit = written(rows.select("vector").mapInArrow(whole, "x array<long>").distinct(), "vectors")
    id_type = rows.schema["id"].dataType.simpleString()
    out_schema = f"id {id_type}, {_OUT}"
    sums = {r.dim: int(r["sum"]) for r in dimension_sums(fit).collect()}
    n, dims = sums.pop(-1, 0), len(sums)
    if n < 2 or not dims:
        return df.sparkSession.createDataFrame([], out_schema)
    total = [sums[k] for k in range(dims)]
    mean = np.array([s / n for s in total])
    axes, size = jacobi(tsqr(fit, mean))
    keep = size[:components] > size[0] * np.sqrt(dims) * 1e-13 if size[0] else np.zeros(0, bool)
    axes, spread = axes[:, : len(keep)][:, keep], size[: len(keep)][keep] / np.sqrt(n)
    if not len(spread):
        return df.sparkSession.createDataFrame([], out_schema)
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), range(len(spread))]) / spread
    explained = spread**2 / (size**2 / n).sum()
    products = product_sums(fit, mean, axes) / n
    error = float(np.abs(products[1:, 1:] - np.outer(products[0, 1:], products[0, 1:]) - np.eye(len(spread))).max())
    k, wide = len(spread), np.array([s % 2**64 for s in total], np.uint64).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, vectors = whole_vectors(batch.column(1))
            m, ids = _matrix(vectors, dims), batch.column(0).filter(kept)
            if not len(m):
                continue
            if ((n * m.astype(float) - np.array(total, float)) ** 2).sum(1).max() < 2**62:
                deviation = ((n * m - wide) ** 2).sum(1)  # what overflows on the way comes back
            else:
                exact = [sum((n * c - s) ** 2 for c, s in zip(x, total)) for x in m.tolist()]
                deviation = np.array([x if x < 2**63 else None for x in exact], object)
            times = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1), len(m)), pa.int32()), pa.array(np.full(len(times), n, np.int64)), pa.array(deviation[times].tolist(), pa.int64()),
                 pa.array(_white(m, mean, axes).ravel()), pa.array(np.tile(explained, len(m))), pa.array(np.full(len(times), error))],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, out_schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    """The whole table ``embeddings`` along its first four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
