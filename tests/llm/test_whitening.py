import math
import random

import numpy as np
import pyarrow as pa
import pytest

from assayframe.llm.whitening import jacobi, op12_whitening, whiten, whole_vectors


def brute(rows, components=4):
    """Rows of (id, vector) by the covariance matrix and exact integers."""
    whole = [(i, tuple(math.floor(256 * float(c)) for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(x for _, x in whole))
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    m = np.array(fit, float) - np.array(total) / n
    e, axes = np.linalg.eigh(m.T @ m / n)
    e, axes = e[::-1], axes[:, ::-1]
    out = {}
    for i, x in whole:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, total))
        for k in range(min(components, len(e))):
            out.setdefault((i, k + 1), []).append((n, dev if dev < 2**63 else None, (np.array(x) - np.array(total) / n) @ axes[:, k] / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def assert_same(got, want):
    signs = {}
    assert len(got) == sum(map(len, want.values())) and {(r[0], r.component) for r in got} == set(want)
    for r in got:
        n, dev, white, explained = want[r[0], r.component][0]
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(explained, rel=1e-9)
        if abs(white) > 1e-6:
            assert signs.setdefault(r.component, np.sign(white * r.whitened)) == np.sign(white * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(white), rel=1e-7, abs=1e-8)
    assert len({r.identity_error for r in got}) <= 1 and all(r.identity_error < 1e-9 for r in got)


def test_query_equals_eigenvectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op12_whitening(spark, sf).collect()
    assert list(got[0].asDict()) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert_same(got, brute(rows))


def test_many_partitions_and_copies(spark):
    rng = random.Random(2)
    base = [[rng.gauss(0, 1 + k) for k in range(7)] for _ in range(60)]
    rows = [(i, base[i % 60 if i > 200 else 3]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = whiten(df.repartition(23), components=7).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert_same(got, brute([(i, np.array(v, np.float32).tolist()) for i, v in rows], 7))


def test_jacobi_is_accurate_in_small_values():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(9, 9)))[0]
    want = 10.0 ** -np.arange(9)
    r = np.linalg.qr(rng.normal(size=(30, 9)))[0] @ np.diag(want)
    assert np.allclose(jacobi(r)[1], want, rtol=1e-12)
    axes, size = jacobi(r @ q.T)
    assert np.allclose(size[:6], want[:6], rtol=1e-9) and np.allclose(axes.T @ axes, np.eye(9), atol=1e-13)
    for m in (np.zeros((0, 3)), np.zeros((2, 1)), np.ones((5, 4)), np.eye(3)):
        axes, size = jacobi(m)
        assert np.allclose(np.sort(size)[::-1], np.pad(np.linalg.svd(m)[1], (0, m.shape[1]))[: m.shape[1]], atol=1e-12) and np.allclose(axes.T @ axes, np.eye(m.shape[1]))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [-0.001, -0.0]), (None, [3.0, 1.5]), (8, [0.5, -inf]), (9, [4.0, 4.0]), (9, [4.0, 4.0])]
    df = spark.createDataFrame([(*r, "c", 1, 2.0) for r in rows], "vec_id long, embedding array<double>, component string, n int, x double")
    assert_same(whiten(df).collect(), brute(rows))
    short = spark.createDataFrame([(1, [1.0]), (2, []), (3, [2.0, 5.0, 1.0]), (4, [0.0, 7.0])], "vec_id long, embedding array<double>")
    assert_same(whiten(short).collect(), brute([(1, [1.0, 0, 0]), (2, [0, 0, 0]), (3, [2.0, 5.0, 1.0]), (4, [0.0, 7.0, 0])], 3))
    for few in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).collect() == []
    flat = whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r.component, round(abs(r.whitened), 9), round(r.explained, 9)) for r in flat] == [(1, 1.0, 1.0)] * 2  # one direction alone


def test_what_does_not_fit(spark):
    rows = [(1, [1e300, 0.0]), (2, [-3e9, 1.0]), (3, [0.0, 0.0])]
    got = {r.id: r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()}
    assert len(got) == 3 and got[1].deviation is None and all(math.isfinite(r.whitened) for r in got.values())
    far = [(i, [float(i) * 1e5, 1e7 - i]) for i in range(40)]
    assert_same([r for r in whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect() if r.component == 1], {k: v for k, v in brute(far).items() if k[1] == 1})
    assert whole_vectors(pa.array([[1e300, -1e300]]))[1].to_pylist() == [[2**63 - 1024, -(2**63)]]
