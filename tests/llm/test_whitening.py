import math
import random

import numpy as np
import pytest

from helpers import SF001, rows
from sentiscope.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"
NAMES = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def brute(given, k=8):
    """op13 by its definition, with a dense eigendecomposition."""
    kept = [(i, v) for i, v in given if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in kept], np.float32).astype(np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = (n * x - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-9 * e.sum()).sum()))
    return [i for i, _ in kept], ((n * x - s) ** 2).sum(axis=1), c @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def held(df, given, k=8):
    ids, deviation, z, explained = brute(given, k)
    got = {}
    for r in df.collect():
        got.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert r.n == len(ids) and 0 <= r.identity_error <= 1e-4
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    k = z.shape[1]
    sign = None
    want = {}
    for i, d, row in zip(ids, deviation.tolist(), z):
        want.setdefault((i, d), []).append(row)
    assert set(got) == set(want)
    for key, mine in got.items():
        assert sorted(mine) == list(range(1, k + 1))
        if len(want[key]) == 1:
            row = np.array([mine[j][0] for j in range(1, k + 1)])
            flip = np.sign(row * want[key][0])
            sign = flip if sign is None else sign
            assert np.allclose(row, want[key][0] * sign, atol=1e-8)
        else:
            assert all(len(mine[j]) == len(want[key]) for j in mine)


def test_query_equals_dense_eigenvectors(spark):
    given = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    out = W.op13_whitening(spark, SF001)
    assert out.columns == NAMES and dict(out.dtypes)["deviation"] == "bigint"
    held(out, given)


def test_odd_rows_and_extra_columns(spark):
    rng = random.Random(5)
    given = [(i, [rng.gauss(0, j + 1) for j in range(5)]) for i in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, math.nan, 2.0, 3.0, 4.0]),
           (104, [1.0, math.inf, 2.0, 3.0, 4.0]), (105, [1.0, 2.0]), (None, [9.0, 8.0, 7.0, 6.0, 5.0])]
    again = given[:3]
    df = spark.createDataFrame([(i, v, 1) for i, v in given + odd + again], SCHEMA).withColumnRenamed("label", "x")
    held(W.whiten(df), [g for g in given + odd + again if g[0] != 105])


def test_directions_without_variance_are_no_components(spark):
    given = [(i, [float(i % 7), 3.0, 2.0 * (i % 7), float(i % 3)]) for i in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in given], SCHEMA)
    out = W.whiten(df)
    assert {r.component for r in out.collect()} == {1, 2}
    held(out, given)


@pytest.mark.parametrize("given", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_tables_without_components(spark, given):
    out = W.whiten(spark.createDataFrame([(i, v, 0) for i, v in given], SCHEMA))
    assert out.columns == NAMES and out.collect() == []


def test_large_values_stay_exact(spark):
    given = [(i, [1e13 * i, 1.0 * (i % 2)]) for i in range(1, 5)]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>")
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in given]
    s = [sum(c) for c in zip(*x)]
    want = sorted((i, sum((4 * c - t) ** 2 for c, t in zip(row, s))) for (i, _), row in zip(given, x))
    assert sorted({(r.vec_id, int(r.deviation)) for r in W.whiten(df).collect()}) == want


def _dense(x):
    return lambda p, left: np.concatenate([(x @ left.T).T @ (x @ p), [(x @ p) @ (x @ p)], x.T @ (x @ p)])


@pytest.mark.parametrize("spectrum", [np.linspace(3, 1, 12), np.ones(12), 10.0 ** -np.arange(12), np.r_[np.ones(4), np.zeros(8)]])
def test_bidiagonalisation_of_hard_spectra(spectrum):
    rng = np.random.default_rng(1)
    u, v = np.linalg.qr(rng.standard_normal((50, 12)))[0], np.linalg.qr(rng.standard_normal((12, 12)))[0]
    x = u * spectrum @ v.T
    right, small = W.bidiagonalise(_dense(x), 12, 5, float((x ** 2).sum()))
    assert np.abs(right @ right.T - np.eye(len(right))).max() < 1e-12
    _, values, turn = np.linalg.svd(small)
    assert np.allclose(values[:4], spectrum[:4], rtol=1e-9, atol=1e-12)
    for s, c in zip(values[:4], turn[:4] @ right):
        assert np.linalg.norm(x.T @ (x @ c) - s * s * c) < 1e-10


def test_steps_stop_when_nothing_large_is_left():
    rng = np.random.default_rng(2)
    x = np.linalg.qr(rng.standard_normal((400, 100)))[0] * (0.3 ** np.arange(100))
    right, _ = W.bidiagonalise(_dense(x), 100, 3, float((x ** 2).sum()))
    assert len(right) < 40


def test_rows_of_the_result_are_stable(spark):
    one, two = (rows(W.op13_whitening(spark, SF001), "vec_id", "component", "n", "deviation") for _ in range(2))
    assert one == two
