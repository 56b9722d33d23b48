"""Whitening against numpy's eigenvectors of the exact covariance, and the solver on hard matrices."""

import math

import numpy as np
import pytest

from carepath.llm import whitening as wh
from carepath.llm.common import prepare

SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, component string, x string, n string"


def table(spark, vectors):
    prepare(spark)
    return spark.createDataFrame([(i, v, 0, "a", "b", "c", "d") for i, v in vectors], SCHEMA).repartition(5)


def brute(vectors, components=8):
    """For each (id, component): n, deviation, whitened up to sign, explained."""
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    n, dims = len(kept), len(kept[0][1])
    s = [sum(x[d] for _, x in kept) for d in range(dims)]
    y = [[n * x[d] - s[d] for d in range(dims)] for _, x in kept]
    a = np.array([[float(c) / n for c in row] for row in y])
    e, v = np.linalg.eigh(a.T @ a / n)
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    w = a @ v / np.sqrt(e)
    out = [(i, k + 1, n, sum(c * c for c in y[r]), w[r, k], e[k] / np.trace(a.T @ a / n)) for r, (i, _) in enumerate(kept) for k in range(len(e))]
    return sorted(out, key=lambda t: (-1 if t[0] is None else t[0], t[1], t[3]))


def test_whitening_against_eigh(spark):
    g = np.random.default_rng(3)
    data = g.normal(size=(700, 12)) * np.linspace(3, 0.5, 12) @ np.linalg.qr(g.normal(size=(12, 12)))[0]
    vectors = [(i, [float(c) for c in v]) for i, v in enumerate(data)]
    vectors += [(1000, None), (1001, []), (1002, [1.0, None] + [0.0] * 10), (1003, [float("nan")] + [0.0] * 11), (1004, [float("-inf")] * 12), (None, [0.5] * 12)]
    vectors += [vectors[5], vectors[5]] + [(1005, [1.0, 2.0])]  # repeats, another length
    got = sorted(wh.whitened(table(spark, vectors)).collect(), key=lambda r: (-1 if r.vec_id is None else r.vec_id, r.component, r.deviation))
    want = brute([v for v in vectors if v[0] != 1005])
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    sign = {r.component: 1 if r.whitened * w[4] > 0 else -1 for r, w in zip(got, want, strict=True) if r.vec_id == 7}
    for r, w in zip(got, want, strict=True):
        assert r.whitened * sign[r.component] == pytest.approx(w[4], abs=1e-9)
        assert r.explained == pytest.approx(w[5], rel=1e-9)
        assert r.identity_error < 1e-10
    assert len({r.identity_error for r in got}) == 1


def test_tables_without_variance(spark):
    for vectors in ([], [(1, None)], [(1, [1.0, 2.0])], [(k, [0.25, 0.5]) for k in range(9)]):
        assert wh.whitened(table(spark, vectors)).collect() == []
    two = wh.whitened(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9)), round(r.explained, 9)) for r in two) == [(1, 1, 1.0, 1.0), (2, 1, 1.0, 1.0)]


def test_large_entries_stay_exact(spark):
    """Beyond 64 bits a deviation is null; sums and whitening still hold."""
    big = wh.whitened(table(spark, [(k, [float(2**51 * (k % 2)), float(k)]) for k in range(40)])).collect()
    assert len(big) == 80 and all(r.deviation is None for r in big)
    assert {abs(round(r.whitened, 6)) for r in big if r.component == 1} == {1.0}


def test_triangles_join_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN_IN", 2)
    monkeypatch.setattr(wh, "BLOCK_ROWS", 7)
    g = np.random.default_rng(4)
    x = g.integers(-500, 500, size=(200, 5))
    rows = spark.createDataFrame([(k, [int(c) for c in v]) for k, v in enumerate(x)], "vec_id long, x array<long>").repartition(9)
    n, total = wh.sums(rows)
    assert (n, total) == (200, x.sum(axis=0).tolist())
    r, a = wh.triangle(rows, n, total), x - x.mean(axis=0)
    assert np.allclose(r.T @ r, a.T @ a)


@pytest.mark.parametrize("name", ["plain", "graded", "rank", "zeros in columns", "identity", "clusters"])
def test_solver(name):
    g = np.random.default_rng(5)
    q = np.linalg.qr(g.normal(size=(40, 40)))[0]
    a = {
        "plain": g.normal(size=(300, 40)), "graded": g.normal(size=(300, 40)) * np.logspace(0, -8, 40), "rank": g.normal(size=(300, 3)) @ g.normal(size=(3, 40)),
        "zeros in columns": g.normal(size=(300, 40)) * (np.arange(40) % 3 > 0), "identity": np.eye(40), "clusters": np.diag([3.0] * 4 + [2.0] * 3 + [1.0] * 33) @ q,
    }[name]
    r = np.linalg.qr(a, mode="r")
    e, v, trace = wh.principal(r, len(a), 8)
    cov = a.T @ a / len(a)
    want = np.linalg.eigvalsh(cov)[::-1]
    assert len(e) == min(8, int((want > 1e-14 * want[0]).sum()))
    assert np.allclose(e, want[: len(e)], rtol=1e-11, atol=0)
    assert np.abs(cov @ v.T - v.T * e).max() < 1e-12 * want[0]
    assert np.abs(v @ v.T - np.eye(len(e))).max() < 1e-9
    assert trace == pytest.approx(np.trace(cov))


def test_small_singular_values_keep_their_digits():
    a, b = np.logspace(0, -12, 20), np.logspace(-1, -13, 19)
    exact = np.linalg.svd(np.diag(a) + np.diag(b, 1), compute_uv=False)[:6]
    assert np.allclose(np.sqrt(wh.dqds(a * a, b * b))[:6], exact, rtol=1e-14, atol=0)
    product = math.prod(np.sqrt(wh.dqds(a * a, b * b)).tolist())  # the determinant, which every small value enters
    assert product == pytest.approx(math.prod(a.tolist()), rel=1e-12)
