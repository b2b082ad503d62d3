"""Embedding whitening: the solver and the table's query against numpy's own decompositions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspark.llm import whitening as w

DATA = "/root/testdata/sf0.001"
rng = np.random.default_rng(11)
orthogonal = lambda n: np.linalg.qr(rng.standard_normal((n, n)))[0]

CASES = {
    "one": np.array([[3.0]]), "random": np.triu(rng.standard_normal((12, 12))), "of rows": np.linalg.qr(rng.standard_normal((500, 64)), mode="r"), "zero": np.zeros((5, 5)), "unit": np.eye(20),
    "multiple": np.linalg.qr(orthogonal(40) @ np.diag(np.r_[np.full(20, 3.0), np.ones(20)]) @ orthogonal(40), mode="r"),
    "low rank": np.linalg.qr(rng.standard_normal((300, 8)) @ rng.standard_normal((8, 30)), mode="r"), "graded": np.linalg.qr(rng.standard_normal((300, 30)) * 10.0 ** -np.arange(30), mode="r"),
    "pairs": np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1), "nearly unit": np.eye(30) + np.diag(np.full(29, 1e-9), 1), "split": np.diag(np.arange(1.0, 11)), "zero on the diagonal": np.diag([1.0, 0, 2, 0]) + np.diag([1.0, 1, 1], 1),
}


@pytest.mark.parametrize("name", CASES)
def test_solver(name):
    r = CASES[name]
    d, u, left = w.bidiagonal(r)
    assert np.allclose(left.T @ left, np.eye(len(r)), atol=1e-13)
    want = np.linalg.svd(r)[1]
    size = max(want[0], 1e-300)
    assert np.abs(np.sqrt(w.dqds(d, u)) - want).max() < 1e-13 * size
    e, v, trace = w.directions(r, len(r))
    cov = r.T @ r / len(r)
    assert math.isclose(trace, np.trace(cov), rel_tol=1e-12, abs_tol=1e-300)
    assert len(e) == min(16, int((want**2 > w.LEAST * size**2).sum())) and (np.diff(e) <= 0).all()
    if len(e):
        assert np.abs(cov @ v - v * e).max() < 1e-13 * e[0] and np.abs(v.T @ v - np.eye(len(e))).max() < 1e-11


def test_dqds_is_relatively_accurate():
    """Small singular values of a graded bidiagonal matrix, which are lost in its product with itself."""
    d, u = 10.0 ** -np.arange(12), 10.0 ** -np.arange(12)[1:] / 3
    got = np.sqrt(w.dqds(d, u))
    assert math.isclose(float(np.prod(got)), float(np.prod(d)), rel_tol=1e-12) and (got > 0).all()


def brute(rows, most=16):
    """From definitions, in exact integers and numpy's eigenvectors."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) and all(c is not None and math.isfinite(c) and abs(c) <= w.LARGEST for c in v):
            kept.append((i, tuple(math.floor(64 * c) + 1_000_000 for c in v)))
    lengths = [len(x) for x in {x for _, x in kept}]
    d = max(set(lengths), key=lambda k: (lengths.count(k), k))
    kept = [(i, x) for i, x in kept if len(x) == d]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    cov = centred.T @ centred / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    out = {}
    for i, x in kept:
        exact = [n * c - s for c, s in zip(x, sums)]
        y = np.array(exact, float) / n @ v / np.sqrt(e)
        for k in range(len(e)):
            out.setdefault((i, k + 1), []).append((n, sum(c * c for c in exact), y[k], e[k] / np.trace(cov)))
    return out, n


def same(got, want):
    assert len(got) == sum(map(len, want.values()))
    sign = {}
    for r in sorted(got, key=lambda r: -abs(r.whitened)):
        near = min(want[r.vec_id, r.component], key=lambda x: min(abs(x[2] - r.whitened), abs(x[2] + r.whitened)))
        assert (r.n, r.deviation) == near[:2] and math.isclose(r.explained, near[3], rel_tol=1e-9)
        s = sign.setdefault(r.component, 1 if abs(near[2] - r.whitened) < abs(near[2] + r.whitened) else -1)
        assert abs(s * near[2] - r.whitened) < 1e-6
        assert r.identity_error == got[0].identity_error <= 1e-4


def test_odd_rows(spark):
    """Nulls, non-finite and huge entries, other lengths, repeated and tied rows, null ids, clashing names."""
    base = [[float(x) for x in v] for v in rng.standard_normal((40, 5)) * np.array([3, 2, 1, 0.5, 0.25])]
    rows = [*[(i, v) for i, v in enumerate(base)], *[(7, base[3])] * 200, (100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [math.nan] * 5), (104, [math.inf] + [1.0] * 4), (105, [1e300] * 5), (106, [1.0, 2.0]), (None, base[0]), (107, [-0.0, 1 / 64, -1 / 64, 0.99, -3.01])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({"x": F.lit("a"), "n": F.lit(0), "component": F.lit(1), "__id": F.lit(3)}).repartition(6)
    got = w.whitened(df).collect()
    want, n = brute(rows)
    assert n == 41 and {r.component for r in got} == {1, 2, 3, 4, 5} and not {100, 101, 102, 103, 104, 105, 106} & {r.vec_id for r in got}
    same(got, want)


def test_exact_beyond_64_bits(spark):
    rows = [(i, [float(i) * 2.0**33, float(i % 3)]) for i in range(60)]
    got = w.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), most=1).collect()
    want, _ = brute(rows, 1)
    for r in got:
        exact = want[r.vec_id, 1][0][1]
        assert r.deviation == (exact if exact < 2**63 else None)
    assert any(r.deviation is None for r in got)


def test_no_components(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])] * 3):
        got = w.whitened(spark.createDataFrame(rows, schema))
        assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(w, "FAN_IN", 2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((300, 4)))]
    same(w.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(9)).collect(), brute(rows)[0])


def test_query_on_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = w.query(spark, DATA).collect()
    assert {r.component for r in got} == set(range(1, 17))
    same(got, brute(rows)[0])
