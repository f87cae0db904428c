import numpy as np
import pytest
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from wavepanel.llm import whitening as WH
from wavepanel.llm.queries import op12_embedding_whitening

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       # names that the operator uses itself
                       T.StructField("id", T.StringType()), T.StructField("x", T.StringType()), T.StructField("n", T.StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "a", "b", "c")
                                  for i, v in rows], SCHEMA).repartition(3)


def brute(rows, scale=256, count=4):
    """Dense covariance and numpy's eigenvectors."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims = max((len(v) for _, v in kept), default=0)
    if not dims:
        return {}
    xs = [tuple(int(np.floor(scale * np.float64(np.float32(c)))) for c in v) + (0,) * (dims - len(v)) for _, v in kept]
    fit = np.array(sorted(set(xs)), dtype=object).reshape(-1, dims)
    n, sums = len(fit), [int(s) for s in fit.sum(axis=0)] if len(fit) else []
    if not n or not dims:
        return {}
    centred = fit.astype(float) - np.array([s / n for s in sums])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = int((e[:count] > 1e-9 * max(e[0], 0)).sum()) if e[0] > 0 else 0
    out = {}
    for (i, _), x in zip(kept, xs):
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(k):
            z = (np.array(x, float) - np.array([s / n for s in sums])) @ u[:, c] / np.sqrt(e[c])
            out.setdefault((i, c + 1), []).append((n, deviation, z, e[c] / e.sum()))
    return out


def compare(df, want, at=1e-9):
    found = {}
    for r in df.collect():
        found.setdefault((r.vec_id, r.component), []).append((r.n, r.deviation, r.whitened, r.explained))
        assert r.identity_error < 1e-10
    assert sorted(found, key=str) == sorted(want, key=str)
    signs = {}
    for key, rows in want.items():
        got = sorted(found[key], key=lambda r: (r[1], abs(r[2])))
        assert len(got) == len(rows)
        for g, w in zip(got, sorted(rows, key=lambda r: (r[1], abs(r[2])))):
            assert g[:2] == w[:2]
            assert g[3] == pytest.approx(w[3], rel=1e-9)
            assert abs(g[2]) == pytest.approx(abs(w[2]), abs=at)
            if abs(w[2]) > 1e-3:
                signs.setdefault(key[1], set()).add(np.sign(g[2]) * np.sign(w[2]))
    assert all(len(s) == 1 for s in signs.values())


def test_query_equals_dense_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").collect()]
    compare(op12_embedding_whitening(spark, SF_SMALL), brute(rows))


def test_awkward_vectors(spark):
    """Nulls, bad entries, short and empty vectors, ties, repeated rows and ids."""
    draw = np.random.default_rng(1)
    rows = [(i, list(draw.normal(size=9) * [9, 5, 3, 2, 1, .5, .2, .1, .1])) for i in range(80)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")] * 9), (103, [float("inf")]), (104, []), (105, [2.0, 1.0]),
             (None, rows[0][1]), (3, rows[4][1]), (3, rows[4][1]), (106, [-0.0] * 9)]
    compare(WH.whiten(frame(spark, rows)), brute(rows))


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])],
    [(1, [1.0, 2.0]), (2, [3.0, 2.5])], [(i, [float(i)]) for i in range(9)], [(i, [float(i), float(-i), 5.0]) for i in range(9)]])
def test_few_directions(spark, rows):
    out = WH.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(out, brute(rows))


def test_large_entries(spark):
    """Deviations beyond a long are null, others exact."""
    rows = [(1, [3e7, 0.0]), (2, [-3e7, 1.0]), (3, [1e16, 2.0])]
    found = {r.vec_id: r.deviation for r in WH.whiten(frame(spark, rows)).collect()}
    want = {i: d[0][1] for (i, c), d in brute(rows).items() if c == 1}
    assert found == {i: d if d < 2 ** 63 else None for i, d in want.items()}
    assert None in found.values()


@pytest.mark.parametrize("spectrum", [
    np.linspace(1, 2, 60), 1 / np.arange(1, 61) ** 2, np.r_[[5, 5, 5, 5], np.ones(56)], np.r_[[9, 4, 4 - 1e-7, 1.0], np.full(56, .99)],
    np.r_[[1.0], np.zeros(59)], np.zeros(60), np.r_[1e8, np.ones(59)]])
def test_solver_reaches_double_precision(spectrum):
    q, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((60, 60)))
    a = (q * spectrum) @ q.T
    a = (a + a.T) / 2
    jobs = []

    def product(v):
        jobs.append(v.shape[1])
        return a @ v

    values, vectors = WH.jacobi_davidson(product, 60, 4)
    assert np.allclose(values, np.sort(spectrum)[::-1][:4], rtol=0, atol=1e-13 * spectrum.max(initial=0) + 1e-300)
    assert np.linalg.norm(a @ vectors - vectors * values, axis=0).max() <= 1e-13 * max(spectrum.max(), 1e-300)
    assert np.allclose(vectors.T @ vectors, np.eye(4), atol=1e-13)
    print(len(jobs), sum(jobs))
    assert len(jobs) < 400


def test_the_minimal_residual_solver():
    draw = np.random.default_rng(2)
    m = draw.standard_normal((30, 30))
    a, q = m + m.T, np.linalg.qr(draw.standard_normal((30, 3)))[0]
    p = np.eye(30) - q @ q.T
    b = p @ draw.standard_normal(30)
    x, = WH._in_step([WH.minres(b, 0.3, q, 1e-13, 200)], lambda v: a @ v)
    assert np.linalg.norm(p @ (a - 0.3 * np.eye(30)) @ x - b) < 1e-9
    assert np.linalg.norm(q.T @ x) < 1e-10
