"""REML mixed models: compressed sufficient statistics vs dense numpy GLS."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wavepanel.operators import mixed as M
from wavepanel.sources.testdata import orders_panel


def dense_reml(y: np.ndarray, X: np.ndarray, groups: np.ndarray, Z: np.ndarray, gamma: np.ndarray):
    """Reference dense GLS profile REML at a fixed G ."""
    n, p = X.shape
    Vinv_blocks, logdet = [], 0.0
    V = np.zeros((n, n))
    for g in np.unique(groups):
        idx = np.where(groups == g)[0]
        Zi = Z[idx]
        V[np.ix_(idx, idx)] = np.eye(len(idx)) + Zi @ gamma @ Zi.T
    Vinv = np.linalg.inv(V)
    _, logdet = np.linalg.slogdet(V)
    xwx = X.T @ Vinv @ X
    beta = np.linalg.solve(xwx, X.T @ Vinv @ y)
    r = y - X @ beta
    r2 = float(r @ Vinv @ r)
    s2 = r2 / (n - p)
    m2ll = logdet + np.linalg.slogdet(xwx)[1] + (n - p) * (math.log(s2) + math.log(2 * math.pi) + 1.0)
    return m2ll, beta, s2


def _synthetic(spark, slope_sd=0.3, seed=11):
    rng = np.random.default_rng(seed)
    rows = []
    for e in range(80):
        u0, u1 = rng.normal(0, 1.5), rng.normal(0, slope_sd)
        g = "a" if e % 3 else "b"
        for v in range(int(rng.integers(1, 9))):
            if rng.random() < 0.2:
                continue
            x = float(rng.normal())
            y = 2.0 + 0.5 * x + (0.7 if g == "b" else 0.0) + u0 + (0.2 + u1) * v + rng.normal(0, 1.0)
            rows.append((e, float(v), x, g, y))
    return spark.createDataFrame(rows, "e long, v double, x double, g string, y double")


def _dense_inputs(df, slope):
    pdf = df.toPandas()
    X = np.column_stack([np.ones(len(pdf)), (pdf.g == "b").astype(float), pdf.v, pdf.x])
    Z = np.column_stack([np.ones(len(pdf)), pdf.v]) if slope else np.ones((len(pdf), 1))
    return pdf.y.to_numpy(), X, pdf.e.to_numpy(), Z


@pytest.mark.parametrize("slope", [None, "v"])
def test_reml_matches_dense_gls_and_is_optimal(spark, slope):
    df = _synthetic(spark)
    res = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=slope)
    fit = res.fits["model"]
    y, X, groups, Z = _dense_inputs(df, slope)
    m2ll, beta, s2 = dense_reml(y, X, groups, Z, fit["gamma"])
    assert math.isclose(m2ll, fit["m2ll"], rel_tol=1e-10)
    assert np.allclose(beta, fit["beta"], atol=1e-8) and math.isclose(s2, fit["s2"], rel_tol=1e-8)
    q = Z.shape[1]
    for i in range(len(fit["theta"])):
        for d in (1e-3, -1e-3):
            th = np.array(fit["theta"], dtype=float)
            th[i] += d
            assert dense_reml(y, X, groups, Z, M._gamma(th, q))[0] >= m2ll - 1e-7
    assert fit["converged"]
    # the random intercept is clearly non-zero in this design
    assert fit["gamma"][0, 0] * fit["s2"] > 0.5


def test_no_entity_variance_equals_ols(spark):
    # entities whose residuals cancel: the intercept variance is at its boundary, zero
    rows = [(e, float(v), 1.0 + 2.0 * v + (1.0 if (v + e) % 2 else -1.0)) for e in range(30) for v in range(4)]
    fit = M.fit_lmm(spark.createDataFrame(rows, "e long, v double, y double"), "y", "e", fixed=["v"]).fits["model"]
    x = np.array([[1.0, r[1]] for r in rows])
    b, *_ = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)
    assert fit["gamma"][0, 0] < 1e-4 and np.allclose(fit["beta"], b, atol=1e-6)


def test_single_visit_entities_and_counts(spark):
    df = _synthetic(spark)
    extra = spark.createDataFrame([(1000 + i, 0.0, 0.1 * i, "a", 1.0 + i) for i in range(5)],
                                  "e long, v double, x double, g string, y double")
    res = M.fit_lmm(df.unionByName(extra), "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope="v")
    st = res.fit_stats.collect()[0]
    assert st.min_group == 1 and st.n_groups == df.select("e").distinct().count() + 5
    assert 0 <= st.r2_marginal <= st.r2_conditional <= 1


def test_blups_and_fit_errors(spark):
    df = _synthetic(spark)
    res = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=None)
    u = {r.entity: r.u0 for r in res.blup().collect()}
    fit = res.fits["model"]
    # BLUP of a random intercept: g/(1 + n g) * sum of marginal residuals of the entity
    pdf = df.toPandas()
    X = np.column_stack([np.ones(len(pdf)), (pdf.g == "b").astype(float), pdf.v, pdf.x])
    pdf["r"] = pdf.y - X @ fit["beta"]
    g = fit["gamma"][0, 0]
    for e, grp in list(pdf.groupby("e"))[:10]:
        assert math.isclose(u[e], g / (1 + len(grp) * g) * grp.r.sum(), rel_tol=1e-8, abs_tol=1e-10)
    err = M.fit_errors(df, res, "model", "y", "e", None).collect()[0]
    resid = pdf.r - pdf.e.map(u)
    assert math.isclose(err.rmse, math.sqrt(np.mean(resid ** 2)), rel_tol=1e-9)
    assert math.isclose(err.mae, np.mean(np.abs(resid)), rel_tol=1e-9)


def test_batched_models_match_separate_fits(spark):
    df = _synthetic(spark)
    both = df.withColumn("m", F.lit("one")).unionByName(df.withColumn("m", F.lit("two")).withColumn("y", F.col("y") * 2))
    res = M.fit_lmm(both, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=None, model="m")
    single = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=None)
    assert np.allclose(res.fits["one"]["beta"], single.fits["model"]["beta"], atol=1e-7)
    assert np.allclose(res.fits["two"]["beta"], 2 * single.fits["model"]["beta"], atol=1e-6)


@pytest.mark.parametrize("slope", [None, "v"])
def test_distributed_fallback_matches_pattern_fit(spark, slope):
    df = _synthetic(spark)
    compressed = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=slope).fits["model"]
    dist = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=slope, max_patterns=0).fits["model"]
    assert dist["converged"]
    assert math.isclose(dist["m2ll"], compressed["m2ll"], rel_tol=1e-9)
    assert np.allclose(dist["beta"], compressed["beta"], atol=1e-4)


def test_balanced_groups_have_the_anova_estimates(spark):
    """Balanced one-way layout: REML is (MSB - MSW) / m and MSW, the standard error sqrt(MSB / n)."""
    rng = np.random.default_rng(5)
    y = rng.normal(size=(40, 6)) + rng.normal(0, 2, size=(40, 1)) + 7
    df = spark.createDataFrame([(g, float(v)) for g in range(40) for v in y[g]], "g long, y double")
    res = M.fit_lmm(df, "y", "g")
    msb = 6 * y.mean(1).var(ddof=1)
    msw = ((y - y.mean(1, keepdims=True)) ** 2).sum() / (40 * 5)
    parts = {r.component: r.value for r in res.variance.collect()}
    assert parts["Scale"] == pytest.approx(msw, rel=1e-6) and parts["Group Var"] == pytest.approx((msb - msw) / 6, rel=1e-6)
    c = res.coefficients.first()
    assert c.coef == pytest.approx(y.mean(), rel=1e-10) and c.se == pytest.approx(math.sqrt(msb / 240), rel=1e-6)


@pytest.mark.parametrize("slope", [None, "v"])
@pytest.mark.parametrize("max_patterns", [0, 20_000])
def test_far_off_columns_change_nothing(spark, slope, max_patterns):
    df = _synthetic(spark)
    near = M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=slope)
    far_df = df.withColumns({"v": F.col("v") + 2e5, "y": F.col("y") + 1e7, "x": F.col("x") - 3e6})
    far = M.fit_lmm(far_df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope=slope, max_patterns=max_patterns)
    a, b = near.fits["model"], far.fits["model"]
    assert b["converged"] and math.isclose(a["s2"], b["s2"], rel_tol=1e-6)
    assert np.allclose(a["beta"][1:], b["beta"][1:], rtol=1e-5)
    u = {r.entity: (r.u0, r.u1) for r in near.blup().collect()}
    for r in far.blup().collect():
        # the same line, its intercept taken 2e5 visits away
        assert math.isclose(r.u0 + 2e5 * r.u1, u[r.entity][0], rel_tol=1e-4, abs_tol=1e-4)
        assert math.isclose(r.u1, u[r.entity][1], rel_tol=1e-4, abs_tol=1e-6)


def test_a_level_missing_from_one_model(spark):
    df = _synthetic(spark)
    both = df.withColumn("m", F.lit("all")).unionByName(df.filter("g = 'a'").withColumn("m", F.lit("only a")))
    both = both.unionByName(df.limit(2).withColumn("m", F.lit("tiny")))
    res = M.fit_lmm(both, "y", "e", fixed=["v", "x"], factors={"g": "a"}, model="m")
    one = M.fit_lmm(df.filter("g = 'a'"), "y", "e", fixed=["v", "x"])
    got = {(r.model, r.term): r.coef for r in res.coefficients.collect()}
    want = {r.term: r.coef for r in one.coefficients.collect()}
    assert got["only a", "g[T.b]"] is None and got["all", "g[T.b]"] is not None
    assert all(got["only a", t] == pytest.approx(want[t], abs=1e-5) for t in want)
    stats = {r.model: r for r in res.fit_stats.collect()}
    assert stats["all"].converged and stats["only a"].converged
    assert not stats["tiny"].converged and stats["tiny"].scale is None and stats["tiny"].n_obs == 2
    assert res.blup().filter("model = 'tiny' AND u0 IS NOT NULL").count() == 0


def test_no_rows_and_text_numbers(spark):
    df = _synthetic(spark)
    assert M.fit_lmm(df.limit(0), "y", "e", fixed=["v"], factors={"g": "mode"}).coefficients.count() == 0
    text = df.withColumn("y", F.col("y").cast("string")).unionByName(
        spark.createDataFrame([(1, 0.0, 0.0, "a", "junk")], "e long, v double, x double, g string, y string"))
    a = M.fit_lmm(text, "y", "e", fixed=["v"]).fits["model"]
    assert np.allclose(a["beta"], M.fit_lmm(df, "y", "e", fixed=["v"]).fits["model"]["beta"], atol=1e-8)


def test_the_mode_is_that_of_all_rows(spark):
    rows = [(i % 7, float(i % 3), "often", None) for i in range(60)] + [(i % 7, float(i % 3), "a" if i % 3 else "b", float(i * i % 11)) for i in range(40)]
    rows += [(i % 7, 1.0, "often", float(i)) for i in range(5)]
    res = M.fit_lmm(spark.createDataFrame(rows, "e long, x double, g string, y double"), "y", "e", ["x"], {"g": "mode"})
    assert res.terms == ["Intercept", "g[T.a]", "g[T.b]", "x"]


@pytest.mark.parametrize("max_patterns", [20_000, 0])
def test_given_covariance_is_not_searched_for(spark, max_patterns):
    df = _synthetic(spark)
    free = M.fit_lmm(df, "y", "e", ["v", "x"], {"g": "a"}, slope="v")
    held = M.fit_lmm(df, "y", "e", ["v", "x"], {"g": "a"}, slope="v", covariance=free.fits["model"]["gamma"].tolist(), max_patterns=max_patterns)
    assert held.fits["model"]["m2ll"] == pytest.approx(free.fits["model"]["m2ll"], rel=1e-12)
    assert held.fits["model"]["beta"] == pytest.approx(free.fits["model"]["beta"], rel=1e-9)
    other = M.fit_lmm(df, "y", "e", ["v", "x"], {"g": "a"}, slope="v", covariance=[[1.0, 0.1], [0.1, 0.5]])
    assert other.fits["model"]["m2ll"] > free.fits["model"]["m2ll"]


def test_many_patterns_take_one_entity_table(spark, monkeypatch):
    """The entity table is made once and kept; patterns too many for the driver are counted, not summed."""
    calls, real = [], M.pattern_stats
    monkeypatch.setattr(M, "pattern_stats", lambda *a: calls.append(a) or real(*a))
    df = _synthetic(spark)
    fit = lambda **kw: M.fit_lmm(df, "y", "e", fixed=["v", "x"], factors={"g": "a"}, slope="v", **kw)
    many = fit(max_patterns=0)
    assert not calls and many.entity_table.inputFiles()
    few = fit()
    assert len(calls) == 1 and few.entity_table.inputFiles()
    assert many.fits["model"]["beta"] == pytest.approx(few.fits["model"]["beta"], rel=1e-6)
    P, gams = 5, [np.array([[0.4, -0.1], [-0.1, 0.2]]), np.diag([-1.0, 0.0]), np.diag([2.0, 0.0])]
    pats = M._assemble(real(few.entity_table, P, 2).toPandas(), P, 2)
    got = M._entity_sums(many.entity_table, {"model": gams}, P, 2)
    for i, gam in enumerate(gams):
        log, low, t = M._pattern_sums(pats, gam)
        assert got["model", i][:2] == pytest.approx((log, low))
        if low > 0:
            assert got["model", i][2] == pytest.approx(t, rel=1e-9, abs=1e-9)
