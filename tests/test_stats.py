"""Correlation, tests and series: compared with direct numpy computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from wavepanel.functions import special as S
from wavepanel.operators import correlate as C
from wavepanel.operators import hypothesis as H
from wavepanel.operators import series as SR
from wavepanel.operators.describe import mean_se
from wavepanel.sources.testdata import event_series, numeric_panel, orders_panel


def test_special_functions_known_values():
    assert math.isclose(S.norm_ppf(0.975), 1.959963984540054, rel_tol=1e-12)
    assert math.isclose(S.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(S.t_two_sided(2.228138851986274, 10), 0.05, rel_tol=1e-8)
    assert math.isclose(S.f_sf(3.0, 2, 20), 1.3 ** -10, rel_tol=1e-10)        # d1 = 2: (1 + f/10)^-10


def test_vif_matches_auxiliary_regressions(spark):
    cols = ["m1", "e1", "x1", "age", "qty"]
    df = numeric_panel(spark, SF_SMALL)
    got = {r.variable: r.vif for r in C.vif(df, cols).collect()}
    X = np.array(df.select(*cols).dropna().collect(), dtype=float)
    for j, c in enumerate(cols):
        y, Z = X[:, j], np.delete(X, j, axis=1)
        b, *_ = np.linalg.lstsq(Z, y, rcond=None)
        ssr = np.sum((y - Z @ b) ** 2)
        r2_uncentred = 1 - ssr / np.sum(y ** 2)
        assert math.isclose(got[c], 1 / (1 - r2_uncentred), rel_tol=1e-8)
        assert got[c] >= 1


def test_vif_singular_is_reported(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2.0), (2.0, 1.0, 1.0), (3.0, 5.0, 5.0)], "a double, b double, c double")
    out = C.vif(df, ["a", "b", "c"]).collect()
    assert all(r.singular for r in out)


def test_alpha_matches_numpy(spark):
    p = orders_panel(spark, SF_SMALL)
    items = ["e1", "e2", "e3"]
    got = C.cronbach_alpha(p, {"s": items, "pair": ["m1", "m2"]}).collect()
    for r in got:
        its = items if r.scale == "s" else ["m1", "m2"]
        X = np.array(p.select(*its).dropna().collect(), dtype=float)
        Z = (X - X.mean(0)) / X.std(0)
        k = Z.shape[1]
        alpha = k / (k - 1) * (1 - Z.var(0).sum() / Z.sum(1).var())
        assert math.isclose(r.alpha, alpha, rel_tol=1e-9)
        assert r.alpha <= 1


def test_corr_long_pairwise_complete(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 8.0)], "a double, b double")
    r = C.corr_long(df, ["a", "b"]).collect()[0]
    assert r.n == 3 and math.isclose(r.r, np.corrcoef([1, 3, 4], [2, 7, 8])[0, 1])


def test_corr_of_many_columns_far_off_constant_and_empty(spark):
    import pandas as pd
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 29)) @ rng.normal(size=(29, 29)) + 1e7
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 3] = 0.1
    names = [f"v{i}" for i in range(29)]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names)).repartition(3)
    want = pd.DataFrame(x, columns=names).corr()
    got = C.corr_long(df, names).collect()
    assert len(got) == 29 * 28 // 2
    for r in got:
        if "v3" in (r.var1, r.var2):
            assert r.r is None and r.n > 300
        else:
            assert math.isclose(r.r, want.loc[r.var1, r.var2], abs_tol=1e-8)
    assert [(r.r, r.n) for r in C.corr_long(df.limit(0), ["v0", "v1"]).collect()] == [(None, 0)]


def test_little_mcar_matches_numpy(spark):
    p = orders_panel(spark, SF_SMALL)
    cols = ["m1", "m2", "e1"]
    got = H.little_mcar(p, cols).collect()[0]
    import pandas as pd
    X = pd.DataFrame(p.select(*cols).collect(), columns=cols, dtype=float)
    mu, cov = X.mean(), X.cov()
    mask = X.isnull().dot(2 ** np.arange(len(cols)))
    d2, pj = 0.0, 0
    for _, g in X.groupby(mask):
        obs = [c for c in cols if not g[c].isnull().any()]
        pj += len(obs)
        if obs:
            diff = (g[obs].mean() - mu[obs]).to_numpy()
            d2 += len(g) * diff @ np.linalg.solve(cov.loc[obs, obs].to_numpy(), diff)
    assert math.isclose(got.d2, d2, rel_tol=1e-9) and got.dof == pj - len(cols)


def test_chi2_independence_against_formula(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("a", None)] * 10 + [("b", 1.0)] * 20 + [("b", None)] * 20
                               + [("c", 1.0)] * 5 + [("c", None)] * 15, "g string, x double")
    r = H.chi2_independence(df, "g", ["x"]).collect()[0]
    O = np.array([[30, 10], [20, 20], [5, 15]], dtype=float)
    E = O.sum(1, keepdims=True) * O.sum(0, keepdims=True) / O.sum()
    stat = ((O - E) ** 2 / E).sum()
    assert math.isclose(r.chi2, stat, rel_tol=1e-12) and r.dof == 2
    assert math.isclose(r.p, math.exp(-stat / 2), rel_tol=1e-9)        # chi2 with 2 df


def test_normality_tests_sanity(spark):
    rng = np.random.default_rng(3)
    data = [(float(v), i) for i, v in enumerate(rng.normal(size=400))] + \
           [(float(v), i) for i, v in enumerate(rng.exponential(size=400), start=1000)]
    df = spark.createDataFrame(data, "x double, k long").withColumn(
        "grp", F.when(F.col("k") < 1000, "normal").otherwise("skewed"))
    sample = df.select(F.col("grp").alias("variable"), F.col("x").alias("value"))
    sw = {r.variable: r for r in H.shapiro_wilk(sample).collect()}
    ad = {r.variable: r for r in H.anderson_darling(sample).collect()}
    assert sw["normal"].w > 0.99 and sw["normal"].sw_p > 0.01
    assert sw["skewed"].w < 0.9 and sw["skewed"].sw_p < 1e-6
    assert ad["normal"].ad_p > 0.01 and ad["skewed"].ad_p < 1e-6
    for r in H.normality_verdict(sample).collect():
        assert r.verdict == ("normal" if r.variable == "normal" else "not normal")
    prof = {r.variable: r for r in H.numeric_profile(df.select(
        F.when(F.col("grp") == "normal", F.col("x")).alias("n"),
        F.when(F.col("grp") == "skewed", F.col("x")).alias("s")), ["n", "s"]).collect()}
    assert prof["n"].k2_p > 0.01 and prof["s"].k2_p < 1e-6


def test_mean_se_uses_all_rows(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", 3.0), ("g", None), ("g", None)], "g string, value double")
    r = mean_se(df, ["g"]).collect()[0]
    assert r.n_valid == 2 and r.n_rows == 4 and math.isclose(r.se, np.std([1, 3], ddof=1) / 2)


def _brute_series(x):
    n = len(x)
    maxlag = SR.adf_max_lag(n)
    dx = np.diff(x)

    def design(lag, start):
        X = np.array([[1.0, x[t - 1]] + [dx[t - 1 - j] for j in range(1, lag + 1)] for t in range(start, n)])
        return X, np.array([dx[t - 1] for t in range(start, n)])

    def ols(X, y):
        b, *_ = np.linalg.lstsq(X, y, rcond=None)
        return b, float(np.sum((y - X @ b) ** 2))

    best = None
    for lag in range(maxlag + 1):
        X, y = design(lag, maxlag + 1)
        _, ssr = ols(X, y)
        aic = len(y) * (math.log(2 * math.pi) + math.log(ssr / len(y)) + 1) + 2 * X.shape[1]
        if best is None or aic < best[0] - 1e-12:
            best = (aic, lag)
    X, y = design(best[1], best[1] + 1)
    b, ssr = ols(X, y)
    t = b[1] / math.sqrt(ssr / (len(y) - X.shape[1]) * np.linalg.inv(X.T @ X)[1, 1])
    return t, best[1]


def test_series_tests_match_brute_force(spark):
    ev = event_series(spark, SF_SMALL)
    res = {r.series: r for r in SR.series_tests(ev, "series_id", ["t", "event_id"], "value").collect()}
    pdf = ev.toPandas().sort_values(["series_id", "t", "event_id"])
    for sid, g in pdf.groupby("series_id"):
        x = g.value.to_numpy(float)
        if len(x) < 10:
            assert res[sid].adf_stat is None
            continue
        t, lag = _brute_series(x)
        assert math.isclose(res[sid].adf_stat, t, rel_tol=1e-7) and res[sid].adf_lag == lag
        assert 0.01 <= res[sid].kpss_p <= 0.10


def test_short_series_get_null_statistics(spark):
    df = spark.createDataFrame([(1, i, float(i % 3)) for i in range(6)], "s long, t long, v double")
    r = SR.series_tests(df, "s", ["t"], "v").collect()[0]
    assert r.n == 6 and r.adf_stat is None and r.kpss_stat is None and r.arch_lm is None


def test_acf_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.cumsum(rng.normal(size=60))
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "s long, t long, v double")
    got = {r.lag: r for r in SR.acf_pacf(df, "s", ["t"], "v", nlags=3).collect()}
    r = x - x.mean()
    for k in (1, 2, 3):
        assert math.isclose(got[k].acf, np.dot(r[k:], r[:-k]) / np.dot(r, r), rel_tol=1e-9)
    assert math.isclose(got[1].pacf, got[1].acf)


def test_exact_quantiles_equal_numpy_in_every_group(spark):
    from wavepanel.operators.describe import exact_quantiles
    rng = np.random.default_rng(8)
    groups = {"many": rng.normal(size=3001), "ties": rng.integers(0, 4, 500).astype(float), "one": np.array([7.0]),
              None: np.array([1.0, 2.0, 3.0, 10.0])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("many", None), ("empty", None)]
    probs = [0.0, 0.25, 0.333, 0.5, 0.75, 1.0]
    got = {r.g: r.q for r in exact_quantiles(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", probs).collect()}
    assert got.keys() == groups.keys()
    for g, x in groups.items():
        assert np.allclose(got[g], np.quantile(x, probs), rtol=1e-12, atol=1e-12)

def test_array_normal_functions():
    x = np.concatenate([np.linspace(-9, 9, 4001), [-37.0, 0.0, 3.0, 37.0]])
    tail, log = S.upper_tail(x)
    assert np.allclose(tail, [S.norm_sf(v) for v in x], rtol=1e-11, atol=0)
    assert np.allclose(log, [S.norm_logcdf(-v) for v in x], rtol=1e-10, atol=1e-16)
    p = np.concatenate([10.0 ** -np.arange(1, 15), np.linspace(0.001, 0.999, 999)])
    assert np.allclose(S.normal_quantile(p), [S.norm_ppf(v) for v in p], rtol=1e-9, atol=1e-12)


def plain_shapiro(x):
    """W with a weight for each rank."""
    x, n = np.sort(x), len(x)
    m = np.array([S.norm_ppf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = m @ m, 1 / math.sqrt(n)
    a = m.copy()
    end = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    if n > 5:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
        a /= math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * end ** 2 - 2 * second ** 2))
        a[-2], a[1] = second, -second
    else:
        a /= math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * end ** 2))
    a[-1], a[0] = end, -end
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


def plain_anderson(x):
    x, n = np.sort(x), len(x)
    z = (x - x.mean()) / x.std(ddof=1)
    i = np.arange(1, n + 1)
    lower, upper = (np.array([S.norm_logcdf(s * v) for v in z]) for s in (1, -1))
    return -n - ((2 * i - 1) * lower + (2 * n + 1 - 2 * i) * upper).sum() / n


def test_normality_tests_use_every_row(spark, monkeypatch):
    """Published example (eleven weights: W = 0.7888, p = 0.0067), ties, one value holding most
    rows, more rows than 5,000; runs of ranks kept short so that values span several."""
    monkeypatch.setattr("wavepanel.functions.udfs.RANKS_AT_ONCE", 700)
    rng = np.random.default_rng(8)
    data = {"weights": [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "four": [1, 2, 2, 9], "five": [1, 5, 3, 2, 9],
            "ties": list(rng.integers(0, 6, 900)), "long": list(rng.normal(size=7000) + 1e6),
            "hot": [0.5] * 4000 + list(rng.normal(size=2500))}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("four", None), ("four", math.nan)],
                               "variable string, value double").repartition(5)
    sw = {r.variable: r for r in H.shapiro_wilk(df).collect()}
    ad = {r.variable: r for r in H.anderson_darling(df).collect()}
    for k, vs in data.items():
        x = np.array(vs, dtype=float)
        assert sw[k].n == ad[k].n == len(x)
        assert math.isclose(sw[k].w, plain_shapiro(x), rel_tol=1e-7), k
        assert math.isclose(ad[k].a2, plain_anderson(x), rel_tol=1e-6, abs_tol=1e-7), k
    assert abs(sw["weights"].w - 0.78881) < 1e-5 and abs(sw["weights"].sw_p - 0.006704) < 1e-6
    assert H.shapiro_wilk(df.limit(0)).count() == 0 == H.anderson_darling(df.limit(0)).count()


def test_quantiles_of_awkward_values(spark):
    """Infinities, spread over many orders of magnitude, all within one narrow band, NaN, weights."""
    from wavepanel.operators.describe import exact_quantiles
    rng = np.random.default_rng(4)
    groups = {"wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 900), -10.0 ** rng.uniform(-300, 300, 900)]),
              "narrow": np.concatenate([1000 + rng.normal(size=3000) * 1e-9, [1e300]]), "halves": np.array([-1e308, 1e308, 0.0]),
              "infinite": np.concatenate([rng.normal(size=50), [np.inf] * 30, [-np.inf] * 30]), "same": np.full(40, 5.0), "big": np.arange(20_000) * 1.0}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("same", None), ("same", float("nan")), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    probs = [0.0, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    got = {r.g: r.q for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    assert got.keys() == groups.keys()
    for k, x in groups.items():
        if k == "infinite":
            assert got[k][0] == -np.inf and got[k][-1] == np.inf and math.isclose(got[k][3], np.median(x))
            continue
        assert got[k] == pytest.approx(np.quantile(x, probs).tolist(), rel=1e-12, abs=1e-300), k
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (9.0, 6)], "x double, c long")
    assert exact_quantiles(weighted, [], "x", [0.5, 0.25], weight="c").first().q == [9.0, 1.25]
    from wavepanel.operators.describe import group_stats
    r = group_stats(spark.createDataFrame([(None, v) for v in (1.0, 2.0, 3.0, float("nan"))], "g string, x double"), ["g"], ["x"]).first()
    assert (r.n, r["mean"], r["median"]) == (3, 2.0, 2.0)


def test_little_mcar_of_awkward_columns(spark):
    """Constant, collinear, text, all-null and no rows: defined results, and what they add to nothing."""
    rng = np.random.default_rng(3)
    rows = [(float(a) if rng.random() < 0.8 else None, float(a + b) if rng.random() < 0.7 else None, 4.0, str(round(b, 3)) if rng.random() < 0.9 else "?", None)
            for a, b in rng.normal(size=(300, 2))]
    df = spark.createDataFrame(rows, "a double, b double, constant double, words string, none double")
    plain = H.little_mcar(df.select("a", "b", F.expr("try_cast(words AS double)").alias("words")), ["a", "b", "words"]).first()
    odd = H.little_mcar(df, ["a", "b", "constant", "words", "none"]).first()
    # sums of doubles may differ in the last digit with the order of the tasks
    assert math.isclose(odd.d2, plain.d2, rel_tol=1e-12) and math.isclose(odd.p, plain.p, rel_tol=1e-12)
    assert (odd.dof, odd.n_patterns, odd.verdict) == (plain.dof, plain.n_patterns, plain.verdict)
    assert plain.dof > 0 and 0 <= plain.p <= 1
    twice = H.little_mcar(df.withColumn("a2", F.col("a") * 2), ["a", "a2", "b", "words"]).first()
    assert twice.dof == plain.dof and math.isclose(twice.d2, plain.d2, rel_tol=1e-6)
    for cols in (["constant"], ["none"], ["constant", "none"]):
        r = H.little_mcar(df, cols).first()
        assert (r.d2, r.dof, r.p, r.verdict) == (0.0, 0, None, None)
    r = H.little_mcar(df.limit(0), ["a", "b"]).first()
    assert (r.d2, r.dof, r.p, r.n_patterns) == (0.0, 0, None, 0)
