"""Null groups, constant columns, very small samples, text columns, long and
far-off series."""

import math

import numpy as np
import pytest

from wavepanel.operators import clean, hypothesis, series


def test_chi2_leaves_out_rows_without_a_level(spark):
    rows = [("a", 1.0 if i % 3 else None) for i in range(30)] + [("b", 1.0 if i % 2 else None) for i in range(40)]
    schema = "stage string, x double"
    plain = hypothesis.chi2_independence(spark.createDataFrame(rows, schema), "stage", ["x"]).first()
    more = rows + [(None, None if i % 4 else 1.0) for i in range(40)]
    assert hypothesis.chi2_independence(spark.createDataFrame(more, schema), "stage", ["x"]).first() == plain


def test_profiles_of_very_few_values(spark):
    for n in (1, 2, 3, 7):
        df = spark.createDataFrame([(float(i * i),) for i in range(n)], "x double")
        r = hypothesis.numeric_profile(df, ["x"]).first()
        assert r.n == n and r.k2 is None and r.k2_p is None


def test_shapiro_of_three_values_and_fewer(spark):
    rows = [("three", 1.0), ("three", 2.0), ("three", 4.0), ("two", 1.0), ("two", 2.0), ("one", 1.0), ("flat", 5.0),
            ("flat", 5.0), ("flat", 5.0)]
    got = {r.variable: r for r in hypothesis.shapiro_wilk(spark.createDataFrame(rows, "variable string, value double")).collect()}
    assert got["three"].w == pytest.approx(0.9642857, abs=1e-6)
    assert got["three"].sw_p == pytest.approx(6 / math.pi * (math.asin(math.sqrt(27 / 28)) - math.asin(math.sqrt(0.75))))
    assert all(got[k].w is None and got[k].sw_p is None for k in ("two", "one", "flat"))


def test_anderson_of_a_constant_column(spark):
    r = hypothesis.anderson_darling(spark.createDataFrame([("x", 5.0)] * 9, "variable string, value double")).first()
    assert r.n == 9 and r.a2 is None


def test_clip_audit_of_a_text_column(spark):
    df = spark.createDataFrame([("0",), ("9",), ("junk",), ("-3",), (None,), ("2",)], "x string")
    r = clean.clip_audit(df, {"x": (1, 5)}).first()
    assert (r.n_zero, r.n_below, r.n_above) == (1, 1, 1)


def adf(x, lag):
    dx = np.diff(x)
    rows = range(lag, len(dx))
    y = dx[lag:]
    X = np.column_stack([[x[i] for i in rows], np.ones(len(y)), *[[dx[i - j] for i in rows] for j in range(1, lag + 1)]])
    beta, *_ = np.linalg.lstsq(X - np.r_[x.mean(), np.zeros(X.shape[1] - 1)], y, rcond=None)
    X[:, 0] -= x.mean()
    res = y - X @ beta
    s2 = res @ res / (len(y) - X.shape[1])
    return beta[0] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0])


def kpss(x, lags):
    r = x - x.mean()
    n = len(r)
    s = r @ r + 2 * sum((1 - i / (lags + 1)) * (r[i:] @ r[:-i]) for i in range(1, lags + 1))
    return (np.cumsum(r) ** 2).sum() / n ** 2 / (s / n)


def test_long_series_and_series_far_from_zero(spark):
    rng = np.random.default_rng(5)
    noise = rng.normal(size=430)
    slow = np.zeros(430)
    for t in range(15, 430):
        slow[t] = 0.9 * slow[t - 15] + noise[t]
    walk = np.cumsum(rng.normal(size=90))
    data = {"slow": slow[30:], "walk": walk, "far": walk + 1e7, "drift": np.cumsum(rng.normal(size=400))}
    rows = [(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    got = {r.series: r for r in series.series_tests(spark.createDataFrame(rows, "key string, t int, x double"), "key", ["t"], "x")
           .collect()}
    for k, x in data.items():
        assert got[k].adf_stat == pytest.approx(adf(x - x.mean(), got[k].adf_lag), rel=1e-4), k
        assert got[k].kpss_stat == pytest.approx(kpss(x, got[k].kpss_lags), rel=1e-6), k
    assert got["slow"].adf_lag > 12
    assert got["far"].adf_stat == pytest.approx(got["walk"].adf_stat, rel=1e-4) and got["drift"].kpss_lags > 0


def test_partial_autocorrelations_of_a_text_key(spark):
    rng = np.random.default_rng(6)
    x = np.convolve(rng.normal(size=200), [1, 0.5, 0.25], "valid")
    rows = [("s", i, float(v)) for i, v in enumerate(x)]
    got = series.acf_pacf(spark.createDataFrame(rows, "key string, t int, x double"), "key", ["t"], "x", nlags=4).collect()
    r = x - x.mean()
    rho = [1.0] + [r[k:] @ r[:-k] / (r @ r) for k in range(1, 5)]
    for row in got:
        k = row.lag
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert row.pacf == pytest.approx(np.linalg.solve(system, rho[1:k + 1])[-1], abs=1e-9)
    assert len(got) == 4
