"""Series of any length and place in the data: sums by chunk against numpy."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.operators import series as SR

SCHEMA = "key string, t long, x string"


def ols(y, x):
    b, *_ = np.linalg.lstsq(x, y, rcond=None)
    return b, float(((y - x @ b) ** 2).sum())


def arch(x, most=10):
    a = (x - x.mean()) ** 2
    p, n = min(most, len(x) // 5), len(x)
    design = np.column_stack([np.ones(n - p), *[a[p - j:n - j] for j in range(1, p + 1)]])
    _, ssr = ols(a[p:], design)
    r2 = 1 - ssr / ((a[p:] - a[p:].mean()) ** 2).sum()
    return (n - p) * r2, (r2 / p) / ((1 - r2) / (n - 2 * p - 1)), p


def adf(x, most=None):
    n, dx = len(x), np.diff(x)
    most = SR.adf_max_lag(n) if most is None else most
    design = lambda lag, start: np.column_stack([np.ones(n - start), x[start - 1:n - 1] - x.mean(),
                                                 *[dx[start - 1 - j:n - 1 - j] for j in range(1, lag + 1)]])
    aic = []
    for lag in range(most + 1):
        d = design(lag, most + 1)
        _, ssr = ols(dx[most:], d)
        aic.append(len(d) * (math.log(2 * math.pi) + math.log(ssr / len(d)) + 1) + 2 * d.shape[1])
    lag = int(np.argmin(aic))
    d = design(lag, lag + 1)
    b, ssr = ols(dx[lag:], d)
    return b[1] / math.sqrt(ssr / (len(d) - d.shape[1]) * np.linalg.inv(d.T @ d)[1, 1]), lag


def kpss(x, lags):
    r, n = x - x.mean(), len(x)
    s = r @ r + 2 * sum((1 - i / (lags + 1)) * (r[i:] @ r[:-i]) for i in range(1, lags + 1))
    return (np.cumsum(r) ** 2).sum() / n / s


def garch(rng, n):
    e, x, v = rng.normal(size=n), np.zeros(n), 1.0
    for t in range(n):
        v = 0.2 + 0.5 * (x[t - 1] ** 2 if t else 0) + 0.3 * v
        x[t] = math.sqrt(v) * e[t]
    return x


@pytest.mark.parametrize("block_rows", [64, 65_536])
def test_tests_equal_plain_regressions(spark, block_rows):
    rng = np.random.default_rng(9)
    data = {"garch": garch(rng, 900), "walk": np.cumsum(rng.normal(size=700)), "short": rng.normal(size=23),
            "trend": np.arange(500) * 0.3 + garch(rng, 500), "ten": rng.normal(size=10), None: garch(rng, 300) + 1e6}
    rows = [(k, i, repr(float(v))) for k, x in data.items() for i, v in enumerate(x)]
    rows += [("garch", 5, None), ("garch", 7, "junk"), ("walk", 3, "NaN"), ("none", 1, "text"), ("flat", 1, "2")] + [("flat", i, "2") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {r.series: r for r in SR.series_tests(df, "key", ["t"], "x", block_rows=block_rows).collect()}
    assert got.keys() == {*data, "flat"}
    assert (got["flat"].adf_stat, got["flat"].kpss_stat, got["flat"].arch_lm, got["flat"].n) == (None, None, None, 41)
    for k, x in data.items():
        r = got[k]
        lm, f, p = arch(x)
        assert (r.n, r.arch_lags) == (len(x), p)
        assert r.arch_lm == pytest.approx(lm, rel=1e-6) and (r.arch_f == pytest.approx(f, rel=1e-6) if f > 0 else r.arch_f is None)
        t, lag = adf(x)
        assert r.adf_lag == lag and r.adf_stat == pytest.approx(t, rel=1e-5), k
        assert r.kpss_stat == pytest.approx(kpss(x, r.kpss_lags), rel=1e-6), k
    assert got["garch"].arch_lm_p < 0.01 and got["walk"].adf_p > 0.01


def test_a_million_values_plan_in_seconds_and_spread(spark):
    """One series, a third of it at one place of the order; 120 lags of differences, 870 of values."""
    n = 1_000_000
    x = (F.sin(F.col("id") * 0.7) + F.sin(F.col("id") * F.col("id") % 1013) + F.cos(F.col("id") * 0.003)).alias("x")
    df = spark.range(n, numPartitions=8).select(F.lit("one").alias("key"), F.greatest("id", F.lit(n // 3)).alias("t"), F.col("id").alias("u"), x)
    begun = time.time()
    out = SR.series_tests(df, "key", ["t", "u"], "x")
    plan = time.time() - begun
    r = out.collect()[0]
    v = np.array([q.x for q in df.orderBy("u").select("x").collect()])
    lags = SR.kpss_most_lags(n)
    assert SR.adf_max_lag(n) == 120 and 800 < lags < 900
    assert r.kpss_stat == pytest.approx(kpss(v, r.kpss_lags), rel=1e-6)
    assert r.arch_lm == pytest.approx(arch(v)[0], rel=1e-6)
    assert plan < 60                                    # the one job that writes the blocks
    from wavepanel.operators.blocks import chunks, ordered_blocks
    blocks = ordered_blocks(df, "key", ["t", "u"], "x")
    assert blocks.count() >= 16 and blocks.select("part").distinct().count() >= 4
    dealt = chunks(blocks, lambda n: 900).groupBy("chunk").agg(F.sum(F.length("values") / 8).alias("n")).agg(F.max("n")).first()[0]
    assert dealt <= 65_536 + 900


def test_partial_autocorrelations_stay_in_the_jvm(spark):
    df = spark.createDataFrame([("a", i, str(i * i % 7)) for i in range(30)] + [("flat", i, "1") for i in range(5)] + [("one", 1, "3")], SCHEMA)
    got = {(r.series, r.lag): (r.acf, r.pacf) for r in SR.acf_pacf(df, "key", ["t"], "x", nlags=6).collect()}
    x = np.array([i * i % 7 for i in range(30)], float)
    r = x - x.mean()
    rho = [1.0] + [r[k:] @ r[:-k] / (r @ r) for k in range(1, 7)]
    for k in range(1, 7):
        system = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got["a", k] == (pytest.approx(rho[k]), pytest.approx(np.linalg.solve(system, rho[1:k + 1])[-1], abs=1e-9))
        assert got["flat", k] == got["one", k] == (None, None)
    assert SR.acf_pacf(df.limit(0), "key", ["t"], "x").collect() == []
    plan = SR.acf_pacf(df, "key", ["t"], "x")._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan


def test_short_chunks_are_summed_in_a_few_batches_and_passes(spark):
    """No Python group a chunk, no second Python pass for the tests, few rows as Python numbers at once."""
    df = spark.range(6_000, numPartitions=3).select((F.col("id") % 90).alias("key"), F.col("id").alias("t"), ((F.col("id") * 7919) % 103).alias("x"))
    out = SR.series_tests(df, "key", ["t"], "x", block_rows=8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.count("MapInArrow") == 5         # whole; dealt, units, groups, keys
    assert SR.series_tests(df, "key", ["t"], "x")._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5
    plain = {r.series: r for r in SR.series_tests(df, "key", ["t"], "x").collect()}
    got = out.collect()
    assert len(got) == len(plain) == 90
    for r in got:
        assert [*r] == [None if x is None else pytest.approx(x, rel=1e-6, abs=1e-9) for x in plain[r.series]]


def test_rows_are_taken_in_slices():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 5 + [None] * 3 + [2] * 992), pa.array([[0.5]] * 1000)], names=["key", "s"])
    assert [b.num_rows for b in SR._slices([batch, batch])] == [256, 256, 256, 232] * 2
    assert [(k.to_pylist(), len(rows)) for k, rows in SR._runs([batch], 1)] == [([1], 5), ([None], 3), ([2], 992)]
