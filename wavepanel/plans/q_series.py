"""Per-series queries (TST7-TST9, WIN4-WIN7, PLT10) on the events table:
series = user, order = (timestamp, event id), value = event value."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from wavepanel.operators import series as SR
from wavepanel.operators.segments import Rows
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import EVENT_SERIES_SQL, event_series, with_cte

ORDER = ["t", "event_id"]
NLAGS = 10
#: The plan of hot series: blocks of eight values, so most series are split and put together again.
SMALL_BLOCKS = 8


@register("series_tests")
def q_series_tests(spark, sf):
    """ADF / KPSS / ARCH-LM per series (checked against a numpy brute force in tests)."""
    return SR.series_tests(event_series(spark, sf), "series_id", ORDER, "value")


def _acf_sql():
    lags = ", ".join(f"lag(r, {j}) OVER (PARTITION BY series_id ORDER BY t, event_id) AS l{j}"
                     for j in range(1, NLAGS + 1))
    parts = "\nUNION ALL ".join(f"SELECT series_id, {j} AS lag, round(sum(r * coalesce(l{j}, 0)) / sum(r * r), 6) + 0.0 AS acf "
                                f"FROM lagged GROUP BY series_id" for j in range(1, NLAGS + 1))
    return with_cte(parts, ev=EVENT_SERIES_SQL,
                    s="SELECT series_id, t, event_id, value - avg(value) OVER (PARTITION BY series_id) AS r FROM ev",
                    lagged=f"SELECT series_id, r, {lags} FROM s")


@register("series_acf", _acf_sql())
def q_series_acf(spark, sf):
    out = SR.autocorrelation(event_series(spark, sf), "series_id", ORDER, "value", NLAGS)
    return out.select("series_id", "lag", F.round("acf", 6).alias("acf"))


PLACED = """SELECT series_id, CAST(row_number() OVER w - 1 AS BIGINT) AS pos, value - avg(value) OVER (PARTITION BY series_id) AS r,
       value - lag(value) OVER w AS dx, count(*) OVER (PARTITION BY series_id) AS n
FROM ev WHERE value IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY t, event_id)"""
RHOS = f"""SELECT series_id, list(ac / nullif(a0, 0) ORDER BY lag) AS rho FROM (
  SELECT a.series_id, j.lag, sum(a.r * coalesce(b.r, 0)) AS ac, sum(a.r * a.r) AS a0
  FROM s AS a CROSS JOIN (SELECT unnest(range(1, {NLAGS + 1})) AS lag) AS j
  LEFT JOIN s AS b ON b.series_id = a.series_id AND b.pos = a.pos - j.lag GROUP BY a.series_id, j.lag) GROUP BY series_id"""


@register("series_acf_pacf", f"""WITH RECURSIVE ev AS ({EVENT_SERIES_SQL}), s AS ({PLACED}), rhos AS ({RHOS}),
dl AS (
  SELECT series_id, rho, 1 AS lag, [rho[1]] AS phi FROM rhos
  UNION ALL
  SELECT series_id, rho, lag + 1, list_append(list_transform(range(1, lag + 1), lambda i: phi[i] - fresh * phi[lag + 1 - i]), fresh)
  FROM (SELECT *, (rho[lag + 1] - list_dot_product(phi, list_reverse(rho[1:lag])))
                  / nullif(1 - list_dot_product(phi, rho[1:lag]), 0) AS fresh FROM dl WHERE lag < {NLAGS}))
SELECT series_id AS series, lag, round(rho[lag], 6) + 0.0 AS acf, round(phi[lag], 6) + 0.0 AS pacf FROM dl""")
def q_series_pacf(spark, sf):
    out = SR.acf_pacf(event_series(spark, sf), "series_id", ORDER, "value", NLAGS)
    return out.select("series", "lag", (F.round("acf", 6) + 0.0).alias("acf"), (F.round("pacf", 6) + 0.0).alias("pacf"))


@register("series_lag_products", with_cte(f"""
SELECT a.series_id, CAST(j.lag AS INTEGER) AS lag, round(sum(a.r * coalesce(b.r, 0)) / nullif(sum(a.r * a.r), 0), 7) + 0.0 AS levels,
       round(coalesce(sum(a.dx * b.dx), 0) / nullif(sum(a.r * a.r), 0), 7) + 0.0 AS differences,
       round(coalesce(sum(c.r * b.dx), 0) / nullif(sum(a.r * a.r), 0), 7) + 0.0 AS mixed
FROM s AS a CROSS JOIN (SELECT unnest(range(0, {NLAGS + 1})) AS lag) AS j
LEFT JOIN s AS b ON b.series_id = a.series_id AND b.pos = a.pos - j.lag
LEFT JOIN s AS c ON c.series_id = a.series_id AND c.pos = a.pos - 1
GROUP BY a.series_id, j.lag""", ev=EVENT_SERIES_SQL, s=PLACED))
def q_series_lag_products(spark, sf):
    """Sums of lag products (WIN4), by the series' sum of squares."""
    out = SR.lag_products(event_series(spark, sf), "series_id", ORDER, "value", NLAGS, block_rows=SMALL_BLOCKS)
    square = F.max(F.when(F.col("lag") == 0, F.col("levels"))).over(Window.partitionBy("series_id"))
    out = out.withColumn("square", square)
    return out.select("series_id", "lag", *[(F.round(F.try_divide(c, "square"), 7) + 0.0).alias(c) for c in ("levels", "differences", "mixed")])


def _running_sql(key: str) -> str:
    return with_cte("""
SELECT series_id, n, round(sum(c), 3) + 0.0 AS cum_sum, round(sum(c * c), 2) + 0.0 AS cum_square
FROM (SELECT series_id, n, sum(r) OVER (PARTITION BY series_id ORDER BY pos) AS c FROM s) GROUP BY series_id, n""",
                    ev=f"SELECT {key} AS series_id, t, event_id, value FROM ({EVENT_SERIES_SQL})", s=PLACED)


@register("series_running_sum", _running_sql("series_id"))
def q_series_running_sum(spark, sf):
    """The running sum of the demeaned values (WIN5)."""
    out = SR.running_squares(event_series(spark, sf), "series_id", ORDER, "value")
    return out.select("series_id", "n", (F.round("cum_sum", 3) + 0.0).alias("cum_sum"), (F.round("cum_square", 2) + 0.0).alias("cum_square"))


def _kpss_sql(key: str, most: str) -> str:
    return with_cte("""
SELECT series_id AS series, n, round(stat, 6) AS kpss_stat, lags AS kpss_lags,
       round(CASE WHEN stat <= 0.347 THEN 0.10 WHEN stat <= 0.463 THEN 0.10 - 0.05 * (stat - 0.347) / (0.463 - 0.347)
                  WHEN stat <= 0.574 THEN 0.05 - 0.025 * (stat - 0.463) / (0.574 - 0.463)
                  WHEN stat <= 0.739 THEN 0.025 - 0.015 * (stat - 0.574) / (0.739 - 0.574) ELSE 0.01 END, 6) AS kpss_p
FROM (
  SELECT series_id, n, lags, c2 / (n * n) / ((a0 + 2 * coalesce(list_sum(list_transform(range(1, lags + 1),
             lambda i: ac[i] * (1 - i / (lags + 1.0)))), 0)) / n) AS stat
  FROM (SELECT *, CAST(least(floor(1.1447 * pow(pow(s1 / s0, 2), 1.0 / 3) * pow(n, 1.0 / 3)), n - 1) AS INTEGER) AS lags
        FROM (SELECT *, a0 / n + coalesce(list_sum(ac[1:cov]), 0) / (n / 2.0) AS s0,
                     coalesce(list_sum(list_transform(range(1, cov + 1), lambda i: i * ac[i])), 0) / (n / 2.0) AS s1
              FROM sums)))""",
                    ev=f"SELECT {key} AS series_id, t, event_id, value FROM ({EVENT_SERIES_SQL})", s=PLACED,
                    wide="SELECT *, CAST(floor(pow(n, 2.0 / 9)) AS INTEGER) AS cov FROM s WHERE n >= 10",
                    pairs=f"""SELECT a.series_id, a.pos - b.pos AS lag, sum(a.r * b.r) AS ac FROM wide AS a JOIN s AS b
                              ON a.series_id = b.series_id AND b.pos < a.pos AND b.pos >= a.pos - {most} GROUP BY ALL""",
                    sums="""SELECT w.series_id, w.n, w.cov, w.a0, w.c2, p.ac FROM
                            (SELECT series_id, n, cov, sum(r * r) AS a0, sum(c * c) AS c2 FROM
                             (SELECT *, sum(r) OVER (PARTITION BY series_id ORDER BY pos) AS c FROM wide) GROUP BY ALL) AS w
                            JOIN (SELECT series_id, list(ac ORDER BY lag) AS ac FROM pairs GROUP BY series_id) AS p USING (series_id)""")


def _kpss(spark, sf, events, block_rows):
    out = SR.series_tests(events, "series_id", ORDER, "value", block_rows=block_rows).filter("n >= 10")
    return out.select("series", "n", F.round("kpss_stat", 6).alias("kpss_stat"), "kpss_lags", F.round("kpss_p", 6).alias("kpss_p"))


@register("series_kpss", _kpss_sql("series_id", "a.n"))
def q_series_kpss(spark, sf):
    """KPSS per series (TST8)."""
    return _kpss(spark, sf, event_series(spark, sf), SR.BLOCK_ROWS)


@register("series_kpss_one_column", _kpss_sql("1", "ceil(1.1447 * pow(a.cov, 2.0 / 3) * pow(a.n, 1.0 / 3))"))
def q_series_kpss_one(spark, sf):
    """KPSS of the whole column as one series, as many tasks as it needs."""
    return _kpss(spark, sf, event_series(spark, sf).withColumn("series_id", F.lit(1)), 4096)


@register("series_dickey_fuller", with_cte("""
SELECT series_id AS series, n, m AS adf_nobs, round(b / sqrt(ssr / (m - 2) / sxx), 6) AS adf_stat
FROM (SELECT *, syy - b * b * sxx AS ssr FROM (
  SELECT series_id, n, count(*) AS m, regr_slope(dx, xl) AS b, regr_sxx(dx, xl) AS sxx, regr_syy(dx, xl) AS syy
  FROM (SELECT *, lag(r) OVER (PARTITION BY series_id ORDER BY pos) AS xl FROM s WHERE n >= 10) WHERE xl IS NOT NULL GROUP BY series_id, n))
WHERE ssr > 0""", ev=EVENT_SERIES_SQL, s=PLACED))
def q_series_dickey_fuller(spark, sf):
    """ADF without lagged differences, which has a closed form (TST7)."""
    out = SR.series_tests(event_series(spark, sf), "series_id", ORDER, "value", max_lag=0).filter("adf_stat IS NOT NULL")
    return out.select("series", "n", "adf_nobs", F.round("adf_stat", 6).alias("adf_stat"))


@register("series_arch_one_lag", with_cte("""
SELECT series_id AS series, n, round((n - 1) * r2, 5) AS arch_lm, round(r2 / ((1 - r2) / (n - 3)), 5) AS arch_f
FROM (SELECT series_id, n, pow(corr(a, al), 2) AS r2
      FROM (SELECT series_id, n, r * r AS a, lag(r * r) OVER (PARTITION BY series_id ORDER BY pos) AS al FROM s WHERE n >= 10)
      WHERE al IS NOT NULL GROUP BY series_id, n)""", ev=EVENT_SERIES_SQL, s=PLACED))
def q_series_arch(spark, sf):
    """ARCH with one lag, which has a closed form (TST9)."""
    out = SR.series_tests(event_series(spark, sf), "series_id", ORDER, "value", arch_lags=1).filter("arch_lm IS NOT NULL")
    return out.select("series", "n", F.round("arch_lm", 5).alias("arch_lm"), F.round("arch_f", 5).alias("arch_f"))


_POINTS_SQL = with_cte("""
SELECT series_id, CAST(floor(pos / 10) AS BIGINT) AS block, min(pos) AS first_pos, round(avg(value), 6) AS value,
       count(*) AS n
FROM (SELECT series_id, value, row_number() OVER (PARTITION BY series_id ORDER BY t, event_id) - 1 AS pos FROM ev)
GROUP BY series_id, floor(pos / 10)""", ev=EVENT_SERIES_SQL)


def _points(spark, sf, chunk_width):
    out = SR.series_points(event_series(spark, sf), "series_id", ORDER, "value", bucket=10, chunk_width=chunk_width)
    return out.select("series_id", F.col("block").cast("bigint").alias("block"),
                      F.col("first_pos").cast("bigint").alias("first_pos"), F.round("value", 6).alias("value"), "n")


@register("series_points", _POINTS_SQL)
def q_series_points(spark, sf):
    return _points(spark, sf, "auto")


@register("series_points_chunked", _POINTS_SQL)
def q_series_points_chunked(spark, sf):
    """Points numbered in chunks of rows: the plan of a series too long for a task (PLT10)."""
    return _points(spark, sf, Rows(1000))


@register("series_acf_chunked", _acf_sql())
def q_series_acf_chunked(spark, sf):
    out = SR.autocorrelation(event_series(spark, sf), "series_id", ORDER, "value", NLAGS, block_rows=SMALL_BLOCKS)
    return out.select("series_id", "lag", F.round("acf", 6).alias("acf"))


@register("series_tests_chunked")
def q_series_tests_chunked(spark, sf):
    return SR.series_tests(event_series(spark, sf), "series_id", ORDER, "value", block_rows=SMALL_BLOCKS)
