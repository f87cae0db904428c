"""Plot-data queries (PLT1-PLT9, AGG23) on the orders panel."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from wavepanel.functions import special as S
from wavepanel.operators import plotdata as PD
from wavepanel.operators.correlate import corr_long
from wavepanel.operators.describe import long_values, null_rate_by
from wavepanel.plans.q_describe import GAPS, panel_with_gaps
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, with_cte

P = {"panel": ORDERS_PANEL_SQL}
HIST_COLS = ["m1", "x1", "age"]
BINS = 10


def _cells(cols, ids=""):
    sel = f"{ids}, " if ids else ""
    return "\nUNION ALL ".join(f"SELECT {sel}'{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM panel "
                               f"WHERE {c} IS NOT NULL" for c in cols)


@register("histogram", with_cte(f"""
SELECT variable, bin, round(lo + bin * ((hi - lo) / {BINS}), 6) AS "left",
       round(lo + (bin + 1) * ((hi - lo) / {BINS}), 6) AS "right", count(*) AS n
FROM (SELECT c.variable, c.value, r.lo, r.hi,
             CAST(CASE WHEN (r.hi - r.lo) / {BINS} > 0
                       THEN least(floor((c.value - r.lo) / ((r.hi - r.lo) / {BINS})), {BINS - 1}) ELSE 0 END AS INTEGER) AS bin
      FROM cells c JOIN rng r ON c.variable = r.variable)
GROUP BY variable, bin, lo, hi""", **P, cells=_cells(HIST_COLS),
    rng="SELECT variable, min(value) AS lo, max(value) AS hi FROM cells GROUP BY variable"))
def q_histogram(spark, sf):
    h = PD.histogram(orders_panel(spark, sf), HIST_COLS, bins=BINS)
    return h.select("variable", "bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


@register("kde", with_cte(f"""
SELECT p.variable, round(p.x, 6) AS x, round(sum(b.n * exp(-0.5 * ((p.x - b.c) / p.h) ** 2)) / (p.n * p.h * sqrt(2 * pi())), 6) AS density
FROM (SELECT s.variable, s.n, s.h, s.lo + (s.hi - s.lo) * g.g / 24 AS x FROM spread s, range(25) g(g)) p
JOIN binned b ON p.variable = b.variable GROUP BY p.variable, p.x, p.n, p.h""", **P, cells=_cells(HIST_COLS),
    rng="SELECT variable, min(value) AS lo, max(value) AS hi FROM cells GROUP BY variable",
    binned=f"""SELECT variable, lo + (bin + 0.5) * (hi - lo) / {BINS} AS c, count(*) AS n
        FROM (SELECT c.variable, r.lo, r.hi, least(floor((c.value - r.lo) / ((r.hi - r.lo) / {BINS})), {BINS - 1}) AS bin
              FROM cells c JOIN rng r ON c.variable = r.variable) GROUP BY variable, lo, hi, bin""",
    spread="""SELECT b.variable, r.lo, r.hi, sum(b.n) AS n, power(sum(b.n), -0.2)
        * sqrt((sum(b.n * b.c * b.c) - sum(b.n * b.c) ** 2 / sum(b.n)) / (sum(b.n) - 1)) AS h
        FROM binned b JOIN rng r ON b.variable = r.variable GROUP BY b.variable, r.lo, r.hi"""))
def q_kde(spark, sf):
    h = PD.histogram(orders_panel(spark, sf), HIST_COLS, bins=BINS)
    k = PD.kde_from_histogram(h, grid=25)
    return k.select("variable", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


QQ_POINTS = 19


def _qq_sql():
    probs = [(i - 0.5) / QQ_POINTS for i in range(1, QQ_POINTS + 1)]
    parts = []
    for p in probs:
        parts.append(f"SELECT variable, CAST({p!r} AS DOUBLE) AS p, CAST({S.norm_ppf(p)!r} AS DOUBLE) AS theoretical, "
                     f"quantile_cont(value, {p!r}) AS sample, avg(value) AS mu, stddev_samp(value) AS sd "
                     f"FROM cells GROUP BY variable")
    return with_cte("SELECT variable, p, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample, "
                    "round((sample - mu) / sd, 6) + 0.0 AS standardized FROM (" + "\nUNION ALL ".join(parts) + ")",
                    **P, cells=_cells(HIST_COLS))


@register("qq_points", _qq_sql())
def q_qq(spark, sf):
    q = PD.qq_points(orders_panel(spark, sf), HIST_COLS, points=QQ_POINTS)
    return q.select("variable", "p", *[F.round(c, 6).alias(c) for c in ["theoretical", "sample", "standardized"]])


def _box_sql(panel: str) -> str:
    return with_cte("""
SELECT q.stage, q.variable, q.n, q.q1, q.median, q.q3,
       min(CASE WHEN c.value >= q.q1 - 1.5 * (q.q3 - q.q1) THEN c.value END) AS whisker_lo,
       max(CASE WHEN c.value <= q.q3 + 1.5 * (q.q3 - q.q1) THEN c.value END) AS whisker_hi,
       CAST(count_if(c.value < q.q1 - 1.5 * (q.q3 - q.q1) OR c.value > q.q3 + 1.5 * (q.q3 - q.q1)) AS BIGINT) AS n_outliers
FROM cells c JOIN q ON c.stage IS NOT DISTINCT FROM q.stage AND c.variable = q.variable
GROUP BY q.stage, q.variable, q.n, q.q1, q.median, q.q3""", panel=panel, cells=_cells(["m1", "x1"], ids="stage"),
                    q="""SELECT stage, variable, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
                quantile_cont(value, 0.75) AS q3 FROM cells GROUP BY stage, variable""")


@register("box_stats", _box_sql(ORDERS_PANEL_SQL))
def q_box(spark, sf):
    return PD.box_stats(orders_panel(spark, sf), ["m1", "x1"], by=["stage"])


@register("box_stats_gaps", _box_sql(GAPS))
def q_box_gaps(spark, sf):
    """PLT3 with NaN among the values and rows without a stage, which are a group."""
    return PD.box_stats(panel_with_gaps(spark, sf), ["m1", "x1"], by=["stage"])


@register("binned_2d", with_cte("""
SELECT floor(m1 / 2.0) * 2.0 AS x_left, floor(x1 / 10.0) * 10.0 AS y_left, count(*) AS n
FROM panel WHERE m1 IS NOT NULL AND x1 IS NOT NULL GROUP BY floor(m1 / 2.0), floor(x1 / 10.0)""", **P))
def q_binned(spark, sf):
    return PD.binned_2d(orders_panel(spark, sf), "m1", "x1", 2.0, 10.0)


TRI = ["m1", "m2", "e1", "x1"]


@register("corr_lower_triangle", with_cte("\nUNION ALL ".join(
    f"SELECT '{b}' AS var1, '{a}' AS var2, round(corr({a}, {b}), 6) + 0.0 AS r, "
    f"CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT) AS n FROM panel"
    for a, b in itertools.combinations(TRI, 2)), **P))
def q_lower(spark, sf):
    full = corr_long(orders_panel(spark, sf), TRI, full=True)
    return PD.lower_triangle(full, TRI).select("var1", "var2", F.round("r", 6).alias("r"), "n")


@register("null_rate_long", with_cte("\nUNION ALL ".join(
    f"SELECT stage, '{c}' AS variable, round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 3) * 100 AS pct "
    f"FROM panel GROUP BY stage" for c in ["m1", "m2", "e1"]), **P))
def q_null_rate_long(spark, sf):
    wide = null_rate_by(orders_panel(spark, sf), "stage", ["m1", "m2", "e1"])
    return long_values(wide, ["m1", "m2", "e1"], ids=["stage"], value="pct")


@register("forest_rows")
def q_forest(spark, sf):
    """PLT5 + AGG23 on the random-intercept model's coefficients."""
    from wavepanel.plans.q_mixed import _intercept_fit
    coefs = _intercept_fit(spark, sf).coefficients.filter(F.col("term") != "Intercept")
    return PD.forest_rows(coefs, PD.plot_limits(coefs))


def _fixed_error(spark, sf):
    """A coefficient-like table: correlations, each with an SE of 0.1."""
    c = corr_long(orders_panel(spark, sf), TRI)
    return c.select(F.concat_ws("~", "var1", "var2").alias("term"), F.col("r").alias("coef"), F.lit(0.1).alias("se"),
                    F.when(F.col("var1") == "m1", 0.03).otherwise(0.2).alias("p"))


@register("forest_rows_fixed", with_cte("""
SELECT term, round(r, 6) + 0.0 AS coef, round(r - 0.196, 6) + 0.0 AS ci_lo, round(r + 0.196, 6) + 0.0 AS ci_hi,
       round(greatest(r - 0.196, axis_lo), 6) + 0.0 AS draw_lo, round(least(r + 0.196, axis_hi), 6) + 0.0 AS draw_hi,
       r - 0.196 < axis_lo AS cut_lo, r + 0.196 > axis_hi AS cut_hi, CASE WHEN term LIKE 'm1~%' THEN '*' ELSE '' END AS stars
FROM c, (SELECT lo - (hi - lo) * -0.2 AS axis_lo, hi + (hi - lo) * -0.2 AS axis_hi FROM (
  SELECT least(quantile_cont(e, 0.05), 0.0) AS lo, greatest(quantile_cont(e, 0.95), 0.0) AS hi FROM (
    SELECT r + 1.96 * 0.1 AS e FROM c UNION ALL SELECT r - 1.96 * 0.1 FROM c)))""", **P,
    c="\nUNION ALL ".join(f"SELECT '{a}~{b}' AS term, corr({a}, {b}) AS r FROM panel" for a, b in itertools.combinations(TRI, 2))))
def q_forest_fixed(spark, sf):
    """PLT5 on that table, the axis drawn narrow so that intervals are cut."""
    coefs = _fixed_error(spark, sf)
    out = PD.forest_rows(coefs, PD.plot_limits(coefs, pad=-0.2))
    return out.select("term", *[(F.round(c, 6) + 0.0).alias(c) for c in ["coef", "ci_lo", "ci_hi", "draw_lo", "draw_hi"]],
                      "cut_lo", "cut_hi", "stars")


@register("plot_limits", with_cte("""
SELECT round(lo - (hi - lo) * 0.1, 6) AS axis_lo, round(hi + (hi - lo) * 0.1, 6) AS axis_hi FROM (
  SELECT least(quantile_cont(e, 0.05), 0.0) AS lo, greatest(quantile_cont(e, 0.95), 0.0) AS hi FROM (
    SELECT r + 1.96 * 0.1 AS e FROM c UNION ALL SELECT r - 1.96 * 0.1 FROM c))""",
    **P, c="\nUNION ALL ".join(f"SELECT corr({a}, {b}) AS r FROM panel" for a, b in itertools.combinations(TRI, 2))))
def q_plot_limits(spark, sf):
    """AGG23 on a coefficient-like table: correlations with a fixed SE of 0.1."""
    lim = PD.plot_limits(_fixed_error(spark, sf))
    return lim.select(F.round("axis_lo", 6).alias("axis_lo"), F.round("axis_hi", 6).alias("axis_hi"))
