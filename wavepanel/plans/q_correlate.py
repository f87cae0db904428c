"""Correlation queries (COR1-COR7) on the orders panel with line aggregates."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from wavepanel.catalog import VIF_HIGH
from wavepanel.operators import correlate as C
from wavepanel.operators.impute import knn_impute
from wavepanel.plans.elimination_sql import vif_sql
from wavepanel.plans.q_impute import ORDER, VARS, _impute_sql
from wavepanel.plans.registry import register
from wavepanel.session import cut_lineage
from wavepanel.sources.testdata import NUMERIC_PANEL_SQL, ORDERS_PANEL_SQL, numeric_panel, orders_panel, with_cte

CORR_COLS = ["m1", "m2", "e1", "e2", "x1", "age", "visit", "qty", "price", "disc"]


def _corr_sql(cols, src="np", flags=False):
    parts = []
    for a, b in itertools.combinations(cols, 2):
        xa = f"CAST({a} IS NULL AS DOUBLE)" if flags else a
        xb = f"CAST({b} IS NULL AS DOUBLE)" if flags else b
        n = "count(*)" if flags else f"CAST(count_if({a} IS NOT NULL AND {b} IS NOT NULL) AS BIGINT)"
        parts.append(f"SELECT '{a}' AS var1, '{b}' AS var2, round(corr({xa}, {xb}), 6) + 0.0 AS r, {n} AS n FROM {src}")
    return "\nUNION ALL ".join(parts)


def _r6(df):
    return df.select("var1", "var2", F.round("r", 6).alias("r"), "n")


@register("corr_matrix", with_cte(_corr_sql(CORR_COLS), np=NUMERIC_PANEL_SQL))
def q_corr_matrix(spark, sf):
    return _r6(C.corr_long(numeric_panel(spark, sf), CORR_COLS))


MISS_COLS = ["m1", "m2", "e1", "e2", "e3"]


@register("missing_corr", with_cte(_corr_sql(MISS_COLS, "panel", flags=True), panel=ORDERS_PANEL_SQL))
def q_missing_corr(spark, sf):
    return _r6(C.missing_corr(orders_panel(spark, sf), MISS_COLS))


@register("high_pairs", with_cte("SELECT * FROM c WHERE abs(r) > 0.7", np=NUMERIC_PANEL_SQL,
                                 c=_corr_sql(CORR_COLS)))
def q_high_pairs(spark, sf):
    return _r6(C.high_pairs(C.corr_long(numeric_panel(spark, sf), CORR_COLS)))


@register("corr_edges", with_cte("""
SELECT var1 AS src, var2 AS dst, r, abs(r) AS weight, round(greatest(abs(r) * 12, 3.0), 6) AS width,
       CASE WHEN abs(r) < 0.2 THEN 'weak' WHEN abs(r) < 0.4 THEN 'moderate' WHEN abs(r) < 0.6 THEN 'strong'
            ELSE 'very strong' END AS strength,
       CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign
FROM c WHERE abs(r) > 0.1""", np=NUMERIC_PANEL_SQL, c=_corr_sql(CORR_COLS)))
def q_corr_edges(spark, sf):
    corr = _r6(C.corr_long(numeric_panel(spark, sf), CORR_COLS))
    e = C.corr_edges(corr)
    return e.withColumn("width", F.round("width", 6))


SHIFT_COLS = ["m1", "m2", "visit"]


@register("corr_shift", with_cte("""
SELECT a.var1, a.var2, round_even(a.r, 3) + 0.0 AS original, round_even(b.r, 3) + 0.0 AS imputed,
       round(round_even(b.r, 3) - round_even(a.r, 3), 3) + 0.0 AS change,
       CASE WHEN abs(round(round_even(b.r, 3) - round_even(a.r, 3), 3)) < 0.1 THEN 'preserved'
            WHEN abs(round(round_even(b.r, 3) - round_even(a.r, 3), 3)) < 0.2 THEN 'moderate'
            ELSE 'substantial' END AS verdict
FROM a JOIN b ON a.var1 = b.var1 AND a.var2 = b.var2""",
    imp="(" + _impute_sql(4) + ")",
    a="""SELECT 'm1' AS var1, 'm2' AS var2, corr(m1, m2) AS r FROM imp
         UNION ALL SELECT 'm1', 'visit', corr(m1, visit) FROM imp
         UNION ALL SELECT 'm2', 'visit', corr(m2, visit) FROM imp""",
    b="""SELECT 'm1' AS var1, 'm2' AS var2, corr(m1_imputed, m2_imputed) AS r FROM imp
         UNION ALL SELECT 'm1', 'visit', corr(m1_imputed, visit) FROM imp
         UNION ALL SELECT 'm2', 'visit', corr(m2_imputed, visit) FROM imp"""))
def q_corr_shift(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    imp = cut_lineage(knn_impute(p, "entity_id", ORDER, VARS, k=4))        # read several times
    return C.corr_shift(imp, imp, SHIFT_COLS, ["m1_imputed", "m2_imputed", "visit"])


VIF_COLS = ["m1", "e1", "e2", "x1", "age", "qty", "disc"]


@register("vif", with_cte(f"SELECT variable, round(vif, 6) AS vif, vif > {VIF_HIGH} AS high, n FROM ({vif_sql(VIF_COLS, 'np')})",
                          np=NUMERIC_PANEL_SQL))
def q_vif(spark, sf):
    out = C.vif(numeric_panel(spark, sf), VIF_COLS, intercept=False)
    return out.select("variable", F.round("vif", 6).alias("vif"), "high", "n")


@register("vif_pair", with_cte("""
SELECT v.variable, round(1 / (1 - g.ab * g.ab / (g.aa * g.bb)), 6) AS vif, false AS high, g.n
FROM (SELECT sum(m1 * m1) AS aa, sum(m1 * e1) AS ab, sum(e1 * e1) AS bb, count(*) AS n FROM panel
      WHERE m1 IS NOT NULL AND e1 IS NOT NULL) g, (VALUES ('m1'), ('e1')) v(variable)""", panel=ORDERS_PANEL_SQL))
def q_vif_pair(spark, sf):
    """COR6 on two variables, where it is 1 / (1 - r^2) with the uncentred r."""
    out = C.vif(orders_panel(spark, sf), ["m1", "e1"])
    return out.select("variable", F.round("vif", 6).alias("vif"), "high", "n")


SCALES = {"s1": ["e1", "e2", "e3"], "s2": ["m1", "m2"], "s3": ["e1", "m1", "x1", "x2"]}


def _alpha_sql():
    parts = []
    for name, items in SCALES.items():
        k = len(items)
        rs = " + ".join(f"corr({a}, {b})" for a, b in itertools.combinations(items, 2))
        cond = " AND ".join(f"{c} IS NOT NULL" for c in items)
        parts.append(f"SELECT '{name}' AS scale, {k} AS k, count(*) AS n, "
                     f"round({k}.0 / {k - 1} * (1 - {k} / ({k} + 2 * ({rs}))), 6) AS alpha "
                     f"FROM panel WHERE {cond}")
    return "\nUNION ALL ".join(parts)


@register("cronbach_alpha", with_cte(_alpha_sql(), panel=ORDERS_PANEL_SQL))
def q_cronbach_alpha(spark, sf):
    out = C.cronbach_alpha(orders_panel(spark, sf), SCALES)
    return out.withColumn("alpha", F.round("alpha", 6))
