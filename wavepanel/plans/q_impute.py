"""Imputation queries (IMP1, IMP2, AGG22, PRJ20) on the orders panel.

The oracle is the direct definition: a self join of missing cells with the
observed cells of the same entity and variable, ranked by distance.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators.impute import imputation_counts, k_sweep, knn_impute
from wavepanel.plans.registry import register
from wavepanel.session import cut_lineage
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, with_cte

VARS = ["m1", "m2", "e1"]
ORDER = ["visit", "order_key"]


def _cells_sql(variables):
    return "\nUNION ALL ".join(
        f"SELECT entity_id, visit, order_key, n_rows, '{v}' AS variable, {v} AS value FROM base" for v in variables)


def _chosen_sql(ks: list[int]) -> dict[str, str]:
    kvals = ", ".join(f"({k})" for k in ks)
    return dict(
        base="SELECT *, count(*) OVER (PARTITION BY entity_id) AS n_rows FROM panel",
        cells=_cells_sql(VARS),
        st="SELECT *, count(value) OVER (PARTITION BY entity_id, variable) AS n_obs FROM cells",
        cand="""SELECT m.entity_id, m.variable, m.visit, m.order_key, m.n_obs, o.value AS x,
                  CAST(abs(m.visit - o.visit) AS DOUBLE) AS d,
                  row_number() OVER (PARTITION BY m.entity_id, m.variable, m.order_key
                                     ORDER BY abs(m.visit - o.visit), o.visit, o.order_key) AS rk
                FROM st m JOIN st o ON m.entity_id = o.entity_id AND m.variable = o.variable
                WHERE m.value IS NULL AND o.value IS NOT NULL AND m.n_rows >= 2""",
        ks=f"SELECT * FROM (VALUES {kvals}) t(k)",
        sel="SELECT c.*, ks.k FROM cand c, ks WHERE c.rk <= least(ks.k, c.n_obs)",
        pp="""SELECT entity_id, variable, order_key, k, product(d) AS P, count_if(d = 0) AS n0,
                     sum(CASE WHEN d = 0 THEN x END) AS s0
              FROM sel GROUP BY entity_id, variable, order_key, k""",
        val="""SELECT s.entity_id, s.variable, s.order_key, s.k, min(s.visit) AS visit,
                 round_even(CASE WHEN p.n0 > 0 THEN p.s0 / p.n0
                      ELSE sum(CASE WHEN s.d > 0 THEN s.x * (p.P / s.d) ELSE 0 END)
                         / sum(CASE WHEN s.d > 0 THEN p.P / s.d ELSE 0 END) END, 0) AS v
               FROM sel s JOIN pp p ON s.entity_id = p.entity_id AND s.variable = p.variable
                 AND s.order_key = p.order_key AND s.k = p.k
               GROUP BY s.entity_id, s.variable, s.order_key, s.k, p.n0, p.s0, p.P""")


def _impute_sql(k: int) -> str:
    ctes = {"panel": ORDERS_PANEL_SQL, **_chosen_sql([k])}
    ctes["obs"] = ("SELECT entity_id, visit, order_key, n_rows, " +
                   ", ".join(f"{v}, count({v}) OVER (PARTITION BY entity_id) AS nobs_{v}" for v in VARS) +
                   " FROM base")
    sel, joins = [], []
    for i, v in enumerate(VARS):
        touched = f"(b.n_rows >= 2 AND b.nobs_{v} >= 1 AND b.nobs_{v} < b.n_rows)"
        imp = f"CASE WHEN {touched} THEN coalesce(round_even(b.{v}, 0), j{i}.v) ELSE b.{v} END"
        sel.append(f"{imp} AS {v}_imputed, coalesce(b.{v}, {imp}) AS {v}_filled")
        joins.append(f"LEFT JOIN val j{i} ON j{i}.entity_id = b.entity_id AND j{i}.order_key = b.order_key "
                     f"AND j{i}.variable = '{v}'")
    body = (f"SELECT b.entity_id, b.visit, b.order_key, {', '.join('b.' + v for v in VARS)}, "
            f"{', '.join(sel)} FROM obs b {' '.join(joins)}")
    return with_cte(body, **ctes)


@register("knn_impute", _impute_sql(4))
def q_knn_impute(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    return knn_impute(p, "entity_id", ORDER, VARS, k=4)


KS = [2, 3, 4, 5]


@register("knn_k_sweep", with_cte("""
SELECT variable, CAST(k AS INTEGER) AS k, count(*) AS n_imputed, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median
FROM val GROUP BY variable, k""", panel=ORDERS_PANEL_SQL, **_chosen_sql(KS)))
def q_knn_k_sweep(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    out = k_sweep(p, "entity_id", ORDER, VARS, tuple(KS))
    return out.select("variable", "k", "n_imputed", *[F.round(c, 6).alias(c) for c in ["mean", "std", "median"]])


@register("imputation_counts", with_cte("""
SELECT variable, CAST(count_if(value IS NULL) AS BIGINT) AS n_missing,
       CAST(count_if(value IS NULL AND filled IS NOT NULL) AS BIGINT) AS n_imputed,
       CAST(count_if(filled IS NULL) AS BIGINT) AS n_remaining
FROM (""" + "\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value, {v}_filled AS filled FROM imp"
                               for v in VARS) + ") GROUP BY variable",
    imp="(" + _impute_sql(4) + ")"))
def q_imputation_counts(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    return imputation_counts(knn_impute(p, "entity_id", ORDER, VARS, k=4), VARS)


@register("knn_impute_chunked", _impute_sql(4))
def q_knn_impute_chunked(spark, sf):
    """kNN imputation with candidate windows per (entity, 3-visit chunk) and
    boundary halos: the hot-entity plan, same oracle as ``knn_impute``."""
    p = orders_panel(spark, sf, chunk_days=60).select("entity_id", "visit", "order_key", *VARS)
    return knn_impute(p, "entity_id", ORDER, VARS, k=4, chunk_width=3)


@register("knn_k_sweep_chunked", with_cte("""
SELECT variable, CAST(k AS INTEGER) AS k, count(*) AS n_imputed, round(avg(v), 6) AS mean,
       round(stddev_samp(v), 6) AS std, round(median(v), 6) AS median
FROM val GROUP BY variable, k""", panel=ORDERS_PANEL_SQL, **_chosen_sql(KS)))
def q_knn_k_sweep_chunked(spark, sf):
    p = orders_panel(spark, sf, chunk_days=60).select("entity_id", "visit", "order_key", *VARS)
    out = k_sweep(p, "entity_id", ORDER, VARS, tuple(KS), chunk_width=2)
    return out.select("variable", "k", "n_imputed", *[F.round(c, 6).alias(c) for c in ["mean", "std", "median"]])


SHIFT_PROBS = [0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95]


def _shift_sql():
    stats = [("count", "CAST(count(value) AS DOUBLE)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"),
             ("min", "min(value)")]
    stats += [(f"p{int(round(p * 100)):02d}", f"quantile_cont(value, {p})") for p in SHIFT_PROBS]
    stats.append(("max", "max(value)"))
    parts = []
    for name, expr in stats:
        parts.append(f"SELECT o.variable, '{name}' AS statistic, o.v AS original, i.v AS imputed FROM "
                     f"(SELECT variable, {expr} AS v FROM observed GROUP BY variable) o JOIN "
                     f"(SELECT variable, {expr} AS v FROM imputed GROUP BY variable) i ON o.variable = i.variable")
    body = ("SELECT variable, statistic, round(original, 6) AS original, round(imputed, 6) AS imputed, "
            "CASE WHEN original <> 0 THEN round_even((imputed - original) / original * 100, 2) + 0.0 END AS pct_change "
            "FROM (" + "\nUNION ALL ".join(parts) + ")")
    return with_cte(body, imp="(" + _impute_sql(4) + ")",
                    observed="\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value FROM imp WHERE {v} IS NOT NULL"
                                                 for v in VARS),
                    imputed="\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v}_filled AS value FROM imp "
                                                f"WHERE {v} IS NULL AND {v}_filled IS NOT NULL" for v in VARS))


@register("distribution_shift", _shift_sql())
def q_distribution_shift(spark, sf):
    """AGG17/AGG18: observed vs imputed distribution at 5..95% with percent change."""
    from wavepanel.operators.describe import quantile_shift
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    imp = cut_lineage(knn_impute(p, "entity_id", ORDER, VARS, k=4))        # read several times
    observed = imp.select(*VARS)
    imputed = imp.select(*[F.when(F.col(v).isNull(), F.col(f"{v}_filled")).alias(v) for v in VARS])
    out = quantile_shift(observed, imputed, VARS, SHIFT_PROBS)
    return out.select("variable", "statistic", F.round("original", 6).alias("original"),
                      F.round("imputed", 6).alias("imputed"), "pct_change")
