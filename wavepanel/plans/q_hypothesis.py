"""Hypothesis-test queries (TST1-TST6, TST10) on the orders panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.functions.formulas import ANDERSON_P
from wavepanel.operators import hypothesis as H
from wavepanel.operators.describe import long_values
from wavepanel.operators.impute import knn_impute
from wavepanel.plans.elimination_sql import little_sql
from wavepanel.plans.normality_sql import anderson_sql, dagostino_sql, shapiro_sql
from wavepanel.plans.q_impute import ORDER, VARS, _impute_sql
from wavepanel.plans.registry import register
from wavepanel.session import cut_lineage
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, with_cte

PROFILE_COLS = ["m1", "e1", "x1", "age"]


def _profile_sql():
    cells = "\nUNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM panel WHERE {c} IS NOT NULL"
                                for c in PROFILE_COLS)
    moments = f"""SELECT l.variable, CAST(count(*) AS DOUBLE) AS n, avg(l.value) AS mean, median(l.value) AS median,
        stddev_samp(l.value) AS std,
        avg(power(l.value - s.mu, 3)) / power(avg(power(l.value - s.mu, 2)), 1.5) AS g1,
        avg(power(l.value - s.mu, 4)) / power(avg(power(l.value - s.mu, 2)), 2) - 3 AS g2
      FROM ({cells}) l JOIN (SELECT variable, avg(value) AS mu FROM ({cells}) GROUP BY variable) s
        ON l.variable = s.variable GROUP BY l.variable"""
    body = f"SELECT *, exp(-k2 / 2) AS k2_p FROM ({dagostino_sql(moments)})"
    return with_cte(f"""
SELECT variable, CAST(n AS BIGINT) AS n, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std,
       round(g1, 6) + 0.0 AS skewness, round(g2, 6) + 0.0 AS kurtosis,
       CASE WHEN n >= 8 AND k2 > 0 THEN round(k2 / power(10, floor(log10(k2)) - 3), 0)
            * power(10, floor(log10(k2)) - 3) END AS k2,
       round(CASE WHEN n >= 8 THEN k2_p END, 6) AS k2_p
FROM ({body})""", panel=ORDERS_PANEL_SQL)


@register("numeric_profile", _profile_sql())
def q_numeric_profile(spark, sf):
    out = H.numeric_profile(orders_panel(spark, sf), PROFILE_COLS)
    # K^2's kurtosis part cancels catastrophically for large n, so engines agree
    # on it only to ~5 significant digits: compare it at 4 significant digits.
    k2 = F.col("k2")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(k2)) - 3)
    return out.select("variable", "n", *[F.round(c, 6).alias(c) for c in
                                         ["mean", "median", "std", "skewness", "kurtosis"]],
                      F.when(k2 > 0, F.round(k2 / scale, 0) * scale).alias("k2"),
                      F.round("k2_p", 6).alias("k2_p"))


CHI_COLS = ["m1", "m2", "e1"]


def _chi_sql():
    parts = []
    for c in CHI_COLS:
        parts.append(f"SELECT '{c}' AS variable, stage, CAST({c} IS NULL AS INTEGER) AS missing FROM panel")
    cells = "\nUNION ALL ".join(parts)
    return with_cte("""
SELECT variable, round(chi2, 6) AS chi2, dof, n, round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) AS p FROM (
  SELECT o.variable, sum(power(o.o - r.rt * c.ct / t.t, 2) / (r.rt * c.ct / t.t)) AS chi2,
         CAST((t.r - 1) * (t.c - 1) AS BIGINT) AS dof, CAST(t.t AS BIGINT) AS n
  FROM obs o JOIN rt r ON o.variable = r.variable AND o.stage = r.stage
             JOIN ct c ON o.variable = c.variable AND o.missing = c.missing
             JOIN tot t ON o.variable = t.variable
  GROUP BY o.variable, t.r, t.c, t.t)""",
        panel=ORDERS_PANEL_SQL, cells=cells,
        obs="SELECT variable, stage, missing, count(*) AS o FROM cells GROUP BY variable, stage, missing",
        rt="SELECT variable, stage, sum(o) AS rt FROM obs GROUP BY variable, stage",
        ct="SELECT variable, missing, sum(o) AS ct FROM obs GROUP BY variable, missing",
        tot="""SELECT variable, sum(o) AS t, count(DISTINCT stage) AS r, count(DISTINCT missing) AS c
               FROM obs GROUP BY variable""")


@register("chi2_missing_by_stage", _chi_sql())
def q_chi2(spark, sf):
    out = H.chi2_independence(orders_panel(spark, sf), "stage", CHI_COLS)
    return out.select("variable", F.round("chi2", 6).alias("chi2"), "dof", "n", F.round("p", 6).alias("p"))


@register("iqr_outliers", with_cte("""
SELECT f.variable, f.q1, f.q3, f.lower, f.upper, coalesce(c.n_candidates, 0) AS n_candidates,
       coalesce(c.n_outliers, 0) AS n_outliers
FROM fences f LEFT JOIN (
  SELECT i.variable, count(*) AS n_candidates,
         CAST(count_if(i.value < f.lower OR i.value > f.upper) AS BIGINT) AS n_outliers
  FROM imputed i JOIN fences f ON i.variable = f.variable GROUP BY i.variable) c ON f.variable = c.variable""",
    imp="(" + _impute_sql(4) + ")",
    observed="\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value FROM imp WHERE {v} IS NOT NULL" for v in VARS),
    imputed="\nUNION ALL ".join(f"SELECT '{v}' AS variable, {v}_filled AS value FROM imp "
                                f"WHERE {v} IS NULL AND {v}_filled IS NOT NULL" for v in VARS),
    q="SELECT variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM observed GROUP BY variable",
    fences="SELECT variable, q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM q"))
def q_iqr_outliers(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    imp = cut_lineage(knn_impute(p, "entity_id", ORDER, VARS, k=4))        # read several times
    cand = imp.select(*[F.when(F.col(v).isNull(), F.col(f"{v}_filled")).alias(v) for v in VARS])
    return H.iqr_outliers(imp.select(*VARS), cand, VARS)


NORMALITY_COLS = ["m1", "e1", "x1"]


_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM panel WHERE {c} IS NOT NULL"
                            for c in NORMALITY_COLS)


@register("shapiro_wilk", with_cte(shapiro_sql(_CELLS), panel=ORDERS_PANEL_SQL))
def q_shapiro(spark, sf):
    out = H.shapiro_wilk(long_values(orders_panel(spark, sf), NORMALITY_COLS))
    return out.select("variable", "n", F.round("w", 6).alias("w"), F.round("sw_p", 6).alias("sw_p"))


@register("anderson_darling", with_cte(f"""
SELECT variable, n, a2, round({dict(ANDERSON_P)["ad_p"]}, 6) AS ad_p
FROM (SELECT *, {dict(ANDERSON_P)["a2_adj"]} AS a2_adj FROM ({anderson_sql(_CELLS)}) AS a) AS a""", panel=ORDERS_PANEL_SQL))
def q_anderson(spark, sf):
    out = H.anderson_darling(long_values(orders_panel(spark, sf), NORMALITY_COLS))
    return out.select("variable", "n", F.round("a2", 6).alias("a2"), F.round("ad_p", 6).alias("ad_p"))


#: Means over customers of one remainder: sums of many values, nearer to normal than the scales themselves.
COHORTS = 97
_BY_COHORT = f"""SELECT stage AS variable, avg(age) AS value FROM panel WHERE age IS NOT NULL AND stage IS NOT NULL
  GROUP BY stage, entity_id % {COHORTS}"""


@register("normality_of_means", with_cte(f"""
SELECT w.variable, w.n, w.w, w.sw_p, a.a2
FROM ({shapiro_sql(_BY_COHORT)}) AS w JOIN ({anderson_sql(_BY_COHORT)}) AS a ON w.variable = a.variable""", panel=ORDERS_PANEL_SQL))
def q_normality_of_means(spark, sf):
    """TST3 and TST4 of cohort means by stage, whose p are no mere zeros."""
    panel = orders_panel(spark, sf).filter("age IS NOT NULL AND stage IS NOT NULL")
    means = panel.groupBy(F.col("stage").alias("variable"), F.col("entity_id") % COHORTS).agg(F.avg("age").alias("value"))
    shapiro, anderson = H.shapiro_wilk(means), H.anderson_darling(means)
    return shapiro.join(anderson.select("variable", "a2"), "variable").select(
        "variable", "n", F.round("w", 6).alias("w"), F.round("sw_p", 6).alias("sw_p"), F.round("a2", 6).alias("a2"))


@register("missing_association", f"SELECT variable, dof, n, CASE WHEN p < 0.05 THEN 'associated' ELSE 'not associated' END AS verdict FROM ({_chi_sql()})")
def q_missing_association(spark, sf):
    """PRJ27: is missingness associated with the stage."""
    tests = H.chi2_independence(orders_panel(spark, sf), "stage", CHI_COLS)
    return H.association_verdict(tests).select("variable", "dof", "n", "verdict")


@register("little_mcar_pair", with_cte("""
SELECT round(sum(d), 6) AS d2, CAST(2 AS BIGINT) AS dof, round(exp(-sum(d) / 2), 6) AS p, CAST(count(*) AS BIGINT) AS n_patterns,
       CASE WHEN exp(-sum(d) / 2) > 0.05 THEN 'MCAR' ELSE 'not MCAR' END AS verdict
FROM (SELECT CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN n * (va * pow(b - mb, 2) + vb * pow(a - ma, 2) - 2 * c * (a - ma) * (b - mb)) / (va * vb - c * c)
                  WHEN a IS NOT NULL THEN n * pow(a - ma, 2) / va WHEN b IS NOT NULL THEN n * pow(b - mb, 2) / vb ELSE 0 END AS d
      FROM (SELECT count(*) AS n, avg(m1) AS a, avg(m2) AS b FROM panel GROUP BY m1 IS NULL, m2 IS NULL),
           (SELECT avg(m1) AS ma, avg(m2) AS mb, var_samp(m1) AS va, var_samp(m2) AS vb, covar_samp(m1, m2) AS c FROM panel))""",
                                        panel=ORDERS_PANEL_SQL))
def q_little_mcar_pair(spark, sf):
    """TST6 on two variables, which has a closed form."""
    out = H.little_mcar(orders_panel(spark, sf), ["m1", "m2"])
    return out.select(F.round("d2", 6).alias("d2"), "dof", F.round("p", 6).alias("p"), "n_patterns", "verdict")


MCAR_COLS = ["m1", "m2", "e1", "e2", "e3"]


@register("little_mcar", with_cte(little_sql(MCAR_COLS, "panel"), panel=ORDERS_PANEL_SQL))
def q_little_mcar(spark, sf):
    out = H.little_mcar(orders_panel(spark, sf), MCAR_COLS)
    return out.select(F.round("d2", 6).alias("d2"), "dof", F.round("p", 6).alias("p"), "n_patterns", "verdict")
