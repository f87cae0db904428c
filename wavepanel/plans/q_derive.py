"""Derived-column queries (PRJ8-PRJ27) on the orders panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators import derive as D
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, RAW_ORDERS_PANEL_SQL, orders_panel, raw_orders_panel, \
    with_cte

P = {"panel": ORDERS_PANEL_SQL}
ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"]       # '1-URGENT' deliberately unlisted
CODE_LABELS = {1: "first", 2: "second", 3: "third", 4: "fourth", 8: "first"}


@register("stage_coding", with_cte("""
SELECT entity_id, visit,
  CASE stage_code WHEN 1 THEN 'first' WHEN 2 THEN 'second' WHEN 3 THEN 'third' WHEN 4 THEN 'fourth'
                  WHEN 8 THEN 'first' END AS label,
  CASE WHEN stage_code IN (1, 8) THEN 'A' ELSE 'B' END AS kind,
  CAST(CASE stage WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 END
       AS BIGINT) AS stage_ord,
  CASE WHEN stage IN ('5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH') THEN stage END AS stage_ordered
FROM panel WHERE stage_code IN (1, 2, 3, 4, 8)""", **P))
def q_stage_coding(spark, sf):
    """PRJ8 filter on codes, PRJ9 labels, PRJ10 two-way flag, PRJ11 ordered categorical."""
    p = D.keep_codes(orders_panel(spark, sf), "stage_code", [1, 2, 3, 4, 8])
    return p.select("entity_id", "visit", D.map_values("stage_code", CODE_LABELS).alias("label"),
                    D.two_way("stage_code", [1, 8], "A", "B").alias("kind"),
                    D.order_key("stage", ORDER).alias("stage_ord"), D.ordered("stage", ORDER).alias("stage_ordered"))


@register("transforms", with_cte("""
SELECT p.entity_id, p.visit,
  round(CASE WHEN e1 > -1 THEN ln(1 + e1) END, 6) AS e1_log,
  round(CASE WHEN x2 >= 0 THEN sqrt(x2) END, 6) AS x2_sqrt,
  round(CASE WHEN mx.m + 1 - x1 > -1 THEN ln(1 + (mx.m + 1 - x1)) END, 6) AS x1_reflog,
  (m1 + m2) / 2 AS m_avg,
  round(CASE WHEN (CASE WHEN e1 IS NULL THEN 0 ELSE 1 END + CASE WHEN e2 IS NULL THEN 0 ELSE 1 END
                   + CASE WHEN e3 IS NULL THEN 0 ELSE 2 END) > 0
        THEN (coalesce(e1, 0) + coalesce(e2, 0) + 2 * coalesce(e3, 0))
             / (CASE WHEN e1 IS NULL THEN 0 ELSE 1 END + CASE WHEN e2 IS NULL THEN 0 ELSE 1 END
                + CASE WHEN e3 IS NULL THEN 0 ELSE 2 END) END, 6) AS e_mean
FROM panel p, (SELECT max(x1) AS m FROM panel) mx""", **P))
def q_transforms(spark, sf):
    """PRJ12 log1p, PRJ13 guarded sqrt, PRJ14 reflect-log, PRJ15 pair mean, PRJ16 weighted row mean."""
    p = orders_panel(spark, sf)
    p = D.reflect_log(p, "x1", "x1_reflog")
    return p.select("entity_id", "visit", F.round(D.log1p("e1"), 6).alias("e1_log"),
                    F.round(D.sqrt("x2"), 6).alias("x2_sqrt"), F.round("x1_reflog", 6).alias("x1_reflog"),
                    D.pair_mean("m1", "m2").alias("m_avg"),
                    F.round(D.row_mean(["e1", "e2", "e3"], [1, 1, 2]), 6).alias("e_mean"))


@register("zscores", with_cte("""
SELECT entity_id, visit, round((e1 - avg(e1) OVER ()) / stddev_samp(e1) OVER (), 6) + 0.0 AS e1_z,
       round((x1 - avg(x1) OVER ()) / stddev_samp(x1) OVER (), 6) + 0.0 AS x1_z
FROM panel""", **P))
def q_zscores(spark, sf):
    """PRJ17 whole-column z-scores (ddof 1)."""
    z = D.zscore(orders_panel(spark, sf).select("entity_id", "visit", "e1", "x1"), ["e1", "x1"])
    return z.select("entity_id", "visit", F.round("e1_z", 6).alias("e1_z"), F.round("x1_z", 6).alias("x1_z"))


@register("one_hot", with_cte("""
SELECT entity_id, visit,
  CAST(stage = '2-HIGH' AS INTEGER) AS "stage_2-HIGH", CAST(stage = '3-MEDIUM' AS INTEGER) AS "stage_3-MEDIUM",
  CAST(stage = '4-NOT SPECIFIED' AS INTEGER) AS "stage_4-NOT SPECIFIED", CAST(stage = '5-LOW' AS INTEGER) AS "stage_5-LOW"
FROM panel""", **P))
def q_one_hot(spark, sf):
    """PRJ18 treatment coding, first level as reference."""
    p = orders_panel(spark, sf).select("entity_id", "visit", "stage")
    return D.one_hot(p, "stage").drop("stage")


@register("missing_flags", with_cte("""
SELECT entity_id, visit, CAST(m1 IS NULL AS INTEGER) AS missing_m1, CAST(m2 IS NULL AS INTEGER) AS missing_m2,
       CAST(e1 IS NULL AS INTEGER) AS missing_e1 FROM panel""", **P))
def q_missing_flags(spark, sf):
    """PRJ19."""
    p = orders_panel(spark, sf).select("entity_id", "visit", "m1", "m2", "e1")
    return D.missing_flags(p, ["m1", "m2", "e1"]).drop("m1", "m2", "e1")


@register("listwise", with_cte("""
SELECT entity_id, visit, m1, m2, e1 FROM panel WHERE m1 IS NOT NULL AND m2 IS NOT NULL AND e1 IS NOT NULL""", **P))
def q_listwise(spark, sf):
    """PRJ21."""
    return D.listwise(orders_panel(spark, sf).select("entity_id", "visit", "m1", "m2", "e1"), ["m1", "m2", "e1"])


@register("trimmed_text", with_cte("""
SELECT order_key, CASE WHEN trim(r1) <> '' THEN trim(r1) END AS r1 FROM raw""", raw=RAW_ORDERS_PANEL_SQL))
def q_trimmed(spark, sf):
    """PRJ22: trim and drop blanks before profiling."""
    return raw_orders_panel(spark, sf).select("order_key", D.trimmed_nonblank("r1").alias("r1"))


@register("finite_values", with_cte("""
SELECT entity_id, visit, CASE WHEN stage_code IN (3, 4) THEN NULL ELSE x1 END AS x1 FROM panel""", **P))
def q_finite(spark, sf):
    """PRJ23: NaN and infinities become null."""
    p = orders_panel(spark, sf)
    raw = (F.when(F.col("stage_code") == 3, F.lit(float("nan")))
            .when(F.col("stage_code") == 4, F.lit(float("inf"))).otherwise(F.col("x1")))
    return p.select("entity_id", "visit", D.finite(raw).alias("x1"))


@register("pruned", with_cte("""
SELECT CAST(entity_id AS VARCHAR) AS entity_id, visit, stage, m1 FROM panel ORDER BY entity_id, visit""", **P))
def q_pruned(spark, sf):
    """PRJ24: keep relevant columns, id as text, sorted (SRT1)."""
    p = orders_panel(spark, sf)
    return p.select(F.col("entity_id").cast("string").alias("entity_id"), "visit", "stage", "m1") \
            .orderBy("entity_id", "visit")


@register("stage_weights", with_cte("""
SELECT p.entity_id, p.visit, p.stage, round(t.n / c.n_level, 6) AS weight
FROM panel p JOIN (SELECT stage, count(*) AS n_level FROM panel GROUP BY stage) c ON p.stage = c.stage,
     (SELECT count(*) AS n FROM panel) t""", **P))
def q_stage_weights(spark, sf):
    """PRJ25: inverse-frequency weights n / n_stage."""
    w = D.inverse_frequency(orders_panel(spark, sf).select("entity_id", "visit", "stage"), "stage")
    return w.select("entity_id", "visit", "stage", F.round("weight", 6).alias("weight"))


@register("labels_and_stars", with_cte("""
SELECT entity_id, visit,
  CASE WHEN x1 / 1000 < 0.001 THEN '***' WHEN x1 / 1000 < 0.01 THEN '**' WHEN x1 / 1000 < 0.05 THEN '*'
       ELSE '' END AS stars,
  CASE WHEN x1 < 10 THEN 'low' WHEN x1 < 20 THEN 'mid' WHEN x1 < 40 THEN 'high' ELSE 'top' END AS band
FROM panel""", **P))
def q_labels(spark, sf):
    """PRJ26 significance stars, PRJ27 threshold labels."""
    p = orders_panel(spark, sf)
    return p.select("entity_id", "visit", D.stars(F.col("x1") / 1000).alias("stars"),
                    D.threshold_label("x1", [10, 20, 40], ["low", "mid", "high", "top"]).alias("band"))
