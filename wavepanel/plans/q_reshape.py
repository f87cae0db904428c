"""Reshape, set and ordering queries (RSH1-RSH5, SET1-SET3, SRT1-SRT6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators import reshape as R
from wavepanel.operators.derive import map_values, zscore
from wavepanel.operators.describe import group_stats, mean_of_means
from wavepanel.operators.impute import knn_impute
from wavepanel.plans.q_impute import ORDER, VARS, _impute_sql
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, with_cte

P = {"panel": ORDERS_PANEL_SQL}
STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("melt", with_cte("""
SELECT entity_id, visit, 'e1' AS measure, e1 AS score FROM panel
UNION ALL SELECT entity_id, visit, 'e2', e2 FROM panel""", **P))
def q_melt(spark, sf):
    return R.melt(orders_panel(spark, sf), ["entity_id", "visit"], ["e1", "e2"])


@register("pivot_stage_measure", with_cte("""
SELECT stage, round(avg(e1), 6) AS e1, round(avg(e2), 6) AS e2, round(avg(e3), 6) AS e3,
       count(*) AS sample_size FROM panel GROUP BY stage""", **P))
def q_pivot(spark, sf):
    p = orders_panel(spark, sf)
    stats = group_stats(p, ["stage"], ["e1", "e2", "e3"]).select("stage", "measure", F.round("mean", 6).alias("mean"))
    wide = R.pivot_first(stats, "stage", "measure", "mean", ["e1", "e2", "e3"])
    size = p.groupBy("stage").agg(F.count(F.lit(1)).alias("sample_size"))
    return wide.join(size, "stage")


@register("reindex_stages", with_cte("""
SELECT g.stage, g.ord, s.n FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('4-NOT SPECIFIED', 4),
  ('5-LOW', 5), ('6-NONE', 6)) g(stage, ord)
LEFT JOIN (SELECT stage, count(*) AS n FROM panel GROUP BY stage) s ON g.stage = s.stage""", **P))
def q_reindex(spark, sf):
    counts = orders_panel(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return R.reindex(counts, "stage", STAGES + ["6-NONE"])


@register("tag_union", with_cte("""
SELECT 'Original' AS type, m1 AS value FROM imp WHERE m1 IS NOT NULL
UNION ALL SELECT 'Imputed', m1_filled FROM imp WHERE m1 IS NULL AND m1_filled IS NOT NULL""",
    imp="(" + _impute_sql(4) + ")"))
def q_tag_union(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "order_key", *VARS)
    imp = knn_impute(p, "entity_id", ORDER, VARS, k=4)
    orig = imp.filter(F.col("m1").isNotNull()).select(F.col("m1").alias("value"))
    new = imp.filter(F.col("m1").isNull() & F.col("m1_filled").isNotNull()).select(F.col("m1_filled").alias("value"))
    return R.tag_union({"Original": orig, "Imputed": new}).select("type", "value")


@register("union_fill", with_cte("""
SELECT entity_id, visit, m1, NULL::DOUBLE AS e1 FROM panel WHERE visit % 2 = 0
UNION ALL SELECT entity_id, visit, NULL::DOUBLE, e1 FROM panel WHERE visit % 2 = 1""", **P))
def q_union_fill(spark, sf):
    p = orders_panel(spark, sf)
    even = p.filter(F.col("visit") % 2 == 0).select("entity_id", "visit", "m1")
    odd = p.filter(F.col("visit") % 2 == 1).select("entity_id", "visit", "e1")
    return R.union_fill([even, odd])


@register("distinct_entity_stage", with_cte("SELECT DISTINCT entity_id, stage FROM panel", **P))
def q_distinct(spark, sf):
    return orders_panel(spark, sf).select("entity_id", "stage").distinct()


@register("sorted_panel", with_cte("SELECT entity_id, visit, stage, m1 FROM panel ORDER BY entity_id, visit", **P))
def q_sorted(spark, sf):
    return orders_panel(spark, sf).select("entity_id", "visit", "stage", "m1").orderBy("entity_id", "visit")


@register("hash_sample", with_cte("""
SELECT entity_id, visit, m1 FROM panel
ORDER BY md5(concat_ws('|', CAST(entity_id AS VARCHAR), CAST(visit AS VARCHAR), '42')), entity_id, visit LIMIT 500""", **P))
def q_hash_sample(spark, sf):
    """Reproducible 500-row sample of the panel (the limit is the feature)."""
    return R.hash_sample(orders_panel(spark, sf), 500, ["entity_id", "visit"]).select("entity_id", "visit", "m1")


@register("residual_order", with_cte("""
SELECT CAST(obs // 500 AS BIGINT) AS block, count(*) AS n, round(avg(residual), 6) + 0.0 AS mean_residual,
       round(stddev_samp(residual), 6) AS sd_residual
FROM (SELECT row_number() OVER (ORDER BY entity_id, visit) - 1 AS obs, residual FROM (
        SELECT entity_id, visit, m1 - avg(m1) OVER (PARTITION BY stage) AS residual FROM panel WHERE m1 IS NOT NULL))
GROUP BY obs // 500""", **P))
def q_residual_order(spark, sf):
    """WIN8: residuals of the stage means against observation order."""
    p = orders_panel(spark, sf).filter(F.col("m1").isNotNull()).select("entity_id", "visit", "stage", "m1")
    means = p.groupBy("stage").agg(F.avg("m1").alias("mu"))
    r = p.join(means, "stage").withColumn("residual", F.col("m1") - F.col("mu"))
    out = R.residual_by_order(r, ["entity_id", "visit"])
    return out.select("block", "n", (F.round("mean_residual", 6) + 0.0).alias("mean_residual"),
                      F.round("sd_residual", 6).alias("sd_residual"))


@register("coef_rank", with_cte("""
SELECT var1, var2, r, CAST(row_number() OVER (ORDER BY abs(r) DESC, var1, var2) AS BIGINT) AS rank FROM (
  SELECT 'm1' AS var1, 'e1' AS var2, round(corr(m1, e1), 6) + 0.0 AS r FROM panel
  UNION ALL SELECT 'm1', 'x1', round(corr(m1, x1), 6) + 0.0 FROM panel
  UNION ALL SELECT 'e1', 'x1', round(corr(e1, x1), 6) + 0.0 FROM panel
  UNION ALL SELECT 'm2', 'age', round(corr(m2, age), 6) + 0.0 FROM panel)""", **P))
def q_coef_rank(spark, sf):
    from pyspark.sql import Window
    from wavepanel.operators.correlate import corr_long
    p = orders_panel(spark, sf)
    c = corr_long(p, ["m1", "e1", "x1"]).unionByName(corr_long(p, ["m2", "age"]))
    c = c.select("var1", "var2", F.round("r", 6).alias("r"))
    w = Window.orderBy(F.abs("r").desc(), "var1", "var2")
    return c.withColumn("rank", F.row_number().over(w).cast("bigint"))


MOM = {"g1": ["e1", "e2"], "g2": ["e3", "m1"]}


@register("stage_matrix_z", with_cte("""
SELECT stage, grp, round(intensity, 6) AS intensity,
       round(CASE WHEN sd > 0 THEN (intensity - mu) / sd ELSE 0.0 END, 6) + 0.0 AS intensity_z
FROM (SELECT *, avg(intensity) OVER (PARTITION BY grp) AS mu, stddev_samp(intensity) OVER (PARTITION BY grp) AS sd
      FROM (SELECT stage, grp, avg(m) AS intensity FROM (
              SELECT stage, CASE WHEN measure IN ('e1', 'e2') THEN 'g1' ELSE 'g2' END AS grp, measure, avg(value) AS m
              FROM long GROUP BY stage, measure) GROUP BY stage, grp))""",
    **P, long="\nUNION ALL ".join(f"SELECT stage, '{c}' AS measure, {c} AS value FROM panel"
                                  for c in ["e1", "e2", "e3", "m1"])))
def q_stage_matrix_z(spark, sf):
    m = mean_of_means(orders_panel(spark, sf), "stage", MOM)
    z = zscore(m, ["intensity"], by="grp", zero_sd="zero")
    return z.select("stage", "grp", F.round("intensity", 6).alias("intensity"),
                    F.round("intensity_z", 6).alias("intensity_z"))


LABELS = {1: "urgent", 2: "high", 3: "medium", 4: "unspecified", 5: "low"}


@register("relabel", with_cte("""
SELECT entity_id, visit, CASE stage_code WHEN 1 THEN 'urgent' WHEN 2 THEN 'high' WHEN 3 THEN 'medium'
  WHEN 4 THEN 'unspecified' WHEN 5 THEN 'low' END AS stage_label FROM panel""", **P))
def q_relabel(spark, sf):
    p = orders_panel(spark, sf)
    return p.select("entity_id", "visit", map_values("stage_code", LABELS).alias("stage_label"))
