"""Descriptive queries (AGG1-AGG21, JN1, JN3) on the orders panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators import describe as D
from wavepanel.operators.select import attach_dimension, dimension_of_members, entity_row_counts, \
    keep_entities, observed_counts, unmatched_entities
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ENTITY_DIMENSION_SQL, ORDERS_PANEL_SQL, entity_dimension, \
    orders_panel, with_cte

P = {"panel": ORDERS_PANEL_SQL}


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("observed_counts", with_cte("""
SELECT entity_id, count(m1) AS n_m1, count(m2) AS n_m2 FROM panel GROUP BY entity_id""", **P))
def q_observed_counts(spark, sf):
    return observed_counts(orders_panel(spark, sf), "entity_id", ["m1", "m2"])


@register("keep_entities", with_cte("""
SELECT entity_id, visit, m1, m2 FROM panel WHERE entity_id IN (
  SELECT entity_id FROM panel GROUP BY entity_id HAVING count(m1) >= 2 AND count(m2) >= 2)""", **P))
def q_keep_entities(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit", "m1", "m2")
    return keep_entities(p, "entity_id", ["m1", "m2"], min_obs=2, method="join")


@register("entity_row_counts", with_cte("""
SELECT b.entities_before, b.rows_before, a.entities_after, a.rows_after,
       b.entities_before - a.entities_after AS entities_removed, b.rows_before - a.rows_after AS rows_removed
FROM (SELECT count(DISTINCT entity_id) AS entities_before, count(*) AS rows_before FROM panel) b,
     (SELECT count(DISTINCT entity_id) AS entities_after, count(*) AS rows_after FROM panel
      WHERE entity_id IN (SELECT entity_id FROM panel GROUP BY entity_id
                          HAVING count(m1) >= 5 AND count(m2) >= 5)) a""", **P))
def q_entity_row_counts(spark, sf):
    p = orders_panel(spark, sf)
    return entity_row_counts(p, keep_entities(p, "entity_id", ["m1", "m2"], min_obs=5), "entity_id")


@register("attach_dimension", with_cte("""
SELECT p.entity_id, p.visit, d.segment, d.acctbal FROM panel p LEFT JOIN dim d ON p.entity_id = d.entity_id""",
                                       dim=ENTITY_DIMENSION_SQL, **P))
def q_attach_dimension(spark, sf):
    p = orders_panel(spark, sf).select("entity_id", "visit")
    return attach_dimension(p, entity_dimension(spark, sf), "entity_id", ["segment", "acctbal"])


@register("unmatched_entities", with_cte("""
SELECT count(DISTINCT p.entity_id) AS n_unmatched_entities
FROM panel p LEFT JOIN dim d ON p.entity_id = d.entity_id WHERE d.segment IS NULL""",
                                         dim=ENTITY_DIMENSION_SQL, **P))
def q_unmatched(spark, sf):
    j = attach_dimension(orders_panel(spark, sf).select("entity_id"), entity_dimension(spark, sf),
                         "entity_id", ["segment"])
    return unmatched_entities(j, "entity_id", "segment")


@register("dimension_of_members", with_cte("""
SELECT * FROM dim WHERE entity_id IN (SELECT entity_id FROM panel WHERE stage = '1-URGENT')""",
                                           dim=ENTITY_DIMENSION_SQL, **P))
def q_dim_members(spark, sf):
    p = orders_panel(spark, sf).filter(F.col("stage") == "1-URGENT")
    return dimension_of_members(entity_dimension(spark, sf), p, "entity_id")


@register("value_counts", with_cte("""
SELECT d.segment AS value, count(*) AS n, round_even(count(*) / t.total * 100, 1) AS pct
FROM panel p LEFT JOIN dim d ON p.entity_id = d.entity_id,
     (SELECT count(*) AS total FROM panel) t
GROUP BY d.segment, t.total""", dim=ENTITY_DIMENSION_SQL, **P))
def q_value_counts(spark, sf):
    j = attach_dimension(orders_panel(spark, sf).select("entity_id"), entity_dimension(spark, sf),
                         "entity_id", ["segment"])
    return D.value_counts(j, "segment")


@register("member_mean_sd", with_cte("""
SELECT round(avg(acctbal), 6) AS mean, round(stddev_samp(acctbal), 6) AS sd, count(acctbal) AS n
FROM dim WHERE entity_id IN (SELECT entity_id FROM panel)""", dim=ENTITY_DIMENSION_SQL, **P))
def q_member_mean_sd(spark, sf):
    members = dimension_of_members(entity_dimension(spark, sf), orders_panel(spark, sf), "entity_id")
    return rounded(D.mean_sd(members, "acctbal"), ["mean", "sd"])


@register("visit_completion", with_cte("""
SELECT n_visits, count(*) AS n_entities FROM (
  SELECT entity_id, count(DISTINCT visit) AS n_visits FROM panel GROUP BY entity_id) GROUP BY n_visits""", **P))
def q_visit_completion(spark, sf):
    return D.visit_completion(orders_panel(spark, sf), "entity_id", "visit")


@register("retention", with_cte("""
SELECT g.visit, coalesce(s.n, 0) AS n, round_even(coalesce(s.n, 0) / t.total * 100, 1) AS retention_pct,
       round_even(s.age_mean, 2) AS age_mean
FROM (SELECT CAST(range AS BIGINT) AS visit FROM range(0, 11)) g
LEFT JOIN (SELECT visit, count(DISTINCT entity_id) AS n, avg(age) AS age_mean FROM panel
           WHERE visit BETWEEN 0 AND 10 GROUP BY visit) s ON g.visit = s.visit,
     (SELECT count(DISTINCT entity_id) AS total FROM panel) t""", **P))
def q_retention(spark, sf):
    return D.retention(orders_panel(spark, sf), "entity_id", "visit", list(range(11)), extra="age")


@register("null_summary", with_cte("""
SELECT 'm1' AS variable, CAST(count_if(m1 IS NULL) AS BIGINT) AS n_null, count(*) AS n_rows FROM panel
UNION ALL SELECT 'm2', CAST(count_if(m2 IS NULL) AS BIGINT), count(*) FROM panel
UNION ALL SELECT 'e1', CAST(count_if(e1 IS NULL) AS BIGINT), count(*) FROM panel
UNION ALL SELECT 'stage', CAST(count_if(stage IS NULL) AS BIGINT), count(*) FROM panel""", **P))
def q_null_summary(spark, sf):
    return D.null_summary(orders_panel(spark, sf), ["m1", "m2", "e1", "stage"])


@register("null_rate_by_stage", with_cte("""
SELECT stage, round_even(avg(CASE WHEN m1 IS NULL THEN 1.0 ELSE 0.0 END), 3) * 100 AS m1,
       round_even(avg(CASE WHEN m2 IS NULL THEN 1.0 ELSE 0.0 END), 3) * 100 AS m2,
       round_even(avg(CASE WHEN e1 IS NULL THEN 1.0 ELSE 0.0 END), 3) * 100 AS e1
FROM panel GROUP BY stage""", **P))
def q_null_rate_by_stage(spark, sf):
    return D.null_rate_by(orders_panel(spark, sf), "stage", ["m1", "m2", "e1"])


@register("group_sizes", with_cte("""
SELECT variable, count(*) AS n_levels, min(n) AS min_size, max(n) AS max_size,
       round(max(n) / min(n), 6) AS ratio, max(n) / min(n) < 1.5 AS balanced
FROM (SELECT variable, value, count(*) AS n FROM (
        SELECT 'stage' AS variable, stage AS value FROM panel
        UNION ALL SELECT 'status', status FROM panel
        UNION ALL SELECT 'x2', CAST(x2 AS VARCHAR) FROM panel) WHERE value IS NOT NULL
      GROUP BY variable, value) GROUP BY variable""", **P))
def q_group_sizes(spark, sf):
    return D.group_sizes(orders_panel(spark, sf), ["stage", "status", "x2"])


def _long_sql(cols, ids="stage"):
    return "\nUNION ALL ".join(f"SELECT {ids}, '{c}' AS measure, CAST({c} AS DOUBLE) AS value FROM panel"
                               for c in cols)


@register("group_stats", with_cte("""
SELECT stage, measure, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(median(value), 6) AS median, min(value) AS min, max(value) AS max
FROM long GROUP BY stage, measure""", **P, long=_long_sql(["m1", "m2", "e1"])))
def q_group_stats(spark, sf):
    out = D.group_stats(orders_panel(spark, sf), ["stage"], ["m1", "m2", "e1"])
    return rounded(out, ["mean", "std", "median"])


GAPS = f"""SELECT * REPLACE (CASE WHEN order_key % 7 <> 0 THEN stage END AS stage, CASE WHEN order_key % 5 <> 0 THEN m1 END AS m1)
FROM ({ORDERS_PANEL_SQL})"""


def panel_with_gaps(spark, sf):
    """The panel with rows without a stage, and NaN among the values."""
    return orders_panel(spark, sf).withColumns({
        "stage": F.when(F.col("order_key") % 7 != 0, F.col("stage")),
        "m1": F.when(F.col("order_key") % 5 != 0, F.col("m1")).otherwise(F.lit(float("nan")))})


@register("group_stats_gaps", with_cte("""
SELECT stage, measure, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       round(median(value), 6) AS median, min(value) AS min, max(value) AS max
FROM long GROUP BY stage, measure""", panel=GAPS, long=_long_sql(["m1", "m2", "e1"])))
def q_group_stats_gaps(spark, sf):
    """AGG10 with NaN among the values and rows without a stage."""
    return rounded(D.group_stats(panel_with_gaps(spark, sf), ["stage"], ["m1", "m2", "e1"]), ["mean", "std", "median"])


@register("mean_se", with_cte("""
SELECT stage, measure, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(*)), 6) AS se,
       count(value) AS n_valid, count(*) AS n_rows, round(1.96 * stddev_samp(value) / sqrt(count(*)), 6) AS ci_half
FROM long GROUP BY stage, measure""", **P, long=_long_sql(["m1", "e1", "e2"])))
def q_mean_se(spark, sf):
    long = D.long_values(orders_panel(spark, sf), ["m1", "e1", "e2"], ids=["stage"], name="measure")
    return rounded(D.mean_se(long, ["stage", "measure"]), ["mean", "se", "ci_half"])


@register("mean_median_count", with_cte("""
SELECT stage, round_even(avg(m1), 3) AS mean, round_even(median(m1), 3) AS median, count(m1) AS n
FROM panel GROUP BY stage""", **P))
def q_mean_median_count(spark, sf):
    return D.mean_median_count(orders_panel(spark, sf), "stage", "m1")


MOM_GROUPS = {"g1": ["e1", "e2"], "g2": ["e3", "m1"]}


@register("mean_of_means", with_cte("""
SELECT stage, grp, round(avg(m), 6) AS intensity, CAST(floor(avg(n)) AS BIGINT) AS sample_size FROM (
  SELECT stage, CASE WHEN measure IN ('e1', 'e2') THEN 'g1' ELSE 'g2' END AS grp, measure,
         avg(value) AS m, count(value) AS n
  FROM long GROUP BY stage, measure) GROUP BY stage, grp""", **P, long=_long_sql(["e1", "e2", "e3", "m1"])))
def q_mean_of_means(spark, sf):
    out = D.mean_of_means(orders_panel(spark, sf), "stage", MOM_GROUPS)
    return out.select("stage", "grp", r6("intensity").alias("intensity"),
                      F.col("sample_size").cast("bigint").alias("sample_size"))


def _describe_sql(cols, panel=ORDERS_PANEL_SQL):
    return with_cte("""
SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50,
       round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max
FROM (""" + "\nUNION ALL ".join(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM panel"
                                 for c in cols) + ") GROUP BY variable", panel=panel)


DESCRIBE_COLS = ["m1", "m2", "e1", "x1", "age"]


@register("describe", _describe_sql(DESCRIBE_COLS))
def q_describe(spark, sf):
    out = D.describe(orders_panel(spark, sf), DESCRIBE_COLS)
    return rounded(out, ["mean", "std", "p25", "p50", "p75"])


@register("describe_gaps", _describe_sql(DESCRIBE_COLS, GAPS))
def q_describe_gaps(spark, sf):
    """AGG17 with NaN among the values."""
    return rounded(D.describe(panel_with_gaps(spark, sf), DESCRIBE_COLS), ["mean", "std", "p25", "p50", "p75"])


@register("mode_by_stage", with_cte("""
SELECT stage, arg_min(e1, [-n, e1]) AS mode, max(n) AS n FROM (
  SELECT stage, e1, count(*) AS n FROM panel WHERE e1 IS NOT NULL GROUP BY stage, e1) GROUP BY stage""", **P))
def q_mode_by_stage(spark, sf):
    return D.mode_value(orders_panel(spark, sf), "e1", by=["stage"])


@register("categorical_profile", with_cte("""
SELECT variable, value, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS proportion,
       CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value ASC) AS BIGINT) AS rank
FROM (SELECT variable, value, count(*) AS n FROM (
        SELECT 'stage' AS variable, stage AS value FROM panel
        UNION ALL SELECT 'status', status FROM panel) WHERE value IS NOT NULL GROUP BY variable, value)""", **P))
def q_categorical_profile(spark, sf):
    return D.categorical_profile(orders_panel(spark, sf), ["stage", "status"])


@register("contingency", with_cte("""
SELECT stage, CAST(count_if(m1 IS NOT NULL) AS BIGINT) AS "0", CAST(count_if(m1 IS NULL) AS BIGINT) AS "1"
FROM panel GROUP BY stage""", **P))
def q_contingency(spark, sf):
    p = orders_panel(spark, sf).withColumn("missing_m1", F.col("m1").isNull().cast("int"))
    return D.contingency(p, "stage", "missing_m1", [0, 1])


@register("metric_report", with_cte("""
SELECT 'group_sizes' AS section, variable, metric, value FROM (
  SELECT variable, 'n_levels' AS metric, CAST(n_levels AS DOUBLE) AS value FROM gs
  UNION ALL SELECT variable, 'min_size', CAST(min_size AS DOUBLE) FROM gs
  UNION ALL SELECT variable, 'max_size', CAST(max_size AS DOUBLE) FROM gs
  UNION ALL SELECT variable, 'ratio', ratio FROM gs)""", **P, gs="""
SELECT variable, count(*) AS n_levels, min(n) AS min_size, max(n) AS max_size, round(max(n) / min(n), 6) AS ratio
FROM (SELECT variable, value, count(*) AS n FROM (
        SELECT 'stage' AS variable, stage AS value FROM panel
        UNION ALL SELECT 'status', status FROM panel) WHERE value IS NOT NULL
      GROUP BY variable, value) GROUP BY variable"""))
def q_metric_report(spark, sf):
    """SNK2: results as one long (section, variable, metric, value) table."""
    from wavepanel.sources.io import metric_table
    gs = D.group_sizes(orders_panel(spark, sf), ["stage", "status"])
    return metric_table("group_sizes", gs, "variable", ["n_levels", "min_size", "max_size", "ratio"])


@register("domain_means_by_stage", with_cte("""
SELECT stage, round(avg(d1), 6) AS d1, round(avg(d2), 6) AS d2 FROM (
  SELECT stage,
    CASE WHEN (CASE WHEN e1 IS NULL THEN 0 ELSE 1 END + CASE WHEN e2 IS NULL THEN 0 ELSE 1 END) > 0
         THEN (coalesce(e1, 0) + coalesce(e2, 0))
              / (CASE WHEN e1 IS NULL THEN 0 ELSE 1 END + CASE WHEN e2 IS NULL THEN 0 ELSE 1 END) END AS d1,
    CASE WHEN (CASE WHEN e3 IS NULL THEN 0 ELSE 1 END + CASE WHEN m1 IS NULL THEN 0 ELSE 1 END) > 0
         THEN (coalesce(e3, 0) + coalesce(m1, 0))
              / (CASE WHEN e3 IS NULL THEN 0 ELSE 1 END + CASE WHEN m1 IS NULL THEN 0 ELSE 1 END) END AS d2
  FROM panel) GROUP BY stage""", **P))
def q_domain_means(spark, sf):
    """AGG16 (with PRJ16): null-skipping composite scores, then their means per stage."""
    from wavepanel.operators.derive import row_mean
    p = orders_panel(spark, sf).select("stage", row_mean(["e1", "e2"]).alias("d1"), row_mean(["e3", "m1"]).alias("d2"))
    return p.groupBy("stage").agg(F.round(F.avg("d1"), 6).alias("d1"), F.round(F.avg("d2"), 6).alias("d2"))
