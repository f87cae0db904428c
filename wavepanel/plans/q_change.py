"""Change-event queries (WIN1, WIN2, AGG13, AGG14) and the flagship slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators.change import DOWN, UP, decline_rates, entities_per_stage, last_stage, visit_changes
from wavepanel.operators.derive import pair_mean
from wavepanel.operators.segments import Rows, auto_rows
from wavepanel.operators.select import keep_entities
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, table, with_cte

CHANGE_MEASURES = {"m_avg": ("down", DOWN), "e1": ("up", UP), "e2": ("up", UP), "e3": ("up", UP)}


def decline_slice(spark, sf_dir):
    """Flagship: panel -> keep entities with >=2 values in both measures ->
    adjacent-visit changes -> last stage -> decline rates (grouping sets).

    Skew-aware: one small aggregate checks the largest customer; only if it
    exceeds the per-task row budget are the visit numbering and the lags
    switched to their chunked forms (``decline_rates_chunked`` forces them)."""
    # one check on the source: the panel never has more rows per entity than orders
    chunks = auto_rows(table(spark, sf_dir, "orders").select("o_custkey"), "o_custkey")
    p = orders_panel(spark, sf_dir, chunk_days=chunks)
    hot = chunks is not None
    kept = keep_entities(p, "entity_id", ["m1", "m2"], min_obs=2, method="join" if hot else "window")
    kept = kept.withColumn("m_avg", pair_mean("m1", "m2"))
    changes = visit_changes(kept, "entity_id", ["visit"], "stage", CHANGE_MEASURES, chunk_width=chunks)
    return decline_rates(changes)


_KEPT = """SELECT * FROM panel WHERE entity_id IN (
  SELECT entity_id FROM panel GROUP BY entity_id HAVING count(m1) >= 2 AND count(m2) >= 2)"""

_LAGGED = """SELECT entity_id, visit,
  last_value(stage) OVER (PARTITION BY entity_id ORDER BY visit
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_stage,
  (m1 + m2) / 2 - lag((m1 + m2) / 2) OVER (PARTITION BY entity_id ORDER BY visit) AS m_avg,
  e1 - lag(e1) OVER (PARTITION BY entity_id ORDER BY visit) AS e1,
  e2 - lag(e2) OVER (PARTITION BY entity_id ORDER BY visit) AS e2,
  e3 - lag(e3) OVER (PARTITION BY entity_id ORDER BY visit) AS e3
FROM kept"""

_CHANGES = """
SELECT entity_id, visit, last_stage, 'm_avg' AS measure, 'down' AS category, m_avg AS change,
       CASE WHEN m_avg < 0 THEN 1 ELSE 0 END AS flagged FROM lagged WHERE m_avg IS NOT NULL
UNION ALL SELECT entity_id, visit, last_stage, 'e1', 'up', e1, CASE WHEN e1 > 0 THEN 1 ELSE 0 END FROM lagged WHERE e1 IS NOT NULL
UNION ALL SELECT entity_id, visit, last_stage, 'e2', 'up', e2, CASE WHEN e2 > 0 THEN 1 ELSE 0 END FROM lagged WHERE e2 IS NOT NULL
UNION ALL SELECT entity_id, visit, last_stage, 'e3', 'up', e3, CASE WHEN e3 > 0 THEN 1 ELSE 0 END FROM lagged WHERE e3 IS NOT NULL
"""

DECLINE_SQL = with_cte("""
SELECT last_stage AS stage, measure, category, count(*) AS n_changes,
       CAST(sum(flagged) AS BIGINT) AS n_flagged,
       round(avg(flagged), 6) AS flagged_rate,
       round_even(avg(flagged) * 100, 1) AS flagged_pct
FROM changes GROUP BY GROUPING SETS ((last_stage, measure, category), (last_stage, category))
""", panel=ORDERS_PANEL_SQL, kept=_KEPT, lagged=_LAGGED, changes=_CHANGES)

register("decline_rates", DECLINE_SQL)(decline_slice)


@register("visit_changes", with_cte("""
SELECT entity_id, visit, last_stage, measure, category, change, CAST(flagged AS BIGINT) AS flagged FROM changes
""", panel=ORDERS_PANEL_SQL, kept=_KEPT, lagged=_LAGGED, changes=_CHANGES))
def q_visit_changes(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    kept = keep_entities(p, "entity_id", ["m1", "m2"], min_obs=2, method="window")
    kept = kept.withColumn("m_avg", pair_mean("m1", "m2"))
    ch = visit_changes(kept, "entity_id", ["visit"], "stage", CHANGE_MEASURES)
    return ch.select("entity_id", "visit", "last_stage", "measure", "category", "change",
                     F.col("flagged").cast("bigint").alias("flagged"))


@register("last_stage", with_cte("""
SELECT entity_id, arg_max(stage, visit) AS last_stage FROM panel GROUP BY entity_id
""", panel=ORDERS_PANEL_SQL))
def q_last_stage(spark, sf_dir):
    return last_stage(orders_panel(spark, sf_dir), "entity_id", "visit", "stage")


@register("entities_per_stage", with_cte("""
SELECT stage, count(DISTINCT entity_id) AS n_entities FROM panel GROUP BY stage
""", panel=ORDERS_PANEL_SQL))
def q_entities_per_stage(spark, sf_dir):
    return entities_per_stage(orders_panel(spark, sf_dir), "entity_id", "stage")


@register("decline_rates_chunked", DECLINE_SQL)
def q_decline_chunked(spark, sf_dir):
    """The flagship with every per-entity window split into order-range chunks
    (60-day chunks for visit numbering, 3-visit chunks for the lags): the plan
    a hot entity needs. Same oracle as ``decline_rates``."""
    p = orders_panel(spark, sf_dir, chunk_days=60)
    kept = keep_entities(p, "entity_id", ["m1", "m2"], min_obs=2, method="join")
    kept = kept.withColumn("m_avg", pair_mean("m1", "m2"))
    changes = visit_changes(kept, "entity_id", ["visit"], "stage", CHANGE_MEASURES, chunk_width=3)
    return decline_rates(changes)


@register("changes_at_one_place", with_cte("""
SELECT last_stage, measure, count(*) AS n, round(sum(change), 6) AS total, CAST(sum(CASE WHEN change * sign > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged
FROM (SELECT stage AS last_stage, 'm1' AS measure, -1 AS sign, m1 - lag(m1) OVER w AS change FROM panel WINDOW w AS (PARTITION BY stage ORDER BY stage_code, order_key)
      UNION ALL
      SELECT stage, 'e1', 1, e1 - lag(e1) OVER w FROM panel WINDOW w AS (PARTITION BY stage ORDER BY stage_code, order_key))
WHERE change IS NOT NULL GROUP BY last_stage, measure""", panel=ORDERS_PANEL_SQL))
def q_changes_at_one_place(spark, sf_dir):
    """Adjacent-row changes of five hot keys (the stages) all of whose rows share one place of the
    leading order column, in chunks of rows (WIN1)."""
    p = orders_panel(spark, sf_dir)
    out = visit_changes(p, "stage", ["stage_code", "order_key"], "stage", {"m1": ("m", DOWN), "e1": ("e", UP)}, chunk_width=Rows(1000))
    return out.groupBy("last_stage", "measure").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("change"), 6).alias("total"),
                                                    F.sum("flagged").alias("n_flagged"))
