"""Visit-to-visit change events and decline rates (WIN1, WIN2, AGG13, AGG14).

Changes are taken between *adjacent rows* of an entity in visit order (gaps
in the visit numbers are ignored, as are rows where either side is null), and
every change of an entity is labelled with the entity's stage at its last
visit. All lags, the last stage and the row order come from one window spec
partitioned by entity, so the whole operator costs one shuffle by entity plus
the (map-side combined) rate aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.operators.segments import Rows, chunked_lag, resolve_width

UP = 1      # worsening = positive change
DOWN = -1   # decline = negative change


def visit_changes(df: DataFrame, entity: str, order: list[str], stage: str,
                  measures: dict[str, tuple[str, int]], chunk_width: float | str | Rows | None = "auto") -> DataFrame:
    """Long change-event table.

    ``measures`` maps measure column -> (category, direction); direction
    ``DOWN`` flags a change < 0, ``UP`` a change > 0.
    Returns (entity, <order...>, last_stage, measure, category, change, flagged).

    With ``chunk_width`` (``Rows`` or a number in units of ``order[0]``) the lags run per
    (entity, order-range chunk) with the chunk boundaries repaired from
    per-chunk last rows, and the last stage is a ``max_by`` aggregate joined
    back, so no task holds a whole entity (identical results).
    """
    names = list(measures)
    chunk_width = resolve_width(df, entity, chunk_width)
    if chunk_width:
        lagged = chunked_lag(df.select(entity, *order, *names), entity, order, names, chunk_width)
        last = df.groupBy(entity).agg(F.max_by(stage, F.struct(*[F.col(o) for o in order])).alias("last_stage"))
        last = last.withColumnRenamed(entity, "__entity")
        wide = lagged.join(last, F.col(entity).eqNullSafe(F.col("__entity"))).select(
            entity, *order, "last_stage", *[(F.col(m) - F.col(f"__lag_{m}")).alias(m) for m in names])
    else:
        w = Window.partitionBy(entity).orderBy(*order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        wide = df.select(
            entity, *order,
            F.last(stage).over(whole).alias("last_stage"),
            *[(F.col(m) - F.lag(m).over(w)).alias(m) for m in names])
    long = wide.unpivot([entity, *order, "last_stage"], names, "measure", "change")
    cat = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(measures[m][0]))])
    sign = F.create_map(*[x for m in names for x in (F.lit(m), F.lit(measures[m][1]))])
    return (long.filter(F.col("change").isNotNull())
                .withColumn("category", cat[F.col("measure")])
                .withColumn("flagged", F.when(F.col("change") * sign[F.col("measure")] > 0, 1).otherwise(0)))


def decline_rates(changes: DataFrame, stage: str = "last_stage") -> DataFrame:
    """Share of flagged changes by (stage, measure, category) and by
    (stage, category) in one GROUPING SETS aggregate (AGG13).

    ``measure`` is null on the category-level rows. ``flagged_pct`` is the
    rate in percent, rounded half-to-even to 0.1.
    """
    g = changes.groupingSets(
        [[stage, "measure", "category"], [stage, "category"]], stage, "measure", "category")
    rate = F.avg(F.col("flagged").cast("double"))
    return (g.agg(F.count(F.lit(1)).alias("n_changes"),
                  F.sum("flagged").cast("bigint").alias("n_flagged"),
                  F.round(rate, 6).alias("flagged_rate"),
                  F.bround(rate * 100, 1).alias("flagged_pct"))
             .withColumnRenamed(stage, "stage"))


def entities_per_stage(df: DataFrame, entity: str, stage: str) -> DataFrame:
    """Distinct entities per row-level stage (AGG14): the denominator printed
    next to the rates (note: rates group by *last* stage)."""
    return df.groupBy(F.col(stage).alias("stage")).agg(F.countDistinct(entity).alias("n_entities"))


def last_stage(df: DataFrame, entity: str, order: str, stage: str) -> DataFrame:
    """Stage at the maximum order value per entity (WIN2 as an aggregate;
    ``max_by`` is partial-aggregable, so hot entities are combined map-side)."""
    return df.groupBy(entity).agg(F.max_by(stage, order).alias("last_stage"))
