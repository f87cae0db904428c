"""Entity selection and dimension joins (JN1-JN3, AGG1-AGG2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.operators.sizing import sized_at_run_time


def observed_counts(df: DataFrame, entity: str, measures: list[str]) -> DataFrame:
    """Non-null count per entity per measure (AGG1). Partial aggregation runs
    map-side, so a hot entity never materialises as one group."""
    return df.groupBy(entity).agg(*[F.count(m).alias(f"n_{m}") for m in measures])


def _combine(conds, require):
    cond = conds[0]
    for c in conds[1:]:
        cond = (cond & c) if require == "all" else (cond | c)
    return cond


def keep_entities(df: DataFrame, entity: str, measures: list[str], min_obs: int = 2,
                  require: str = "all", method: str = "join") -> DataFrame:
    """Keep rows of entities with at least ``min_obs`` non-null values in every
    measure (``require='all'``) or in any (``'any'``) (JN2).

    ``method='join'``: counts from a map-side-combined aggregate applied by a
    left-semi join (AQE splits the join when one entity is hot; the key set is
    broadcast by AQE only when it measures small).
    ``method='window'``: ``count() over (partition by entity)``; no second scan
    and no join, the right choice when the plan is partitioned by entity
    anyway (a per-entity window follows).
    """
    if method == "window":
        w = Window.partitionBy(entity)
        cond = _combine([F.count(m).over(w) >= min_obs for m in measures], require)
        return df.withColumn("__keep", cond).filter("__keep").drop("__keep")
    counts = observed_counts(df, entity, measures)
    cond = _combine([F.col(f"n_{m}") >= min_obs for m in measures], require)
    keep = counts.filter(cond).select(entity)
    return df.join(keep, entity, "left_semi")


def attach_dimension(df: DataFrame, dim: DataFrame, key: str, cols: list[str] | None = None,
                     check_unique: bool = True) -> DataFrame:
    """Left join of dimension columns onto the panel (JN1).

    The dimension key must be unique (a duplicate would fan rows out); the
    check is one aggregate. The dimension is broadcast only when its measured
    size is under the broadcast threshold, else Spark shuffles both sides.
    """
    d = dim.select(key, *(cols or [c for c in dim.columns if c != key]))
    if check_unique:
        dup = d.groupBy(key).count().filter("count > 1").limit(1).count()
        if dup:
            raise ValueError(f"dimension key {key!r} is not unique")
    return df.join(sized_at_run_time(d), key, "left")


def unmatched_entities(joined: DataFrame, key: str, probe: str) -> DataFrame:
    """Distinct entities whose dimension value stayed null after JN1."""
    return joined.filter(F.col(probe).isNull()).agg(
        F.countDistinct(key).alias("n_unmatched_entities"))


def dimension_of_members(dim: DataFrame, panel: DataFrame, key: str) -> DataFrame:
    """Dimension rows whose key appears in the panel (JN3)."""
    return dim.join(panel.select(key), key, "left_semi")


def entity_row_counts(before: DataFrame, after: DataFrame, entity: str) -> DataFrame:
    """Entities and rows before and after a filter, and the removed counts (AGG2)."""
    b = before.agg(F.countDistinct(entity).alias("entities_before"), F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.countDistinct(entity).alias("entities_after"), F.count(F.lit(1)).alias("rows_after"))
    return (b.crossJoin(a)
             .withColumn("entities_removed", F.col("entities_before") - F.col("entities_after"))
             .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after")))
