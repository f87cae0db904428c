"""Reshaping, set operations and ordering (RSH1-RSH5, SET1-SET3, SRT1-SRT6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.operators.clean import as_numbers
from wavepanel.operators.derive import order_key
from wavepanel.operators.sizing import bounded
from wavepanel.session import cut_lineage


def melt(df: DataFrame, ids: list[str], values: list[str], name: str = "measure", value: str = "score") -> DataFrame:
    """Wide -> long (RSH1); text that is no number becomes null (PRJ4)."""
    return as_numbers(df, values).select(*ids, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(ids, values, name, value)


def pivot_first(long: DataFrame, row: str, col: str, value: str, levels: list) -> DataFrame:
    """Long -> wide with ``first`` per cell and a fixed column list (RSH2,
    RSH3); fixed levels avoid the extra distinct job and bound the width."""
    return long.groupBy(row).pivot(col, levels).agg(F.first(value))


def reindex(df: DataFrame, col: str, order: list[str], ord_name: str = "ord") -> DataFrame:
    """Rows for exactly the listed categories in that order; a listed
    category with no data becomes a null row (SRT2)."""
    spark = df.sparkSession
    grid = bounded(spark.createDataFrame([(v, i + 1) for i, v in enumerate(order)], f"{col} string, {ord_name} int"))
    return grid.join(df, col, "left")


def tag_union(frames: dict[str, DataFrame], tag: str = "type") -> DataFrame:
    """Union by name of labelled frames (SET2)."""
    out = None
    for label, df in frames.items():
        t = df.withColumn(tag, F.lit(label))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def union_fill(frames: list[DataFrame]) -> DataFrame:
    """Union by column name, columns missing on one side filled with null
    (SET1)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def stage_sorted(df: DataFrame, col: str, order: list[str]) -> DataFrame:
    """Sort by an explicit category order (SRT2)."""
    return df.orderBy(order_key(col, order).asc_nulls_last())


def hash_sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Reproducible sample of n rows: the n smallest hashes of (key, seed)
    (SRT5, SRT6), equal hashes by key. The hash is the MD5 of the key's columns
    and the seed as text, joined by ``|`` (a null adds nothing), so any engine
    can draw the same rows. Planned as a per-partition top-n merged into n
    rows, never a full sort."""
    return df.orderBy(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))), *key).limit(n)


def observation_order(df: DataFrame, keys: list[str], out: str = "obs") -> DataFrame:
    """``df`` with each row's place (from 0) in the order of ``keys`` over all
    rows (WIN8). Rows are dealt by ranges of the whole key, so one entity may
    fill several ranges; each range is numbered by itself and starts where the
    ranges before it end. Rows of equal keys are numbered in any order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: a range may be cut elsewhere when computed again
    dealt = cut_lineage(df.repartitionByRange(n, *keys).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # one row a range
    starts = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__start"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return dealt.join(bounded(starts), "__part").withColumn(out, F.col("__start") + place).drop("__part", "__start")


def residual_by_order(df: DataFrame, keys: list[str], residual: str = "residual", block: int = 500) -> DataFrame:
    """Residual against observation order (WIN8): rows, mean and spread for each ``block`` observations."""
    places = observation_order(df.filter(F.col(residual).isNotNull()), keys, "__obs")
    return places.groupBy(F.floor(F.col("__obs") / block).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(residual).alias("mean_residual"), F.stddev_samp(residual).alias("sd_residual"))
