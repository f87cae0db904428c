"""Descriptive aggregates (AGG3-AGG21).

Every profile over many variables is one unpivot + one grouped aggregate (a
single scan), never a job per variable. All aggregates are partial
(map-side combined), so a hot group costs no more than its share of the
scan. Rounding follows the reference (half-to-even, ``bround``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.catalog import BALANCE_RATIO
from wavepanel.operators.clean import number
from wavepanel.operators.derive import trimmed_nonblank
from wavepanel.operators.sizing import bounded
from wavepanel.session import write_shared


#: Ranges that each narrowing pass cuts a group's remaining values into, and passes.
QUANTILE_RANGES, NARROWINGS = 4096, 2


def _same(left: list[str], right: list[str]) -> list:
    return [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)]


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs, name: str = "q", weight: str | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation per group, one definition at
    every size: (by, array of the quantiles); nulls and NaN are missing. Values are
    counted first (partial aggregate). Each narrowing pass cuts the values of a
    group into ranges between their smallest and largest, adds up the ranges and
    keeps those that hold one of the asked places; what is left is cut again. Only
    the last ranges are sorted. No window works over more than the ranges of a group
    or the values of one of the last ranges. ``weight``: column of how often a row counts."""
    counts = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))) \
        .groupBy(*by, F.col(value).alias("__v")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__c"))
    # the passes read the counts again: written once, so that nothing before them is worked out anew
    counts = write_shared(counts, "counts")
    places = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("__n") - 1)).alias("at"))
                       for i, p in enumerate(probs)])

    def here(place):
        return (place >= F.col("__end") - F.col("__c")) & (place < F.col("__end"))

    held = F.filter(places, lambda s: here(F.floor(s["at"])) | here(F.ceil(s["at"])))
    finite = F.when(F.abs(F.col("__v").cast("double")) < float("inf"), F.col("__v").cast("double"))
    # the ranges so far: a group as a whole, its rows before it and in all
    keys = list(by)
    ranges = counts.groupBy(*by).agg(F.min(finite).alias("__lo"), F.max(finite).alias("__hi"), F.sum("__c").alias("__n"),
                                     F.lit(0).cast("long").alias("__before"))
    rows = counts
    for level in range(NARROWINGS):
        v, lo, hi = F.col("__v").cast("double"), F.col("__lo"), F.col("__hi")
        cut = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * QUANTILE_RANGES), F.lit(QUANTILE_RANGES - 1))
        part = F.when(v == float("inf"), QUANTILE_RANGES).when(v == float("-inf"), -1).when(lo == hi, 0).otherwise(cut).cast("int")
        named = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__lo", "__hi", "__n", "__before")
        inside = rows.join(named, _same(keys, [f"__k{i}" for i in range(len(keys))]), "inner") if keys else rows.crossJoin(bounded(named))
        inside = inside.select(*keys, "__v", "__c", "__n", "__before", part.alias(f"__part{level}"))
        keys.append(f"__part{level}")
        group = Window.partitionBy(*keys[:-1])
        sums = inside.groupBy(*keys).agg(F.sum("__c").alias("__c"), F.min(finite).alias("__lo"), F.max(finite).alias("__hi"),
                                         F.first("__n").alias("__n"), F.first("__before").alias("__before"))
        ends = sums.withColumn("__end", F.col("__before") + F.sum("__c").over(group.orderBy(keys[-1])))
        ranges = ends.filter(F.size(held) > 0).select(*keys, "__lo", "__hi", "__n", (F.col("__end") - F.col("__c")).alias("__before"))
        rows = inside.select(*keys, "__v", "__c")
    named = ranges.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__n", "__before")
    left = rows.join(named, _same(keys, [f"__k{i}" for i in range(len(keys))]), "inner")
    placed = left.select(*by, "__v", "__c", "__n", (F.col("__before") + F.sum("__c").over(Window.partitionBy(*keys).orderBy("__v"))).alias("__end"))
    hits = placed.select(*by, "__v", "__c", "__end", F.explode(held).alias("s"))
    at, lo, hi = F.col("s.at"), F.floor("s.at"), F.ceil("s.at")
    ends = hits.groupBy(*by, F.col("s.i").alias("__i")).agg(
        F.max(F.when(here(lo), F.col("__v"))).alias("__a"), F.max(F.when(here(hi), F.col("__v"))).alias("__b"),
        F.max(at).alias("__at"))
    lo, hi = F.floor("__at"), F.ceil("__at")
    q = F.when(lo == hi, F.col("__a")).otherwise((hi - F.col("__at")) * F.col("__a") + (F.col("__at") - lo) * F.col("__b"))
    # one entry for each of probs
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__i", q.alias("q")))), lambda s: s["q"])
    return ends.groupBy(*by).agg(listed.alias(name))


def add_quantiles(stats: DataFrame, df: DataFrame, by: list[str], value: str, probs, name: str = "__q",
                  weight: str | None = None) -> DataFrame:
    """``stats`` (one row per group of ``df``) with the array of its exact quantiles; null for a group without values."""
    q = exact_quantiles(df, by, value, probs, name, weight)
    q = q.select(*[F.col(b).alias(f"__k{i}") for i, b in enumerate(by)], name)
    same = [F.col(b).eqNullSafe(F.col(f"__k{i}")) for i, b in enumerate(by)]
    return stats.join(q, same, "left").drop(*[f"__k{i}" for i in range(len(by))])


def long_values(df: DataFrame, cols: list[str], ids: list[str] | None = None,
                name: str = "variable", value: str = "value", cast: str | None = "double") -> DataFrame:
    """Wide -> long (RSH1) keeping ``ids``; values cast to one type. Text that
    is to be a number and is none, and NaN, become null (PRJ4)."""
    ids = ids or []
    vals = [(number(df, c) if cast == "double" else F.col(c).cast(cast)).alias(c) if cast else F.col(c) for c in cols]
    return df.select(*ids, *vals).unpivot(ids, cols, name, value)


def value_counts(df: DataFrame, col: str, pct_digits: int = 1) -> DataFrame:
    """Counts per value including nulls, and percent of all rows (AGG3)."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = bounded(df.agg(F.count(F.lit(1)).alias("__total")))
    return counts.crossJoin(total).select(
        "value", "n", F.bround(F.col("n") / F.col("__total") * 100, pct_digits).alias("pct"))


def mean_sd(df: DataFrame, col: str) -> DataFrame:
    """Mean and sample SD (AGG4)."""
    return df.agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.count(col).alias("n"))


def visit_completion(df: DataFrame, entity: str, visit: str) -> DataFrame:
    """How many entities completed each number of distinct visits (AGG5)."""
    per = df.groupBy(entity).agg(F.countDistinct(visit).alias("n_visits"))
    return per.groupBy("n_visits").agg(F.count(F.lit(1)).alias("n_entities"))


def retention(df: DataFrame, entity: str, visit: str, visits: list[int], extra: str | None = None,
              digits: int = 2) -> DataFrame:
    """Per visit of a fixed list: distinct entities seen, percent of all
    entities (0.1), and mean of ``extra`` (``digits``) (AGG6). Visits with no
    rows still appear (N = 0)."""
    spark = df.sparkSession
    grid = bounded(spark.createDataFrame([(int(v),) for v in visits], f"{visit} bigint"))
    aggs = [F.countDistinct(entity).alias("n")]
    if extra:
        aggs.append(F.avg(extra).alias("__extra"))
    per = df.filter(F.col(visit).isin(list(visits))).groupBy(F.col(visit).cast("bigint").alias(visit)).agg(*aggs)
    total = bounded(df.agg(F.countDistinct(entity).alias("__total")))
    out = grid.join(per, visit, "left").crossJoin(total)
    cols = [F.col(visit), F.coalesce(F.col("n"), F.lit(0)).alias("n"),
            F.bround(F.coalesce(F.col("n"), F.lit(0)) / F.col("__total") * 100, 1).alias("retention_pct")]
    if extra:
        cols.append(F.bround(F.col("__extra"), digits).alias(f"{extra}_mean"))
    return out.select(*cols)


def null_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null count per column and total rows, long form (AGG7)."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return wide.unpivot(["__rows"], cols, "variable", "n_null").withColumnRenamed("__rows", "n_rows")


def null_rate_by(df: DataFrame, by: str, cols: list[str]) -> DataFrame:
    """Percent missing per group: mean of 0/1 indicators rounded to 3 then x100 (AGG8)."""
    return df.groupBy(by).agg(*[
        (F.bround(F.avg(F.col(c).isNull().cast("double")), 3) * 100).alias(c) for c in cols])


def group_sizes(df: DataFrame, cols: list[str], balance: float = BALANCE_RATIO) -> DataFrame:
    """Per grouping variable: number of levels, smallest and largest level
    size, their ratio and a balanced flag (AGG9). Null is not a level."""
    cells = long_values(df, cols, cast="string").filter(F.col("value").isNotNull())
    sizes = cells.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    out = sizes.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_levels"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))
    ratio = F.col("max_size") / F.col("min_size")
    return out.select("*", F.round(ratio, 6).alias("ratio"), (ratio < balance).alias("balanced"))


def group_stats(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """count, mean, std, median, min, max per group x measure (AGG10)."""
    long = long_values(df, measures, ids=by, name="measure")
    v = F.col("value")
    out = long.groupBy(*by, "measure").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = add_quantiles(out, long, [*by, "measure"], "value", [0.5])
    return out.select(*by, "measure", "n", "mean", "std", F.col("__q")[0].alias("median"), "min", "max")


def mean_se(long: DataFrame, by: list[str], value: str = "value", z: float = 1.96) -> DataFrame:
    """Mean, SE and counts per group on long data (AGG11, PLT4). As in the
    reference the SE divides by all rows of the group, nulls included;
    ``n_valid`` counts non-null values."""
    v = F.col(value)
    se = F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)))
    return long.groupBy(*by).agg(
        F.avg(v).alias("mean"), se.alias("se"), F.count(v).alias("n_valid"),
        F.count(F.lit(1)).alias("n_rows"), (se * z).alias("ci_half"))


def mean_median_count(df: DataFrame, by: str, col: str, digits: int = 3) -> DataFrame:
    """Rounded mean, median and count per group (AGG12); NaN and text that is no number are missing."""
    df = df.withColumn(col, number(df, col))
    out = df.groupBy(by).agg(F.bround(F.avg(col), digits).alias("mean"), F.count(col).alias("n"))
    return add_quantiles(out, df, [by], col, [0.5]).select(by, "mean", F.bround(F.col("__q")[0], digits).alias("median"), "n")


def mean_of_means(df: DataFrame, stage: str, groups: dict[str, list[str]]) -> DataFrame:
    """Group x stage matrix: mean over a group's measures of the per-stage
    measure means, and the mean per-measure sample size floored (AGG15)."""
    measures = [m for ms in groups.values() for m in ms]
    gmap = F.create_map(*[x for g, ms in groups.items() for m in ms for x in (F.lit(m), F.lit(g))])
    long = long_values(df, measures, ids=[stage], name="measure").withColumn("grp", gmap[F.col("measure")])
    per = long.groupBy(stage, "grp", "measure").agg(F.avg("value").alias("m"), F.count("value").alias("n"))
    return per.groupBy(stage, "grp").agg(F.avg("m").alias("intensity"),
                                         F.floor(F.avg("n")).alias("sample_size"))


def describe(df: DataFrame, cols: list[str], probs=(0.25, 0.5, 0.75), by: list[str] | None = None) -> DataFrame:
    """count/mean/std/min/quantiles/max per variable (AGG17, AGG18, PLT3).
    Quantiles are exact with linear interpolation (pandas' default)."""
    by = by or []
    long = long_values(df, cols, ids=by)
    v = F.col("value")
    out = long.groupBy(*by, "variable").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    out = add_quantiles(out, long, [*by, "variable"], "value", list(probs))
    qcols = [F.col("__q")[i].alias(f"p{int(round(p * 100)):02d}") for i, p in enumerate(probs)]
    return out.select(*by, "variable", "n", "mean", "std", "min", *qcols, "max")


def quantile_shift(before: DataFrame, after: DataFrame, cols: list[str], probs, digits: int = 2) -> DataFrame:
    """Distribution statistics of two versions of the same columns side by
    side, with percent change rounded to ``digits``; change from 0 is null
    (AGG18)."""
    stats = ["count", "mean", "std", "min", *[f"p{int(round(p * 100)):02d}" for p in probs], "max"]

    def longform(df, tag):
        d = describe(df, cols, probs).withColumn("count", F.col("n").cast("double"))
        return d.unpivot(["variable"], stats, "statistic", tag)

    a, b = longform(before, "original"), longform(after, "imputed")
    j = a.join(b, ["variable", "statistic"])
    pct = F.try_divide(F.col("imputed") - F.col("original"), F.col("original")) * 100
    return j.select("variable", "statistic", "original", "imputed",
                    F.when(F.col("original") != 0, F.bround(pct, digits)).alias("pct_change"))


def mode_value(df: DataFrame, col: str, by: list[str] | None = None) -> DataFrame:
    """Most frequent value, smallest on ties (AGG19). ``min_by`` over the
    key (-count, value) keeps it one partial aggregate (plain ``mode`` has
    arbitrary ties)."""
    by = by or []
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("n"))
    key = F.struct((-F.col("n")).alias("k"), F.col(col).alias("v"))
    return counts.groupBy(*by).agg(F.min_by(col, key).alias("mode"), F.max("n").alias("n"))


def categorical_profile(df: DataFrame, cols: list[str], top: int = 3) -> DataFrame:
    """Per categorical variable: count and proportion of each level, and the
    level's rank; ranks <= ``top`` are the top levels (AGG20, PLT8). Levels are
    trimmed, and blanks are no level (PRJ22)."""
    cells = long_values(df, cols, cast="string").withColumn("value", trimmed_nonblank("value")).filter(F.col("value").isNotNull())
    counts = cells.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("__t"))
    w = Window.partitionBy("variable").orderBy(F.col("n").desc(), F.col("value").asc())
    return (counts.join(totals, "variable")
                  .select("variable", "value", "n", F.round(F.col("n") / F.col("__t"), 6).alias("proportion"),
                          F.row_number().over(w).cast("bigint").alias("rank")))


def contingency(df: DataFrame, row: str, col: str, levels: list) -> DataFrame:
    """row x col count table with fixed column levels, zeros filled (AGG21)."""
    return (df.groupBy(row).pivot(col, levels).agg(F.count(F.lit(1)))
              .fillna(0, subset=[str(v) for v in levels]))
