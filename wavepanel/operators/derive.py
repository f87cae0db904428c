"""Derived columns (PRJ8-PRJ27): labels, transforms, composites, scores.

All are column expressions; the few that need a whole-column statistic
(z-score, reflect-log, stage weights) compute it as an aggregate and join it
back: one-row aggregates are broadcast (bounded by construction), per-group
tables are left to AQE's measured-size join choice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.catalog import SIGNIFICANCE_LEVELS
from wavepanel.operators.sizing import bounded, level_table


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- stage coding (PRJ8-PRJ11) ---------------------------------------------

def keep_codes(df: DataFrame, col: str, codes: list) -> DataFrame:
    """Set-membership filter (PRJ8); pushed to the scan when ``col`` is a
    source column."""
    return df.filter(F.col(col).isin(list(codes)))


def map_values(col: str | Column, mapping: dict) -> Column:
    """Literal lookup (PRJ9, RSH5); unmapped values become null."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return m[_c(col)]


def two_way(col: str | Column, codes: list, yes: str, no: str) -> Column:
    """Two-level flag (PRJ10)."""
    return F.when(_c(col).isin(list(codes)), F.lit(yes)).otherwise(F.lit(no))


def order_key(col: str | Column, order: list[str]) -> Column:
    """1-based position in an explicit category order; null when unlisted
    (PRJ11, SRT2)."""
    pos = F.array_position(F.array(*[F.lit(v) for v in order]), _c(col))
    return F.when(pos > 0, pos)


def ordered(col: str | Column, order: list[str]) -> Column:
    """Ordered categorical: the value itself, null when unlisted (PRJ11)."""
    return F.when(order_key(col, order).isNotNull(), _c(col))


# -- transforms (PRJ12-PRJ17) -----------------------------------------------

def log1p(col: str | Column) -> Column:
    """log(1+x); null for x <= -1 (Spark's log1p already returns null there)."""
    return F.when(_c(col) > -1, F.log1p(_c(col)))


def sqrt(col: str | Column) -> Column:
    """sqrt(x) guarded to null for negative input instead of NaN."""
    return F.when(_c(col) >= 0, F.sqrt(_c(col)))


def reflect_log(df: DataFrame, col: str, out: str) -> DataFrame:
    """log1p(max + 1 - x) with max over the whole column (PRJ14)."""
    mx = bounded(df.agg(F.max(col).alias("__max")))
    return df.crossJoin(mx).withColumn(out, log1p(F.col("__max") + 1 - F.col(col))).drop("__max")


def pair_mean(a: str | Column, b: str | Column) -> Column:
    """Null-propagating mean of two columns (PRJ15)."""
    return (_c(a) + _c(b)) / 2


def row_mean(items: list[str], weights: list[float] | None = None) -> Column:
    """Null-skipping (weighted) row mean; null when every item is null
    (PRJ16). Integer weights reproduce an item listed several times."""
    weights = weights or [1.0] * len(items)
    num = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in zip(items, weights)), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in zip(items, weights)),
              F.lit(0.0))
    return F.when(den > 0, num / den)


def zscore(df: DataFrame, cols: list[str], suffix: str = "_z", by: str | None = None,
           zero_sd: str = "null", ddof: int = 1) -> DataFrame:
    """Whole-column (or per-``by``-group) z-scores (PRJ17, RSH4).

    ``zero_sd='null'`` gives null for a constant column, ``'zero'`` gives 0.
    The statistics are one aggregate row (or one per group), joined back.
    """
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    stats = [F.avg(c).alias(f"__mu_{c}") for c in cols] + [sd(c).alias(f"__sd_{c}") for c in cols]
    if by is None:
        agg = bounded(df.agg(*stats))
        out = df.crossJoin(agg)
    else:
        agg = level_table(df.groupBy(by).agg(*stats))
        out = df.join(agg, by, "left")
    for c in cols:
        mu, s = F.col(f"__mu_{c}"), F.col(f"__sd_{c}")
        z = F.when(s > 0, (F.col(c) - mu) / s)
        if zero_sd == "zero":
            z = F.when(F.col(c).isNull(), None).when(s > 0, z).otherwise(F.lit(0.0))
        out = out.withColumn(f"{c}{suffix}", z)
    return out.drop(*[f"__mu_{c}" for c in cols], *[f"__sd_{c}" for c in cols])


def one_hot(df: DataFrame, col: str, levels: list | None = None, reference=None,
            prefix: str | None = None, max_levels: int = 1000) -> DataFrame:
    """Treatment-coded indicators (PRJ18, MOD2). ``reference`` (default: the
    first level in sorted order) gets no column. When levels are not given
    they are read with one distinct aggregate, refused beyond ``max_levels``."""
    if levels is None:
        lv = df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_levels + 1).collect()
        if len(lv) > max_levels:
            raise ValueError(f"{col} has more than {max_levels} levels")
        levels = sorted(r[0] for r in lv)
    if reference is None and levels:
        reference = levels[0]
    prefix = prefix or col
    cols = [F.when(F.col(col).isNull(), None).when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{prefix}_{v}")
            for v in levels if v != reference]
    return df.select("*", *cols)


def missing_flags(df: DataFrame, cols: list[str], prefix: str = "missing_") -> DataFrame:
    """0/1 missing indicators (PRJ19)."""
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{prefix}{c}") for c in cols])


def fill_from(col: str, imputed: str) -> Column:
    """Observed value if present, else the imputed one (PRJ20)."""
    return F.coalesce(F.col(col), F.col(imputed))


def listwise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (PRJ21)."""
    return df.dropna(subset=list(cols))


def trimmed_nonblank(col: str) -> Column:
    """Trimmed text, null when blank (PRJ22)."""
    t = F.trim(F.col(col).cast("string"))
    return F.when(t != "", t)


def finite(col: str | Column) -> Column:
    """NaN and +-Inf to null (PRJ23, ingest normalisation)."""
    c = _c(col)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(math.inf)), c)


def inverse_frequency(df: DataFrame, col: str, out: str = "weight") -> DataFrame:
    """Row weight n / n_level (PRJ25)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__n_level"))
    total = bounded(df.agg(F.count(F.lit(1)).alias("__n_total")))
    w = level_table(counts.crossJoin(total).select(col, (F.col("__n_total") / F.col("__n_level")).alias(out)))
    return df.join(w, col, "left")


def stars(p: str | Column) -> Column:
    """Significance marker (PRJ26)."""
    expr = None
    for cut, mark in SIGNIFICANCE_LEVELS:
        expr = F.when(_c(p) < cut, F.lit(mark)) if expr is None else expr.when(_c(p) < cut, F.lit(mark))
    return expr.otherwise(F.lit(""))


def threshold_label(value: str | Column, cuts: list[float], labels: list[str]) -> Column:
    """Label by ascending cut points: value < cuts[i] -> labels[i], else the
    last label (PRJ27)."""
    expr = None
    for cut, lab in zip(cuts, labels):
        expr = F.when(_c(value) < cut, F.lit(lab)) if expr is None else expr.when(_c(value) < cut, F.lit(lab))
    return expr.otherwise(F.lit(labels[len(cuts)]))
