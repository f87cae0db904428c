"""Cleaning (PRJ1-PRJ7): missing codes, type inference, range clipping,
reverse coding. Each is one projection (or one aggregate for audits) over
all columns at once, never a pass per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.catalog import MISSING_CODES, MISSING_STRINGS
from wavepanel.operators.sizing import bounded

# A plain decimal number, optionally signed, with optional exponent and
# surrounding blanks. Spark's cast also accepts 'NaN', 'Infinity', '1d', ...;
# those are treated as text, like the reference's numeric parser does.
NUMBER_RE = r"^\s*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _is_numeric(dt) -> bool:
    return isinstance(dt, _NUMERIC)


def parse_number(c: Column) -> Column:
    """Text -> double when it is a plain number, else null."""
    return F.when(c.rlike(NUMBER_RE), F.trim(c).try_cast("double"))


def number(df: DataFrame, col: str) -> Column:
    """A column as double: text that is no plain number, and NaN, become null (PRJ4)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.StringType):
        return parse_number(F.col(col))
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def as_numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    """``df`` with its text columns among ``cols`` read as numbers (PRJ4)."""
    text = [c for c in cols if isinstance(df.schema[c].dataType, T.StringType)]
    return df.withColumns({c: number(df, c) for c in text}) if text else df


def _null_code_expr(name: str, dt, codes, strings) -> Column:
    c = F.col(name)
    codes_d = [float(x) for x in codes]
    if isinstance(dt, T.StringType):
        num = parse_number(c)
        return F.when(c.isin(list(strings)) | num.isin(codes_d), F.lit(None).cast("string")).otherwise(c).alias(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        bad = F.isnan(c) | c.isin(codes_d)
        return F.when(bad, F.lit(None).cast(dt)).otherwise(c).alias(name)
    if _is_numeric(dt):
        return F.when(c.isin(list(codes)), F.lit(None).cast(dt)).otherwise(c).alias(name)
    return c


def null_codes(df: DataFrame, codes=MISSING_CODES, strings=MISSING_STRINGS,
               cols: list[str] | None = None) -> DataFrame:
    """Missing codes -> null in every (or the given) column (PRJ1).

    Text cells equal to a text code, or parsing to a numeric code, become
    null; numeric cells equal to a code (or NaN) become null. Other text is
    preserved. Idempotent.
    """
    target = set(cols or df.columns)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_null_code_expr(n, dtypes[n], codes, strings) if n in target else F.col(n)
                       for n in df.columns])


def unparseable_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One-row table: per text column, the number of non-null cells that are
    not plain numbers."""
    text = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (cols is None or f.name in cols)]
    if not text:
        return df.sparkSession.createDataFrame([()], T.StructType([]))
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).rlike(NUMBER_RE)).alias(c) for c in text])


def infer_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric-if-parseable, else keep text (PRJ2).

    One aggregate counts unparseable cells of every text column (a single
    scan; the driver receives one row); columns with none are cast to double.
    """
    counts = unparseable_counts(df, cols)
    if not counts.columns:
        return df
    row = counts.first().asDict()
    numeric = {c for c, n in row.items() if n == 0}
    return df.select(*[parse_number(F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def residual_codes(df: DataFrame, codes=MISSING_CODES, top: int = 3,
                   cols: list[str] | None = None) -> DataFrame:
    """Audit of cells still equal to a numeric code (PRJ3): counts per
    (column, code) for the ``top`` columns with the most such cells.

    The unpivot + count is map-side combined; the ranking runs on the tiny
    (column x code) count table.
    """
    names = cols or [f.name for f in df.schema.fields
                     if isinstance(f.dataType, T.StringType) or _is_numeric(f.dataType)]
    dtypes = {f.name: f.dataType for f in df.schema.fields}

    def val(n):
        return parse_number(F.col(n)) if isinstance(dtypes[n], T.StringType) else F.col(n).cast("double")

    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), val(n).alias("code"))
                                          for n in names])).alias("c")).select("c.*")
    counts = (cells.filter(F.col("code").isin([float(x) for x in codes]))
                   .groupBy("column", "code").agg(F.count(F.lit(1)).alias("n")))
    totals = counts.groupBy("column").agg(F.sum("n").alias("column_total"))
    ranked = totals.select("column", "column_total",
                           F.row_number().over(_rank_window()).alias("column_rank"))
    keep = bounded(ranked.filter(F.col("column_rank") <= top))
    return counts.join(keep, "column")


def _rank_window():
    from pyspark.sql import Window
    return Window.orderBy(F.col("column_total").desc(), F.col("column").asc())


def clip_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], keep_zero: bool = True) -> DataFrame:
    """Clip each variable to [lo, hi]; zero always kept; nulls untouched
    (PRJ5). Text columns are clipped where they parse, other text is kept."""
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for n in df.columns:
        if n not in ranges:
            out.append(F.col(n))
            continue
        lo, hi = ranges[n]
        is_text = isinstance(dtypes[n], T.StringType)
        x = parse_number(F.col(n)) if is_text else F.col(n)
        x = x.cast("double")
        clipped = F.when(x.isNull(), x)
        if keep_zero:
            clipped = clipped.when(x == 0, x)
        clipped = clipped.when(x < lo, F.lit(float(lo))).when(x > hi, F.lit(float(hi))).otherwise(x)
        if is_text:
            clipped = F.when(x.isNull(), F.col(n)).otherwise(clipped.cast("string"))
        out.append(clipped.alias(n))
    return df.select(*out)


def clip_audit(df: DataFrame, ranges: dict[str, tuple[float, float]], max_listed: int = 10) -> DataFrame:
    """Per variable with violations: zeros kept, below-min, above-max counts
    and, when fewer than ``max_listed`` values were out of range, the sorted
    original values as text (PRJ6).

    The value lists are built only for variables known to have few
    violations (a broadcast of <= #variables rows), so no unbounded group is
    collected.
    """
    names = [n for n in ranges if n in df.columns]

    def num(n):
        # text columns are read as clip_ranges reads them: what is no number is null
        return parse_number(F.col(n)) if isinstance(df.schema[n].dataType, T.StringType) else F.col(n).cast("double")

    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("variable"), num(n).alias("value"),
                 F.lit(float(ranges[n][0])).alias("lo"), F.lit(float(ranges[n][1])).alias("hi"))
        for n in names])).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    below = (F.col("value") < F.col("lo")) & (F.col("value") != 0)
    above = F.col("value") > F.col("hi")
    counts = cells.groupBy("variable", "lo", "hi").agg(
        F.count_if(F.col("value") == 0).alias("n_zero"),
        F.count_if(below).alias("n_below"),
        F.count_if(above).alias("n_above"))
    counts = counts.filter((F.col("n_below") + F.col("n_above")) > 0)
    few = bounded(counts.filter((F.col("n_below") + F.col("n_above")) < max_listed).select("variable"))
    listed = (cells.filter(below | above).join(few, "variable", "left_semi")
                   .groupBy("variable")
                   .agg(F.array_join(F.transform(F.sort_array(F.collect_list("value")),
                                                 lambda v: v.cast("string")), ",").alias("originals")))
    return counts.join(listed, "variable", "left")


def reverse_code(df: DataFrame, col: str, lo: int = 1, hi: int = 5) -> DataFrame:
    """Reverse a lo..hi scale (1<->5, 2<->4); other values unchanged (PRJ7)."""
    x = F.col(col)
    return df.withColumn(col, F.when(x.isin(list(range(lo, hi + 1))), (lo + hi) - x).otherwise(x))
