"""Data behind the reference's charts (PLT1-PLT9, AGG23). Rendering is not
built; each chart becomes a small aggregate table whose size is bounded by
bins x groups, never by the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.functions import special as S
from wavepanel.operators.describe import add_quantiles, long_values
from wavepanel.operators.derive import stars
from wavepanel.operators.segments import HOT_ROWS, auto_rows, chunked_row_number
from wavepanel.operators.sizing import bounded, level_table


def histogram(df: DataFrame, cols: list[str], bins: int = 30, by: list[str] | None = None) -> DataFrame:
    """Equal-width bins over [min, max] per variable (and group); the last
    bin is closed on the right (PLT1)."""
    by = by or []
    long = long_values(df, cols, ids=by).filter(F.col("value").isNotNull())
    rng = bounded(long.groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    idx = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(0)
    j = long.join(rng, "variable").withColumn("bin", idx.cast("int"))
    out = j.groupBy(*by, "variable", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    w = (F.col("hi") - F.col("lo")) / bins
    return out.select(*by, "variable", "bin", (F.col("lo") + F.col("bin") * w).alias("left"),
                      (F.col("lo") + (F.col("bin") + 1) * w).alias("right"), "n")


def kde_from_histogram(hist: DataFrame, grid: int = 50, bandwidth: float | None = None) -> DataFrame:
    """Gaussian KDE evaluated on a grid from binned counts (PLT1's density
    curve). Bins x grid points per variable: bounded, not data-sized."""
    spark = hist.sparkSession
    g = bounded(spark.range(grid).withColumnRenamed("id", "g"))
    stats = hist.groupBy("variable").agg(
        F.sum("n").alias("n_total"), F.min("left").alias("lo"), F.max("right").alias("hi"),
        (F.sum(F.col("n") * (F.col("left") + F.col("right")) / 2) / F.sum("n")).alias("mu"),
        F.sum(F.col("n") * ((F.col("left") + F.col("right")) / 2) ** 2).alias("s2"))
    n = F.col("n_total")
    sd = F.sqrt(F.greatest(F.try_divide(F.col("s2") - n * F.col("mu") ** 2, n - 1), F.lit(0.0)))
    h = F.lit(bandwidth) if bandwidth else sd * F.pow(n, -0.2)          # Scott's rule in one dimension
    stats = stats.select("variable", "n_total", "lo", "hi", F.greatest(h, F.lit(1e-12)).alias("h"))
    pts = stats.crossJoin(g).select("variable", "n_total", "h",
                                    (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (grid - 1)).alias("x"))
    mid = (F.col("left") + F.col("right")) / 2
    j = pts.join(hist.select("variable", mid.alias("c"), "n"), "variable")
    u = (F.col("x") - F.col("c")) / F.col("h")
    dens = F.sum(F.col("n") * F.exp(-0.5 * u * u)) / (F.col("n_total") * F.col("h") * (2 * 3.141592653589793) ** 0.5)
    return j.groupBy("variable", "x", "n_total", "h").agg(dens.alias("density")).select("variable", "x", "density")


def qq_points(df: DataFrame, cols: list[str], points: int = 99) -> DataFrame:
    """Q-Q pairs on a probability grid p_i = (i - 0.5)/m: theoretical normal
    quantile vs exact sample quantile of the standardised values (PLT2)."""
    probs = [(i - 0.5) / points for i in range(1, points + 1)]
    theo = [S.norm_ppf(p) for p in probs]
    long = long_values(df, cols).filter(F.col("value").isNotNull())
    q = long.groupBy("variable").agg(F.avg("value").alias("mu"), F.stddev_samp("value").alias("sd"))
    q = add_quantiles(q, long, ["variable"], "value", probs, "q")
    grid = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("p"),
                        F.array(*[F.lit(t) for t in theo]).alias("theoretical"), F.col("q").alias("sample"))
    return (q.select("variable", "mu", "sd", F.explode(grid).alias("z"))
             .select("variable", F.col("z.p").alias("p"), F.col("z.theoretical").alias("theoretical"),
                     F.col("z.sample").alias("sample"),
                     F.try_divide(F.col("z.sample") - F.col("mu"), F.col("sd")).alias("standardized")))


def box_stats(df: DataFrame, cols: list[str], by: list[str] | None = None, whisker: float = 1.5) -> DataFrame:
    """Five-number summary with Tukey whiskers per variable and group, rows
    without a group being one (PLT3)."""
    by = by or []
    long = long_values(df, cols, ids=by).filter(F.col("value").isNotNull())
    keys = [*by, "variable"]
    q = add_quantiles(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), long, keys, "value", [0.25, 0.5, 0.75], "q")
    q = q.select(*keys, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = q.select("*", (F.col("q1") - whisker * iqr).alias("__lo"), (F.col("q3") + whisker * iqr).alias("__hi"))
    fences = level_table(fences)
    named = [f"__k{i}" for i in range(len(keys))]
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named)]
    j = long.join(fences.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], "__lo", "__hi"), same)
    wk = j.groupBy(*keys).agg(
        F.min(F.when(F.col("value") >= F.col("__lo"), F.col("value"))).alias("whisker_lo"),
        F.max(F.when(F.col("value") <= F.col("__hi"), F.col("value"))).alias("whisker_hi"),
        F.count_if((F.col("value") < F.col("__lo")) | (F.col("value") > F.col("__hi"))).alias("n_outliers"))
    wk = wk.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], "whisker_lo", "whisker_hi", "n_outliers")
    return fences.drop("__lo", "__hi").join(wk, same).drop(*named)


def plot_limits(coefs: DataFrame, by: list[str] | None = None, pct: float = 95, z: float = 1.96,
                pad: float = 0.1) -> DataFrame:
    """Axis limits from the pct / (100 - pct) percentiles of all CI ends,
    widened to include 0 and padded by ``pad`` of the range (AGG23)."""
    by = by or []
    ends = coefs.select(*by, F.explode(F.array(F.col("coef") + z * F.col("se"),
                                               F.col("coef") - z * F.col("se"))).alias("e"))
    lim = ends.groupBy(*by).agg(F.percentile("e", (100 - pct) / 100).alias("lo"),
                                F.percentile("e", pct / 100).alias("hi"))
    lo, hi = F.least(F.col("lo"), F.lit(0.0)), F.greatest(F.col("hi"), F.lit(0.0))
    rng = hi - lo
    return lim.select(*by, (lo - rng * pad).alias("axis_lo"), (hi + rng * pad).alias("axis_hi"))


def forest_rows(coefs: DataFrame, limits: DataFrame, by: list[str] | None = None, z: float = 1.96) -> DataFrame:
    """Forest-plot rows: coef, CI, CI clipped to the axis limits with
    truncation flags, significance stars (PLT5)."""
    by = by or []
    lim = bounded(limits) if not by else limits
    j = coefs.crossJoin(lim) if not by else coefs.join(lim, by)
    lo, hi = F.col("coef") - z * F.col("se"), F.col("coef") + z * F.col("se")
    return j.select(*by, "term", "coef", lo.alias("ci_lo"), hi.alias("ci_hi"),
                    F.greatest(lo, F.col("axis_lo")).alias("draw_lo"), F.least(hi, F.col("axis_hi")).alias("draw_hi"),
                    (lo < F.col("axis_lo")).alias("cut_lo"), (hi > F.col("axis_hi")).alias("cut_hi"),
                    stars("p").alias("stars"))


def binned_2d(df: DataFrame, x: str, y: str, x_width: float, y_width: float) -> DataFrame:
    """2-D binned density (e.g. residual vs fitted) instead of a raw scatter (PLT6)."""
    return (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
              .groupBy(F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin"))
              .agg(F.count(F.lit(1)).alias("n"))
              .select((F.col("x_bin") * x_width).alias("x_left"), (F.col("y_bin") * y_width).alias("y_left"), "n"))


def lower_triangle(corr_full: DataFrame, order: list[str]) -> DataFrame:
    """Heat-map cells below the diagonal of a long matrix (PLT7)."""
    pos = F.create_map(*[x for i, c in enumerate(order) for x in (F.lit(c), F.lit(i))])
    return corr_full.filter(pos[F.col("var1")] > pos[F.col("var2")])


def ranked(df: DataFrame, value: str, desc: bool = True, by: list[str] | None = None,
           abs_value: bool = False, name: str = "rank", task_rows: int = HOT_ROWS) -> DataFrame:
    """Rank column by (|value|) (SRT3, SRT4), missing values last if the largest
    come first. A table of more than ``task_rows`` rows is ranked in chunks (``segments``)."""
    key = F.abs(F.col(value)) if abs_value else F.col(value)
    if by:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(key.desc() if desc else key.asc())))
    chunks = auto_rows(df.select(F.lit(1).alias("__all")), "__all", task_rows)
    if chunks is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(key.desc() if desc else key.asc())))
    # ascending in both: what is missing, then the key
    keyed = df.withColumns({"__all": F.lit(1), "__none": key.isNull() == F.lit(desc), "__key": -key if desc else key})
    return chunked_row_number(keyed, "__all", ["__none", "__key"], chunks, name=name).drop("__all", "__none", "__key")
