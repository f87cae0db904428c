"""Correlation, reliability and collinearity (COR1-COR7).

* Pairwise-complete Pearson correlations of p columns are one aggregate of
  p(p-1)/2 ``corr`` expressions (Spark's ``corr`` skips rows where either
  side is null), returned as a long (var1, var2, r, n) table.
* VIF and Cronbach's alpha need a p x p matrix only: one Gram/correlation
  aggregate over complete rows, then a p x p solve on the driver. No data
  row leaves the executors.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.catalog import CORR_CHANGE_CUTS, HIGH_CORRELATION, NETWORK_MIN_ABS_R, NETWORK_STRENGTH_CUTS, VIF_HIGH
from wavepanel.operators.clean import as_numbers
from wavepanel.operators.sizing import bounded
from wavepanel.operators.derive import finite, threshold_label


def _pairs(cols: list[str], full: bool):
    if full:
        return [(a, b) for a in cols for b in cols]
    return list(itertools.combinations(cols, 2))


def pair_sums(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sums over the rows in which both columns of a pair (i <= j) hold a finite
    number: n, sx, sy, sxx, syy, sxy, of values less their column's mean. One
    matrix product an Arrow batch, one partial row a task and pair, added up by
    Spark: the work of p columns is p^2 flops a row, not p^2 aggregates."""
    x = as_numbers(df, cols).select(*[finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)])
    mu = np.array([v if v is not None else 0.0 for v in x.agg(*[F.avg(c) for c in x.columns]).first()])
    i, j = np.triu_indices(len(cols))

    def partial(batches):
        total = None
        for pdf in batches:
            v = pdf.to_numpy(dtype=float)
            held = np.isfinite(v)
            v, m = np.where(held, v - mu, 0.0), held.astype(float)
            s = np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
            total = s if total is None else total + s
        if total is not None:
            n, first, square, cross = total
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": first[i, j], "sy": first[j, i],
                                "sxx": square[i, j], "syy": square[j, i], "sxy": cross[i, j]})

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    parts = x.mapInPandas(partial, "i int, j int, " + ", ".join(f"{c} double" for c in sums))
    return parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])


def corr_long(df: DataFrame, cols: list[str], full: bool = False) -> DataFrame:
    """Pairwise-complete correlation matrix in long form (COR1, COR2).

    ``full=False`` gives pairs i < j in column order; ``full=True`` all p^2
    ordered pairs including the diagonal. ``r`` is null where undefined
    (fewer than 2 complete pairs or a constant column). Values that are no
    finite number count as missing.
    """
    pairs = [(a, b, *sorted((cols.index(a), cols.index(b)))) for a, b in _pairs(cols, full)]
    listed = df.sparkSession.createDataFrame(pairs, "var1 string, var2 string, i int, j int")
    n = F.col("n")
    vx, vy = (F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}") / n for c in "xy")
    # what is left of a constant column is rounding
    varies = (vx > 1e-13 * F.col("sxx")) & (vy > 1e-13 * F.col("syy"))
    r = F.when((n >= 2) & varies, (F.col("sxy") - F.col("sx") * F.col("sy") / n) / F.sqrt(vx * vy))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    sums = pair_sums(df, cols).filter("n > 0").select("i", "j", finite(r).alias("r"), n.cast("bigint").alias("n"))
    out = listed.join(bounded(sums), ["i", "j"], "left")
    return out.select("var1", "var2", "r", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def missing_corr(df: DataFrame, cols: list[str]) -> DataFrame:
    """Correlation of 0/1 missing indicators (COR2)."""
    flags = df.select(*[F.col(c).isNull().cast("double").alias(c) for c in cols])
    return corr_long(flags, cols)


def corr_shift(before: DataFrame, after: DataFrame, cols: list[str], after_cols: list[str] | None = None,
               digits: int = 3) -> DataFrame:
    """Correlations before and after (e.g. imputation), each rounded to
    ``digits``, their difference and a verdict (COR3, PRJ27)."""
    after_cols = after_cols or cols
    a = corr_long(before.select(*cols), cols)
    b = corr_long(after.select(*[F.col(x).alias(c) for x, c in zip(after_cols, cols)]), cols)
    j = a.select("var1", "var2", F.bround("r", digits).alias("original")).join(
        b.select("var1", "var2", F.bround("r", digits).alias("imputed")), ["var1", "var2"])
    change = F.round(F.col("imputed") - F.col("original"), digits)
    return j.select("*", change.alias("change"),
                    threshold_label(F.abs(change), list(CORR_CHANGE_CUTS),
                                    ["preserved", "moderate", "substantial"]).alias("verdict"))


def high_pairs(corr: DataFrame, threshold: float = HIGH_CORRELATION) -> DataFrame:
    """Pairs with |r| above the threshold (COR4)."""
    return corr.filter(F.abs("r") > threshold)


def corr_edges(corr: DataFrame, min_abs: float = NETWORK_MIN_ABS_R) -> DataFrame:
    """Correlation-network edge table (COR5): weight |r|, drawing width
    max(12w, 3), strength class by the cut points, and sign."""
    w = F.abs("r")
    return corr.filter(w > min_abs).select(
        F.col("var1").alias("src"), F.col("var2").alias("dst"), "r",
        w.alias("weight"), F.greatest(w * 12, F.lit(3.0)).alias("width"),
        threshold_label(w, list(NETWORK_STRENGTH_CUTS), ["weak", "moderate", "strong", "very strong"])
        .alias("strength"),
        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("sign"))


def gram(df: DataFrame, cols: list[str], center: bool = False) -> tuple[np.ndarray, int]:
    """X'X over rows complete in ``cols`` (one aggregate, p(p+1)/2 sums),
    returned to the driver as a p x p array with the row count."""
    x = as_numbers(df, cols).select(*[finite(F.col(c).cast("double")).alias(c) for c in cols]).dropna()
    if center:
        mu = x.agg(*[F.avg(c).alias(c) for c in cols]).first()
        x = x.select(*[(F.col(c) - F.lit(mu[c])).alias(c) for c in cols])
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = x.agg(F.count(F.lit(1)).alias("n"),
                *[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    p = len(cols)
    g = np.zeros((p, p))
    for i, j in pairs:
        val = row[f"g{i}_{j}"] or 0.0
        g[i, j] = g[j, i] = val
    return g, int(row["n"])


def vif(df: DataFrame, cols: list[str], intercept: bool = False) -> DataFrame:
    """Variance inflation factors on complete rows (COR6), largest first (SRT4).

    Without an intercept (the reference's form) the auxiliary regressions
    use uncentred R^2, so VIF_j = (X'X)_jj * ((X'X)^-1)_jj. With an
    intercept the centred cross-product matrix is used instead. A singular
    matrix is handled with the pseudo-inverse and flagged, not raised.
    """
    g, n = gram(df, cols, center=intercept)
    singular = np.linalg.matrix_rank(g) < len(cols) if n else True
    inv = np.linalg.pinv(g) if n else np.full_like(g, np.nan)
    rows = []
    for j, c in enumerate(cols):
        v = float(g[j, j] * inv[j, j]) if n else None
        if v is not None and not np.isfinite(v):
            v = None
        rows.append((c, v, bool(v is not None and v > VIF_HIGH), bool(singular), n))
    rows.sort(key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    schema = T.StructType([T.StructField("variable", T.StringType()), T.StructField("vif", T.DoubleType()),
                           T.StructField("high", T.BooleanType()), T.StructField("singular", T.BooleanType()),
                           T.StructField("n", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


def cronbach_alpha(df: DataFrame, scales: dict[str, list[str]]) -> DataFrame:
    """Standardised Cronbach's alpha per scale on its complete rows (COR7):
    alpha = k/(k-1) * (1 - k'/sum(R)), R the item correlation matrix over
    the non-constant items (k' of them), which is what standardising with
    population SDs and taking variances gives.

    All scales come from one aggregate: each scale's listwise mask is applied
    by nulling its items outside complete rows (``corr`` and ``stddev_pop``
    skip nulls), so rows are scanned once whatever the number of scales.
    """
    aggs = []
    for s, (name, items) in enumerate(scales.items()):
        complete = F.lit(True)
        for c in items:
            complete = complete & F.col(c).isNotNull()

        def x(c, complete=complete):
            return F.when(complete, F.col(c).cast("double"))

        aggs.append(F.count_if(complete).alias(f"n_{s}"))
        aggs += [F.stddev_pop(x(c)).alias(f"sd_{s}_{i}") for i, c in enumerate(items)]
        aggs += [F.corr(x(a), x(b)).alias(f"r_{s}_{i}_{j}")
                 for (i, a), (j, b) in itertools.combinations(enumerate(items), 2)]
    wide = df.agg(*aggs)
    rows = []
    for s, (name, items) in enumerate(scales.items()):
        k = len(items)
        live = [F.coalesce(F.col(f"sd_{s}_{i}"), F.lit(0.0)) > 0 for i in range(k)]
        k_live = sum((F.when(c, 1.0).otherwise(0.0) for c in live), F.lit(0.0))
        total = k_live
        for i, j in itertools.combinations(range(k), 2):
            total = total + F.when(live[i] & live[j], 2 * F.coalesce(F.col(f"r_{s}_{i}_{j}"), F.lit(0.0))) \
                             .otherwise(0.0)
        alpha = F.when(total > 0, (k / (k - 1)) * (1 - k_live / total)) if k > 1 else F.lit(None)
        rows.append(F.struct(F.lit(name).alias("scale"), F.lit(k).alias("k"),
                             F.col(f"n_{s}").alias("n"), alpha.cast("double").alias("alpha")))
    return wide.select(F.explode(F.array(*rows)).alias("a")).select("a.*")
