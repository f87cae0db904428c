"""Distribution and hypothesis tests (TST1-TST6, TST10, TST11).

Statistics are aggregates over the data (one unpivot + one grouped
aggregate for all variables); the few closed-form finishing steps run as
column expressions, and tail probabilities that Spark lacks are applied to
the handful of result rows by small Arrow-batched helpers.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.catalog import ALPHA, SHAPIRO_MAX_N
from wavepanel.functions import special as S
from wavepanel.functions import udfs as U
from wavepanel.functions.formulas import ANDERSON_P, DAGOSTINO, DAGOSTINO_TEMPS, SHAPIRO_COEF, SHAPIRO_Z, \
    apply_steps
from wavepanel.operators.clean import number
from wavepanel.operators.derive import threshold_label
from wavepanel.operators.describe import add_quantiles, exact_quantiles, long_values
from wavepanel.operators.sizing import bounded, sized_at_run_time
from wavepanel.session import cut_lineage

#: Ranges into which the distinct values of a variable are cut for ranking.
RANK_RANGES = 256
#: Groups up to which their cuts and sums (some 10 KB a group) are broadcast.
RANK_GROUPS = 1000
#: Directions with less than this share of the largest eigenvalue count as determined by the others.
MCAR_RANK = 1e-10


def numeric_profile(df: DataFrame, cols: list[str], min_n: int = 8) -> DataFrame:
    """mean, median, sample std, biased skewness and biased excess kurtosis
    per variable (TST1), with the D'Agostino-Pearson K^2 test (TST2; null
    below ``min_n`` values, TST11)."""
    long = long_values(df, cols).filter(F.col("value").isNotNull())
    v = F.col("value")
    prof = long.groupBy("variable").agg(
        F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"), F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"))
    prof = add_quantiles(prof, long, ["variable"], "value", [0.5]).withColumn("median", F.col("__q")[0])
    # below min_n the formulas see a null n, so none of their divisions is reached
    prof = prof.withColumn("__n", F.col("n")).withColumn("n", F.when(F.col("n") >= min_n, F.col("n")))
    out = apply_steps(prof, DAGOSTINO).drop(*DAGOSTINO_TEMPS)
    return out.select("variable", F.col("__n").cast("bigint").alias("n"), "mean", "median", "std",
                      F.col("g1").alias("skewness"), F.col("g2").alias("kurtosis"), "k2", "k2_p")


def capped_sample(df: DataFrame, cols: list[str], key: list[str], cap: int = SHAPIRO_MAX_N,
                  seed: int = 42) -> DataFrame:
    """Per variable, the ``cap`` non-null values with the smallest hash of
    (key, seed): a reproducible sample (SRT5, SRT6). Each variable's cap is a
    top-k (partial per partition, merged), never a full sort."""
    parts = []
    for c in cols:
        h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed), F.lit(c))
        sub = (df.filter(F.col(c).isNotNull())
                 .select(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"), h.alias("__h"))
                 .orderBy("__h").limit(cap))
        parts.append(sub)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("__h")


def _ranked(long: DataFrame, by: str, value: str) -> DataFrame:
    """Distinct values of each group with their ranks: by, x, c (rows of that
    value), last (rank of the last of them), n, mean, sst (squares about the
    mean). All rows take part; nulls and NaN do not. Values are counted first
    and cut into ranges, so ranking a group is spread over many tasks."""
    v = F.col(value).cast("double")
    counts = cut_lineage(long.filter(v.isNotNull() & ~F.isnan(v)).groupBy(F.col(by).alias("__by"), v.alias("x"))
                             .agg(F.count(F.lit(1)).alias("c")))
    whole = counts.groupBy("__by").agg(
        F.sum("c").alias("n"), F.sum(F.col("c") * F.col("x")).alias("__s"),
        F.percentile_approx("x", [i / RANK_RANGES for i in range(1, RANK_RANGES)]).alias("__cuts"))
    # written down, as an approximate percentile may differ when computed again
    whole = cut_lineage(whole.select("__by", "n", (F.col("__s") / F.col("n")).alias("mean"), "__cuts"))
    small = bounded if whole.count() <= RANK_GROUPS else sized_at_run_time
    part = F.size(F.filter("__cuts", lambda cut: cut < F.col("x")))
    d = F.col("x") - F.col("mean")
    rows = counts.join(small(whole), "__by").select("__by", "x", "c", "n", "mean", part.alias("__part"), (F.col("c") * d * d).alias("__ss"))
    parts = rows.groupBy("__by", "__part").agg(F.sum("c").alias("__pc"), F.sum("__ss").alias("__pss"))
    group = Window.partitionBy("__by")
    before = parts.select("__by", "__part", F.sum("__pss").over(group).alias("sst"),
                          (F.sum("__pc").over(group.orderBy("__part")) - F.col("__pc")).alias("__before"))
    inner = Window.partitionBy("__by", "__part").orderBy("x")
    out = rows.join(small(before), ["__by", "__part"])
    return out.select(F.col("__by").alias(by), "x", "c", "n", "mean", "sst",
                      (F.col("__before") + F.sum("c").over(inner)).alias("last"))


def shapiro_wilk(long: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """Shapiro-Wilk W and p per group (TST3), Royston's approximation, over all
    rows of ``long``; null for fewer than three values or equal values. (The
    approximation of p was made for up to 5,000 values.) Rows of one value
    have neighbouring ranks, so each adds the sum of its ranks' weights."""
    return _shapiro(_ranked(long, by, value), by)


def _shapiro(ranked: DataFrame, by: str) -> DataFrame:
    first, x, n = F.col("last") - F.col("c") + 1, F.col("x"), F.col("n")
    # one value can hold most rows: its ranks are summed in runs
    runs = ranked.select("*", first.alias("__first"), F.explode(F.sequence(first, F.col("last"), F.lit(U.RANKS_AT_ONCE))).alias("__from"))
    runs = runs.withColumn("__s", U.order_sums(F.col("__from"), F.least(F.lit(U.RANKS_AT_ONCE), F.col("last") - F.col("__from") + 1), n))
    mn = U.order_sums(F.col("__n"), F.lit(1), F.col("__n"))["m"]
    mn1 = U.order_sums(F.greatest(F.col("__n") - 1, F.lit(1)), F.lit(1), F.col("__n"))["m"]
    stats = runs.groupBy(by).agg(
        F.max("n").alias("__n"), F.max("sst").alias("sst"), F.sum("__s.mm").alias("mm"),
        F.sum(F.col("__s.m") * (x - F.col("mean"))).alias("mx"),
        F.min("x").alias("x1"), F.min(F.when(F.col("last") >= 2, x)).alias("x2"),
        F.max(F.when(F.col("__first") <= n - 1, x)).alias("xn1"), F.max("x").alias("xn"))
    stats = stats.withColumns({"mn": mn, "mn1": mn1, "n": F.col("__n").cast("double")})
    # fewer than three values have no statistic: null sums keep the formulas from dividing by zero
    enough = (F.col("n") >= 3) & (F.col("sst") > 0)
    stats = apply_steps(stats.withColumns({c: F.when(enough, F.col(c)) for c in ("mm", "mn", "mn1")}), SHAPIRO_COEF)
    outer, second = F.col("xn") - F.col("x1"), F.when(F.col("n") > 5, F.col("xn1") - F.col("x2")).otherwise(0.0)
    inner = F.when(F.col("n") > 3, (F.col("mx") - F.col("mn") * outer - F.col("mn1") * second) / F.sqrt(F.when(F.col("phi") > 0, F.col("phi"))))
    ax = F.coalesce(inner, F.lit(0.0)) + F.col("a_n") * outer + F.col("a_n1") * second
    res = stats.withColumn("w", F.when(enough, F.least(F.lit(1.0), F.try_divide(ax * ax, F.col("sst")))))
    res = apply_steps(res, SHAPIRO_Z)
    # three values: the distribution of W is known exactly
    three = F.greatest(F.lit(0.0), 6.0 / math.pi * (F.asin(F.sqrt("w")) - math.asin(math.sqrt(0.75))))
    return res.select(by, F.col("__n").alias("n"), "w",
                      F.when((F.col("n") == 3) & F.col("w").isNotNull(), three).when(F.col("n") > 3, U.norm_sf(F.col("sw_z"))).alias("sw_p"))


def anderson_darling(long: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """Anderson-Darling normality test on standardised values (TST4), over all
    rows of ``long``; null for equal values. A value with ranks s+1 .. e adds
    (e^2 - s^2) log F(z) + ((n-s)^2 - (n-e)^2) log(1 - F(z))."""
    return _anderson(_ranked(long, by, value), by)


def _anderson(ranked: DataFrame, by: str) -> DataFrame:
    n, e = F.col("n").cast("double"), F.col("last").cast("double")
    s, c = e - F.col("c"), F.col("c").cast("double")
    sd = F.sqrt(F.try_divide(F.col("sst"), n - 1))
    z = ranked.withColumn("z", F.try_divide(F.col("x") - F.col("mean"), sd))       # null for a constant column
    term = c * (e + s) * U.log_upper_tail(-F.col("z")) + c * (2 * n - s - e) * U.log_upper_tail(F.col("z"))
    agg = z.groupBy(by).agg(F.max("n").alias("__n"), F.sum(term / n).alias("s"))
    out = apply_steps(agg.withColumn("n", F.col("__n").cast("double")).withColumn("a2", -F.col("n") - F.col("s")), ANDERSON_P)
    return out.select(by, F.col("__n").alias("n"), "a2", "ad_p")


def chi2_independence(df: DataFrame, row: str, cols: list[str]) -> DataFrame:
    """Pearson chi-square of ``row`` x (is-null of each column) per column
    (TST5). No continuity correction except for 1 degree of freedom (Yates),
    as in the common contingency-test convention. Rows without a ``row`` level
    take no part."""
    cells = long_values(df.filter(F.col(row).isNotNull()).select(row, *cols), cols, ids=[row]).select(
        row, "variable", F.col("value").isNull().cast("int").alias("missing"))
    obs = cells.groupBy("variable", row, "missing").agg(F.count(F.lit(1)).alias("o"))
    rt = obs.groupBy("variable", row).agg(F.sum("o").alias("rt"))
    ct = obs.groupBy("variable", "missing").agg(F.sum("o").alias("ct"))
    tot = obs.groupBy("variable").agg(F.sum("o").alias("t"), F.countDistinct(row).alias("r"),
                                      F.countDistinct("missing").alias("c"))
    grid = rt.join(ct, "variable").join(tot, "variable")
    full = grid.join(obs, ["variable", row, "missing"], "left").fillna(0, subset=["o"])
    full = full.withColumn("e", F.col("rt") * F.col("ct") / F.col("t"))
    dof = (F.col("r") - 1) * (F.col("c") - 1)
    diff = F.when(dof == 1, F.greatest(F.abs(F.col("o") - F.col("e")) - 0.5, F.lit(0.0))) \
            .otherwise(F.abs(F.col("o") - F.col("e")))
    stat = full.groupBy("variable", "r", "c", "t").agg(F.sum(F.try_divide(diff * diff, F.col("e"))).alias("chi2"))
    stat = stat.select("variable", "chi2", ((F.col("r") - 1) * (F.col("c") - 1)).cast("bigint").alias("dof"),
                       F.col("t").alias("n"))
    return stat.withColumn("p", U.chi2_sf(F.col("chi2"), F.col("dof").cast("double")))


def association_verdict(tests: DataFrame, p: str = "p") -> DataFrame:
    """``tests`` with the decision on association of missingness (PRJ27): p below 0.05."""
    return tests.withColumn("verdict", threshold_label(p, [ALPHA], ["associated", "not associated"]))


def normality_verdict(long: DataFrame, by: str = "variable", value: str = "value") -> DataFrame:
    """Both normality tests and the decision (PRJ27): not normal if both p are below 0.05."""
    ranked = _ranked(long, by, value)
    both = _shapiro(ranked, by).join(_anderson(ranked, by).drop("n"), by)
    return both.withColumn("verdict", F.when((F.col("sw_p") < ALPHA) & (F.col("ad_p") < ALPHA), "not normal")
                                       .when(F.col("sw_p").isNotNull() | F.col("ad_p").isNotNull(), "normal"))


def little_mcar(df: DataFrame, cols: list[str]) -> DataFrame:
    """Little's MCAR test (TST6).

    Per missingness pattern (at most 2^p groups) the row count and
    observed-variable means are one grouped aggregate; global means and
    pairwise-complete covariances are one more. The patterns are solved where
    they are, with the p x p covariances at hand: d2 = sum_j n_j (mu_j - mu)' S_j^+
    (mu_j - mu), df = sum_j rank(S_j) - rank(S). Columns without variance or
    without values take no part, and what other columns determine counts once, so
    any input has a result: p is null without degrees of freedom. Text is read as
    numbers; what is none, and NaN, is missing. ``verdict``: missing completely at random if p is above 0.05.
    """
    x = df.select(*[number(df, c).alias(f"x{i}") for i, c in enumerate(cols)])
    p = len(cols)
    aggs = [F.avg(f"x{i}").alias(f"mu_{i}") for i in range(p)]
    aggs += [F.covar_samp(f"x{i}", f"x{j}").alias(f"cv_{i}_{j}") for i, j in itertools.combinations_with_replacement(range(p), 2)]
    g = x.agg(*aggs).first()
    use = [i for i in range(p) if g[f"cv_{i}_{i}"] is not None and g[f"cv_{i}_{i}"] > 0]
    scale = np.array([math.sqrt(g[f"cv_{i}_{i}"]) for i in use])
    mu = np.array([g[f"mu_{i}"] for i in use], dtype=float)
    pair = lambda i, j: g[f"cv_{min(i, j)}_{max(i, j)}"] or 0.0
    corr = np.array([[pair(i, j) for j in use] for i in use], dtype=float).reshape(len(use), len(use)) / np.outer(scale, scale)
    means = [f"m{i}" for i in use]

    def solve(batches):
        for pdf in batches:
            mat, n = pdf[means].to_numpy(float), pdf["n"].to_numpy(float)
            d2, rank = np.zeros(len(pdf)), np.zeros(len(pdf), np.int64)
            for r, row in enumerate(mat):
                obs = np.flatnonzero(~np.isnan(row))
                if len(obs):
                    sub = corr[np.ix_(obs, obs)]
                    away = (row[obs] - mu[obs]) / scale[obs]
                    d2[r] = n[r] * (away @ np.linalg.pinv(sub, rcond=MCAR_RANK, hermitian=True) @ away)
                    rank[r] = np.linalg.matrix_rank(sub, tol=MCAR_RANK * np.abs(sub).sum(axis=1).max(), hermitian=True)
            yield pd.DataFrame({"d2": d2, "rank": rank})

    pats = x.groupBy(*[F.col(f"x{i}").isNull().alias(f"g{i}") for i in range(p)]).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in use])
    total = pats.select("n", *means).mapInPandas(solve, "d2 double, rank long").agg(
        F.sum("d2").alias("d2"), F.sum("rank").alias("rank"), F.count(F.lit(1)).alias("n")).first()
    whole = int(np.linalg.matrix_rank(corr, tol=MCAR_RANK * np.abs(corr).sum(axis=1).max(), hermitian=True)) if use else 0
    dof = int(total["rank"] or 0) - whole if total["n"] else 0
    d2 = float(total["d2"] or 0.0)
    return df.sparkSession.createDataFrame(
        [(d2, max(dof, 0), S.chi2_sf(d2, dof) if dof > 0 else None, total["n"])],
        "d2 double, dof bigint, p double, n_patterns bigint").withColumn(
        "verdict", F.when(F.col("p") > ALPHA, "MCAR").when(F.col("p").isNotNull(), "not MCAR"))


def iqr_outliers(reference: DataFrame, candidate: DataFrame, cols: list[str], k: float = 1.5) -> DataFrame:
    """Candidate values outside [q1 - k*IQR, q3 + k*IQR] of the reference
    values, per variable (TST10). Quartiles are exact (linear interpolation);
    the per-variable fences are one small broadcast table."""
    ref = long_values(reference, cols).filter(F.col("value").isNotNull())
    q = exact_quantiles(ref, ["variable"], "value", [0.25, 0.75])
    fences = q.select("variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = fences.select("*", (F.col("q1") - k * iqr).alias("lower"), (F.col("q3") + k * iqr).alias("upper"))
    cand = long_values(candidate, cols).filter(F.col("value").isNotNull())
    j = cand.join(bounded(fences), "variable")
    out = j.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        F.count_if((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))).alias("n_outliers"))
    return fences.join(out, "variable", "left").fillna(0, subset=["n_candidates", "n_outliers"])
