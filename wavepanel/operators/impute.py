"""Within-entity distance-weighted kNN imputation (IMP1, IMP2, PRJ20).

Semantics (per entity and variable): an entity with fewer than 2 rows, no
missing cell, or no observed value is left alone. Otherwise each missing
cell gets the distance-weighted mean (weights 1/d, d = |visit difference|)
of its ``min(k, n_observed)`` nearest observed cells, ties broken by
(distance, visit, tie-break columns); when any chosen donor sits at distance
0 the value is the plain mean of those donors. The value is rounded half to
even. As in the reference, the ``*_imputed`` column of a touched
(entity, variable) also carries the *rounded* observed values, while the
``*_filled`` column keeps observed values as they were.

Plan: in one dimension the k nearest observed cells are always among the k
previous and the k next observed cells in order, so the candidates are
``lag``/``lead ... IGNORE NULLS`` over one window partitioned by entity
(a single shuffle for every variable at once), and the selection and
weighting are built-in array functions. No self join: the work is linear in
rows x k instead of quadratic in an entity's length.

Weights use the product form  w_i = prod_{j != i} d_j  (equal to 1/d_i up to
a common factor), which is exact in double arithmetic for integer visits and
values, so half-to-even rounding of exact ties (2.5 -> 2) is reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.operators.clean import as_numbers
from wavepanel.operators.describe import add_quantiles
from wavepanel.operators.segments import Rows, chunked_neighbours, resolve_width
from wavepanel.operators.sizing import bounded
from wavepanel.session import write_shared


def _item(v: str, order: list[str]) -> Column:
    fields = [F.col(order[0]).cast("double").alias("p")]
    fields += [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    fields.append(F.col(v).cast("double").alias("x"))
    return F.when(F.col(v).isNotNull(), F.struct(*fields))


def _with_candidates(df: DataFrame, entity: str, order: list[str], variables: list[str],
                     k_max: int) -> DataFrame:
    """Adds, per variable, ``__cand_v`` (array of up to 2k observed cells
    around the row), ``__nobs_v``, and the entity row count ``__nrows``."""
    w = Window.partitionBy(entity).orderBy(*order)
    whole = Window.partitionBy(entity)
    base = df.select("*", *[_item(v, order).alias(f"__it_{v}") for v in variables])
    cols = [F.count(F.lit(1)).over(whole).alias("__nrows")]
    for v in variables:
        it = f"__it_{v}"
        lags = [F.expr(f"lag({it}, {j}) IGNORE NULLS").over(w) for j in range(1, k_max + 1)]
        leads = [F.expr(f"lead({it}, {j}) IGNORE NULLS").over(w) for j in range(1, k_max + 1)]
        cols.append(F.array(*lags, *leads).alias(f"__cand_{v}"))
        cols.append(F.count(v).over(whole).alias(f"__nobs_{v}"))
    return base.select("*", *cols).drop(*[f"__it_{v}" for v in variables])


def _sorted_candidates(cands: Column, pos: Column, n_order: int) -> Column:
    """Candidates keyed by (distance, position, tie-breaks) and sorted once."""
    present = F.filter(cands, lambda c: c.isNotNull())
    keyed = F.transform(present, lambda c: F.struct(
        F.abs(c["p"] - pos).alias("d"), c["p"].alias("p"),
        *[c[f"o{i}"].alias(f"o{i}") for i in range(n_order)], c["x"].alias("x")))
    return F.array_sort(keyed)


def _knn_value(ranked: Column, n_obs: Column, k: int) -> Column:
    """Distance-weighted mean of the k nearest of the sorted candidates (see module doc)."""
    chosen = F.slice(ranked, F.lit(1), F.least(F.lit(k), n_obs.cast("int")))
    at_zero = F.filter(chosen, lambda c: c["d"] == 0)
    n0 = F.size(at_zero)
    mean0 = F.try_divide(F.aggregate(at_zero, F.lit(0.0), lambda acc, c: acc + c["x"]), n0)
    prod = F.aggregate(chosen, F.lit(1.0), lambda acc, c: acc * c["d"])

    def weight(c):
        return F.when(c["d"] > 0, prod / c["d"]).otherwise(F.lit(0.0))

    num = F.aggregate(chosen, F.lit(0.0), lambda acc, c: acc + c["x"] * weight(c))
    den = F.aggregate(chosen, F.lit(0.0), lambda acc, c: acc + weight(c))
    return F.when(n0 > 0, mean0).otherwise(F.try_divide(num, den))


def _candidates(df, entity, order, variables, k, chunk_width):
    chunk_width = resolve_width(df, entity, chunk_width)
    if chunk_width:
        return chunked_neighbours(df, entity, order, variables, k, chunk_width)
    return _with_candidates(df, entity, order, variables, k)


def knn_impute(df: DataFrame, entity: str, order: list[str], variables: list[str], k: int = 4,
               suffix: str = "_imputed", filled_suffix: str | None = "_filled",
               chunk_width: float | str | Rows | None = "auto") -> DataFrame:
    """Adds ``{v}_imputed`` (and ``{v}_filled``) for each variable (IMP1, PRJ20).

    ``order[0]`` is the numeric position used for distances; the remaining
    order columns only break ties. Candidates are the k observed rows before and
    the k after a row in that order. With ``chunk_width`` the candidate windows
    run per (entity, order-range chunk) with boundary halos, so an entity of
    any size is split across tasks, also if its rows share one position
    (``segments.Rows``); results are identical.
    """
    df = as_numbers(df, variables)
    cand = _candidates(df, entity, order, variables, k, chunk_width)
    pos = F.col(order[0]).cast("double")
    cand = cand.select("*", *[F.when(F.col(v).isNull(), _sorted_candidates(F.col(f"__cand_{v}"), pos, len(order)))
                              .alias(f"__rank_{v}") for v in variables])        # only missing cells need it
    out = []
    for v in variables:
        n_obs = F.col(f"__nobs_{v}")
        touched = (F.col("__nrows") >= 2) & (n_obs >= 1) & (n_obs < F.col("__nrows"))
        value = F.bround(_knn_value(F.col(f"__rank_{v}"), n_obs, k), 0)
        imputed = F.when(touched, F.when(F.col(v).isNull(), value).otherwise(F.bround(F.col(v).cast("double"), 0))) \
                   .otherwise(F.col(v).cast("double"))
        out.append(imputed.alias(f"{v}{suffix}"))
    res = cand.select(*df.columns, *out)
    if filled_suffix:
        res = res.select("*", *[F.coalesce(F.col(v).cast("double"), F.col(f"{v}{suffix}")).alias(f"{v}{filled_suffix}")
                                for v in variables])
    return res


def k_sweep(df: DataFrame, entity: str, order: list[str], variables: list[str],
            ks: tuple[int, ...] = (2, 3, 4, 5), chunk_width: float | str | Rows | None = "auto") -> DataFrame:
    """Imputed values of originally missing cells for several k from one
    candidate pass, summarised per (variable, k): count, mean, std, median
    (IMP2, AGG22)."""
    k_max = max(ks)
    df = as_numbers(df, variables)
    cand = _candidates(df, entity, order, variables, k_max, chunk_width)
    pos = F.col(order[0]).cast("double")
    # only missing cells are summarised; sort each one's candidates once for all k
    cand = cand.filter(F.greatest(*[F.col(v).isNull() for v in variables]) if len(variables) > 1
                       else F.col(variables[0]).isNull())
    cand = cand.select("*", *[_sorted_candidates(F.col(f"__cand_{v}"), pos, len(order)).alias(f"__rank_{v}")
                              for v in variables])
    cells = []
    for v in variables:
        n_obs = F.col(f"__nobs_{v}")
        touched = (F.col("__nrows") >= 2) & (n_obs >= 1) & F.col(v).isNull()
        for k in ks:
            val = F.bround(_knn_value(F.col(f"__rank_{v}"), n_obs, k), 0)
            cells.append(F.struct(F.lit(v).alias("variable"), F.lit(k).alias("k"),
                                  F.when(touched, val).alias("value")))
    long = cand.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter(F.col("value").isNotNull())
    # imputed values are whole numbers, so few: counted once, and all statistics are taken of the counts
    keys = ["variable", "k"]
    counts = write_shared(long.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c")), "imputed-counts")
    means = counts.groupBy(*keys).agg(F.sum("c").alias("n_imputed"), (F.sum(F.col("c") * F.col("value")) / F.sum("c")).alias("mean"))
    away = counts.join(bounded(means), keys).groupBy(*keys, "n_imputed", "mean") \
        .agg(F.sum(F.col("c") * (F.col("value") - F.col("mean")) ** 2).alias("ss"))
    std = F.when(F.col("n_imputed") > 1, F.sqrt(F.col("ss") / (F.col("n_imputed") - 1)))
    out = add_quantiles(away.select(*keys, "n_imputed", "mean", std.alias("std")), counts, keys, "value", [0.5], weight="c")
    return out.select(*keys, "n_imputed", "mean", "std", F.col("__q")[0].alias("median"))


def imputation_counts(df: DataFrame, variables: list[str], suffix: str = "_imputed",
                      filled_suffix: str = "_filled") -> DataFrame:
    """Per variable: cells originally missing, cells imputed, still missing (AGG22)."""
    aggs = []
    for v in variables:
        aggs += [F.count_if(F.col(v).isNull()).alias(f"{v}__missing"),
                 F.count_if(F.col(v).isNull() & F.col(f"{v}{filled_suffix}").isNotNull()).alias(f"{v}__imputed"),
                 F.count_if(F.col(f"{v}{filled_suffix}").isNull()).alias(f"{v}__remaining")]
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(f"{v}__missing").alias("n_missing"),
                 F.col(f"{v}__imputed").alias("n_imputed"), F.col(f"{v}__remaining").alias("n_remaining"))
        for v in variables])).alias("r")).select("r.*")
