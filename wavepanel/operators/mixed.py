"""Linear mixed-effects models fitted by REML from distributed sufficient
statistics (MOD1-MOD10).

Model, per entity i:  y_i = X_i b + Z_i u_i + e_i,  u_i ~ N(0, s2 * G),
e_i ~ N(0, s2 * I), with Z_i = [1] (random intercept) or [1, v] (random
intercept and slope on column v). With W_i = I + Z_i G Z_i' and
M_i = I + Z_i'Z_i G, Woodbury gives

    W_i^-1 = I - Z_i G M_i^-1 Z_i',     log|W_i| = log|M_i|.

Everything the profile REML likelihood needs is therefore the global
cross-product of [X y] plus, per entity, A_i = Z_i'[X y] and Z_i'Z_i. M_i
depends on Z_i'Z_i only, so entities sharing (n_i, sum v, sum v^2) are
summed together:

1. ``groupBy(entity)``: Z'Z entries, A_i rows and [X y]'[X y] sums
   (partial aggregation: a hot entity is combined map-side);
2. ``groupBy(pattern)``: sums of the outer products of A_i rows;
3. minimise the REML criterion over the Cholesky factor of G (1 or 3
   parameters) by batched Newton steps; b and s2 are profiled out. All models
   of a batch move in step, a batch of candidate covariances each. The sums a
   candidate needs come from the pattern table on the driver, or, where there
   are too many patterns, from one Spark job on the entity table: the search
   is the same.

Covariates, outcome and the slope variable are centred before anything is
summed (sums of squares of far-off values lose their digits); coefficients,
covariances and random effects are given for the columns as they came.
Columns that other columns determine (such as a level that a model lacks) are
left out of that model: their coefficient is null. A model that cannot be
fitted is a row with ``converged = false`` and nulls.

BLUPs are a column expression on the per-entity table of step 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.functions import special as S
from wavepanel.operators.clean import as_numbers
from wavepanel.operators.derive import stars
from wavepanel.operators.sizing import bounded
from wavepanel.session import write_shared

_LOG2PI = math.log(2 * math.pi)


# --------------------------------------------------------------------------
# design
# --------------------------------------------------------------------------

def factor_level_counts(df: DataFrame, cols: list[str], max_levels: int = 1000) -> dict[str, list[tuple]]:
    """Levels and their row counts for every factor, from one aggregate over
    the unpivoted factor columns (bounded by the total number of levels)."""
    if not cols:
        return {}
    cells = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("factor"), F.col(c).cast("string").alias("level")) for c in cols])).alias("c"))
    rows = (cells.select("c.*").where(F.col("level").isNotNull())
                 .groupBy("factor", "level").count().limit(max_levels * len(cols) + 1).collect())
    if len(rows) > max_levels * len(cols):
        raise ValueError("too many factor levels")
    out: dict[str, list[tuple]] = {c: [] for c in cols}
    for r in rows:
        out[r["factor"]].append((r["level"], r["count"]))
    return {c: sorted(v) for c, v in out.items()}


@dataclass
class Design:
    terms: list[str]
    exprs: list[Column]
    centres: np.ndarray      # subtracted from each column of [X y]
    slope_centre: float = 0.0
    slope_scale: float = 1.0


def build_design(df: DataFrame, fixed: list[str], factors: dict[str, object] | None, outcome: str | None = None,
                 slope: str | None = None, every_row: DataFrame | None = None) -> Design:
    """Intercept, treatment-coded factors (reference level omitted; MOD2,
    PRJ18) and numeric covariates, in that order. A factor's reference may be
    a level, ``'mode'`` (most frequent in ``every_row``, smallest on ties; AGG19) or
    ``'first'`` (alphabetical)."""
    terms, exprs = ["Intercept"], [F.lit(1.0)]
    counts = factor_level_counts(df, list((factors or {}).keys()))
    modes = [c for c, ref in (factors or {}).items() if ref == "mode"]
    all_counts = factor_level_counts(every_row, modes) if every_row is not None else counts
    for col, ref in (factors or {}).items():
        levels = [lv for lv, _ in counts[col]]
        if ref == "mode" and levels:
            ref = min(all_counts[col], key=lambda t: (-t[1], t[0]))[0]
        elif (ref == "first" or ref is None) and levels:
            ref = levels[0]
        for lv in levels:
            if lv == str(ref):
                continue
            terms.append(f"{col}[T.{lv}]")
            exprs.append(F.when(F.col(col).cast("string") == F.lit(lv), 1.0).otherwise(0.0))
    n_coded = len(terms)
    numeric = [*fixed, *([outcome] if outcome else [])]
    for c in fixed:
        terms.append(c)
        exprs.append(F.col(c).cast("double"))
    aggs = [F.avg(F.col(c).cast("double")) for c in numeric]
    if slope:
        aggs += [F.avg(F.col(slope).cast("double")), F.stddev_pop(F.col(slope).cast("double"))]
    row = [v if v is not None else 0.0 for v in df.agg(*aggs).first()] if aggs else []
    centres = np.array([0.0] * n_coded + row[:len(numeric)])
    if not slope:
        return Design(terms, exprs, centres)
    # a whole number, so that whole visit numbers stay exact and entities with the same visits share a pattern
    return Design(terms, exprs, centres, float(round(row[-2])), row[-1] if row[-1] > 0 else 1.0)


# --------------------------------------------------------------------------
# distributed sufficient statistics
# --------------------------------------------------------------------------

def _rows(base, outcome, design, entity, slope, model):
    cols = [(F.col(model).cast("string") if model else F.lit("model")).alias("__model"), F.col(entity).alias("__entity"),
            (F.col(slope).cast("double") - design.slope_centre if slope else F.lit(0.0)).alias("__v")]
    exprs = [*design.exprs, F.col(outcome).cast("double")]
    cols += [(e - float(c) if c else e).alias(f"__x{k}") for k, (e, c) in enumerate(zip(exprs, design.centres))]
    return base.select(*cols)


def entity_stats(rows: DataFrame, P: int, q: int) -> DataFrame:
    """Step 1: per (model, entity) sums; P = number of columns of [X y]."""
    x = [F.col(f"__x{k}") for k in range(P)]
    v = F.col("__v")
    aggs = [F.count(F.lit(1)).alias("n_i"), F.sum(v).alias("sv"), F.sum(v * v).alias("svv")]
    aggs += [F.sum(x[k]).alias(f"a0_{k}") for k in range(P)]
    if q == 2:
        aggs += [F.sum(v * x[k]).alias(f"a1_{k}") for k in range(P)]
    aggs += [F.sum(x[k] * x[m]).alias(f"xx_{k}_{m}") for k in range(P) for m in range(k, P)]
    return rows.groupBy("__model", "__entity").agg(*aggs)


def pattern_stats(ent: DataFrame, P: int, q: int) -> DataFrame:
    """Step 2: per (model, n_i, sum v, sum v^2) sums of outer products of A_i."""
    def a(r, k):
        return F.col(f"a{r}_{k}")
    aggs = [F.count(F.lit(1)).alias("c")]
    aggs += [F.sum(f"xx_{k}_{m}").alias(f"xx_{k}_{m}") for k in range(P) for m in range(k, P)]
    aggs += [F.sum(a(0, k) * a(0, m)).alias(f"s00_{k}_{m}") for k in range(P) for m in range(k, P)]
    if q == 2:
        aggs += [F.sum(a(0, k) * a(1, m)).alias(f"s01_{k}_{m}") for k in range(P) for m in range(P)]
        aggs += [F.sum(a(1, k) * a(1, m)).alias(f"s11_{k}_{m}") for k in range(P) for m in range(k, P)]
    return ent.groupBy("__model", "n_i", "sv", "svv").agg(*aggs)


@dataclass
class _Patterns:
    c: np.ndarray        # (J,)
    ztz: np.ndarray      # (J, q, q)
    s: np.ndarray        # (J, q, q, P, P)
    xx: np.ndarray       # (P, P)
    n_i: np.ndarray      # (J,) group sizes


def _assemble(pdf, P: int, q: int) -> _Patterns:
    """Pattern table (pandas, fetched through Arrow) -> numpy arrays."""
    J = len(pdf)
    c = pdf["c"].to_numpy(dtype=float)
    n_i = pdf["n_i"].to_numpy(dtype=float)
    ztz = np.zeros((J, q, q))
    ztz[:, 0, 0] = n_i
    if q == 2:
        ztz[:, 0, 1] = ztz[:, 1, 0] = pdf["sv"].to_numpy(dtype=float)
        ztz[:, 1, 1] = pdf["svv"].to_numpy(dtype=float)
    iu = [(k, m) for k in range(P) for m in range(k, P)]

    def sym(prefix):
        vals = pdf[[f"{prefix}_{k}_{m}" for k, m in iu]].to_numpy(dtype=float)
        out = np.zeros((J, P, P))
        ks, ms = np.array([k for k, _ in iu]), np.array([m for _, m in iu])
        out[:, ks, ms] = vals
        out[:, ms, ks] = vals
        return out

    s = np.zeros((J, q, q, P, P))
    s[:, 0, 0] = sym("s00")
    if q == 2:
        s[:, 1, 1] = sym("s11")
        full = pdf[[f"s01_{k}_{m}" for k in range(P) for m in range(P)]].to_numpy(dtype=float).reshape(J, P, P)
        s[:, 0, 1] = full
        s[:, 1, 0] = np.transpose(full, (0, 2, 1))
    xx = sym("xx").sum(axis=0)
    return _Patterns(c, ztz, s, xx, n_i)


# --------------------------------------------------------------------------
# REML criterion from sums, and its minimum
# --------------------------------------------------------------------------

def _gamma(theta: np.ndarray, q: int, scale: float = 1.0) -> np.ndarray:
    """G = L L'; ``scale`` is the spread of the slope variable, which makes the parameters alike in size."""
    if q == 1:
        return np.array([[theta[0] ** 2]])
    L = np.array([[theta[0], 0.0], [theta[1] / scale, theta[2] / scale]])
    return L @ L.T


def _cholesky_parameters(gam: np.ndarray) -> np.ndarray:
    """theta with ``_gamma(theta) = gam`` (also for a singular G)."""
    l00 = math.sqrt(max(gam[0, 0], 0.0))
    if len(gam) == 1:
        return np.array([l00])
    l10 = gam[0, 1] / l00 if l00 > 0 else 0.0
    return np.array([l00, l10, math.sqrt(max(gam[1, 1] - l10 ** 2, 0.0))])


def _weights(gam: np.ndarray, n, sv, svv):
    """|M_i| and the entries of G M_i^-1 for arrays of Z'Z entries."""
    if len(gam) == 1:
        det = 1.0 + n * gam[0, 0]
        return det, [[gam[0, 0] / det]]
    g00, g01, g11 = gam[0, 0], gam[0, 1], gam[1, 1]
    m00, m01 = 1 + n * g00 + sv * g01, n * g01 + sv * g11
    m10, m11 = sv * g00 + svv * g01, 1 + sv * g01 + svv * g11
    det = m00 * m11 - m01 * m10
    return det, [[(g00 * m11 - g01 * m10) / det, (g01 * m00 - g00 * m01) / det],
                 [(g01 * m11 - g11 * m10) / det, (g11 * m00 - g01 * m01) / det]]


def _pattern_sums(pat: _Patterns, gam: np.ndarray):
    """Sum of log|M_i|, smallest |M_i| and sum of A_i' G M_i^-1 A_i, from the pattern table."""
    q = len(gam)
    sv, svv = (pat.ztz[:, 0, 1], pat.ztz[:, 1, 1]) if q == 2 else (0.0, 0.0)
    det, w = _weights(gam, pat.n_i, sv, svv)
    if det.min() <= 0:
        return 0.0, float(det.min()), None
    t = sum(np.tensordot(w[a][b], pat.s[:, a, b], axes=1) for a in range(q) for b in range(q))
    return float(pat.c @ np.log(det)), float(det.min()), t


def _entity_sums(ent: DataFrame, asked: dict[str, list[np.ndarray]], P: int, q: int) -> dict:
    """The same sums for the candidates of every model from the entity table:
    one partial sum a task and candidate, added up by Spark. The products of the
    A_i rows are made once for all candidates, whose weights then sum them as one matrix product."""
    upper = np.triu_indices(P)
    k, m = upper
    pairs = [(a, b) for a in range(q) for b in range(a, q)]

    def partial(batches):
        sums: dict = {}
        for batch in batches:
            models = pc.dictionary_encode(batch.column(0))
            which, names = models.indices.to_numpy(zero_copy_only=False), models.dictionary.to_pylist()
            table = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for at, name in enumerate(names):
                part = table[which == at]
                n, sv, svv = part[:, 0], part[:, 1], part[:, 2]
                A = [part[:, 3 + a * P:3 + (a + 1) * P] for a in range(q)]
                # G M^-1 is symmetric, so one weight goes with both cross products
                products = [A[a][:, k] * A[b][:, m] + (A[b][:, k] * A[a][:, m] if a != b else 0.0) for a, b in pairs]
                logs, lows = [], []
                weights = np.empty((len(pairs), len(asked[name]), len(part)))
                with np.errstate(all="ignore"):                             # a candidate without a likelihood
                    for i, gam in enumerate(asked[name]):
                        det, w = _weights(gam, n, sv, svv)
                        lows.append(float(det.min()))
                        logs.append(float(np.log(det).sum()) if lows[i] > 0 else 0.0)
                        for j, (a, b) in enumerate(pairs):
                            weights[j, i] = w[a][b]
                    t = sum(w @ o for w, o in zip(weights, products))
                old = sums.get(name)
                new = (np.array(logs), np.array(lows), t)
                sums[name] = new if old is None else (old[0] + new[0], np.minimum(old[1], new[1]), old[2] + t)
        rows = [(name, i, log[i], low[i], t[i].tolist()) for name, (log, low, t) in sums.items() for i in range(len(log))]
        if rows:
            kinds = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)],
                                             names=["model", "cid", "logdet", "mindet", "t"])

    cols = ["__model", "n_i", "sv", "svv", *[f"a{a}_{k}" for a in range(q) for k in range(P)]]
    parts = ent.filter(F.col("__model").isin(list(asked))).select(*cols).mapInArrow(
        partial, "model string, cid int, logdet double, mindet double, t array<double>")
    rows = parts.groupBy("model", "cid").agg(
        F.sum("logdet").alias("logdet"), F.min("mindet").alias("mindet"),
        *[F.sum(F.col("t")[j]).alias(f"t{j}") for j in range(len(upper[0]))]).collect()
    out = {}
    for r in rows:
        t = np.zeros((P, P))
        t[upper] = [r[f"t{j}"] for j in range(len(upper[0]))]
        out[r["model"], r["cid"]] = (r["logdet"], r["mindet"], t + np.triu(t, 1).T)
    return out


def _independent(xtx: np.ndarray, tol: float = 1e-9) -> list[int]:
    """Columns, first to last, that the ones before them do not determine."""
    d = np.sqrt(np.diag(xtx))
    keep: list[int] = []
    for k in range(len(xtx)):
        if not d[k] > 0:
            continue
        b = xtx[keep, k] / (d[keep] * d[k])
        a = xtx[np.ix_(keep, keep)] / np.outer(d[keep], d[keep])
        if not keep or 1.0 - b @ np.linalg.solve(a, b) > tol:
            keep.append(k)
    return keep


def _profile(sums, xx: np.ndarray, keep: list[int], n_obs: int):
    """(-2 REML loglik, beta, s2, inverse of X'W^-1 X) over the kept columns."""
    failed = (math.inf, None, None, None)
    logdet, low, t = sums
    p = len(keep)
    if low is None or not low > 0 or n_obs <= p:
        return failed
    idx = [*keep, len(xx) - 1]
    g = (xx - t)[np.ix_(idx, idx)]
    d = np.sqrt(np.maximum(np.diag(g)[:p], 0.0))
    if not (d > 0).all():
        return failed
    xwx, xwy = g[:p, :p] / np.outer(d, d), g[:p, p] / d
    if not np.isfinite(xwx).all() or np.linalg.cond(xwx) > 1e12:
        return failed
    low_tri = np.linalg.cholesky((xwx + xwx.T) / 2)
    half = np.linalg.solve(low_tri, xwy)
    r2 = float(g[p, p] - half @ half)
    if not r2 > 0:
        return failed
    s2 = r2 / (n_obs - p)
    root = np.linalg.solve(low_tri, np.eye(p))
    inv = root.T @ root / np.outer(d, d)
    beta = (root.T @ half) / d
    ld = 2 * float(np.log(np.diag(low_tri)).sum() + np.log(d).sum())
    return logdet + ld + (n_obs - p) * (math.log(s2) + _LOG2PI + 1.0), beta, s2, inv


def _search(q: int, max_rounds: int = 40, h: float = 1e-4):
    """Newton steps on the criterion: yields lists of parameters, is sent their
    profiles, returns (parameters, profile, converged). A batch of differences
    gives gradient and Hessian, the next a batch of step lengths. The direction
    uses the sizes of the Hessian's eigenvalues, so it always leads down."""
    sizes = (0.05, 0.3, 1.0, 3.0, 10.0)
    starts = [np.array([a]) for a in sizes] if q == 1 else [np.array([a, 0.0, b * a]) for a in sizes for b in (0.1, 0.5, 1.0)]
    got = yield starts
    at = min(range(len(got)), key=lambda i: got[i][0])
    theta, best = starts[at], got[at]
    eye = np.eye(len(theta))
    pairs = [(i, j) for i in range(len(theta)) for j in range(i + 1, len(theta))]
    for _ in range(max_rounds):
        if not math.isfinite(best[0]):
            return theta, best, False
        got = yield [theta + s * h * e for s in (1, -1) for e in eye] + [theta + h * (eye[i] + eye[j]) for i, j in pairs]
        vals = np.array([g[0] for g in got])
        up, down, both = vals[:len(eye)], vals[len(eye):2 * len(eye)], vals[2 * len(eye):]
        if not np.isfinite(vals).all():
            return theta, best, False
        grad = (up - down) / (2 * h)
        hess = np.diag((up - 2 * best[0] + down) / h ** 2)
        for (i, j), f in zip(pairs, both):
            hess[i, j] = hess[j, i] = (f - up[i] - up[j] + best[0]) / h ** 2
        eig, vec = np.linalg.eigh(hess)
        size = np.maximum(np.abs(eig), 1e-3 * max(1.0, np.abs(eig).max()))
        step = -vec @ ((vec.T @ grad) / size)
        step *= min(1.0, 2.0 * max(1.0, np.linalg.norm(theta)) / max(np.linalg.norm(step), 1e-300))
        lengths = (1.0, 2.0, 4.0, 0.5, 0.25, 0.1, 0.03, 0.01)
        got = yield [theta + a * step for a in lengths]
        at = min(range(len(got)), key=lambda i: got[i][0])
        gain = best[0] - got[at][0]
        if gain > 0:
            theta, best = theta + lengths[at] * step, got[at]
        if gain < 1e-9:
            # nothing left to gain; a steep place without a way down is no minimum
            return theta, best, bool(abs(grad @ step) < 1e-5)
    return theta, best, False


def _fit_all(models: dict, q: int, scale: float, sums_of, given: np.ndarray | None = None) -> dict:
    """Run the searches of all models in step. ``models``: name -> (xx, kept
    columns, rows); ``sums_of`` maps name -> candidate covariances to the sums
    of each (name, place). A ``given`` covariance is taken without a search."""
    if given is not None:
        sums = sums_of({m: [given] for m in models})
        best = {m: _profile(sums[m, 0], *model) for m, model in models.items()}
        return {m: (given, b, b[1] is not None) for m, b in best.items()}
    searches = {m: _search(q) for m in models}
    asked = {m: next(s) for m, s in searches.items()}
    found = {}
    while asked:
        gams = {m: [_gamma(t, q, scale) for t in thetas] for m, thetas in asked.items()}
        sums = sums_of(gams)
        turn = {}
        for m in asked:
            xx, keep, n_obs = models[m]
            try:
                turn[m] = searches[m].send([_profile(sums[m, i], xx, keep, n_obs) for i in range(len(gams[m]))])
            except StopIteration as end:
                theta, best, converged = end.value
                found[m] = (_gamma(theta, q, scale), best, converged)
        asked = turn
    return found


# --------------------------------------------------------------------------
# public API
# --------------------------------------------------------------------------

@dataclass
class LmmResult:
    coefficients: DataFrame
    variance: DataFrame
    fit_stats: DataFrame
    fits: dict = field(repr=False, default_factory=dict)
    terms: list = field(default_factory=list)
    entity_table: DataFrame | None = field(repr=False, default=None)
    q: int = 1

    def blup(self) -> DataFrame:
        """Per (model, entity) predicted random effects (u0[, u1]); null for a model without a fit."""
        return blups(self.entity_table, self.fits, len(self.terms), self.q)


def fit_lmm(df: DataFrame, outcome: str, entity: str, fixed: list[str] | None = None,
            factors: dict[str, object] | None = None, slope: str | None = None,
            model: str | None = None, max_patterns: int = 20_000,
            covariance: list[list[float]] | None = None) -> LmmResult:
    """Fit one LMM per value of ``model`` (or a single model) by REML.

    ``fixed``: numeric covariates; ``factors``: {column: reference level or
    'mode'/'first'}; ``slope``: column of the random slope (None = random
    intercept only). Text in a numeric column is read as a number, null where
    it is none; rows with a null in any used column are dropped (listwise,
    PRJ21), but a factor's mode is that of all rows. ``covariance`` gives the random
    effects' covariance over the residual variance, which is then not searched for.

    ``max_patterns`` bounds the pattern table brought to the driver (about
    4(p+1)^2 doubles a pattern); beyond it each batch of candidates is summed
    over the distributed per-entity table instead, with the same search.
    """
    fixed = list(fixed or [])
    numeric = list(dict.fromkeys([outcome, *fixed, *([slope] if slope else [])]))
    need = [*numeric, entity, *list((factors or {}).keys()), *([model] if model else [])]
    base = as_numbers(df, numeric).dropna(subset=list(dict.fromkeys(need)))
    design = build_design(base, fixed, factors, outcome, slope, df)
    given = None
    if covariance is not None:
        # u0 + u1 v = (u0 + c u1) + u1 (v - c)
        shift = np.array([[1.0]]) if not slope else np.array([[1.0, design.slope_centre], [0.0, 1.0]])
        given = shift @ np.array(covariance, float) @ shift.T
    q, p = 2 if slope else 1, len(design.terms)
    P = p + 1
    # read to count the patterns and then once a batch, or for their sums, so it is kept in the shared folder
    ent = write_shared(entity_stats(_rows(base, outcome, design, entity, slope, model), P, q), "entities")
    if ent.select("__model", "n_i", "sv", "svv").distinct().limit(max_patterns + 1).count() > max_patterns:
        total = _totals(ent, P)
        found = _fit_all({m: t[:3] for m, t in total.items()}, q, design.slope_scale,
                         lambda asked: _entity_sums(ent, asked, P, q), given)
    else:
        pats = pattern_stats(ent, P, q).toPandas()
        tables = {m: _assemble(rs.reset_index(drop=True), P, q) for m, rs in pats.groupby("__model")}
        total = {m: (t.xx, _independent(t.xx[:p, :p]), int(t.c @ t.n_i), int(t.c.sum()), int(t.n_i.min()), int(t.n_i.max()))
                 for m, t in sorted(tables.items())}
        found = _fit_all({m: t[:3] for m, t in total.items()}, q, design.slope_scale,
                         lambda asked: {(m, i): _pattern_sums(tables[m], g) for m, gs in asked.items() for i, g in enumerate(gs)}, given)
    fits = {m: _finish(found[m], t, design, q) for m, t in sorted(total.items())}
    spark = df.sparkSession
    return LmmResult(_coef_table(spark, fits, design.terms), _variance_table(spark, fits, q),
                     _fit_table(spark, fits), fits, design.terms, ent, q)


def _totals(ent: DataFrame, P: int) -> dict:
    """Per model: cross-product of [X y], independent columns, rows, entities, smallest and largest entity."""
    upper = np.triu_indices(P)
    rows = ent.groupBy("__model").agg(
        F.sum("n_i").alias("n_obs"), F.count(F.lit(1)).alias("n_groups"), F.min("n_i").alias("lo"), F.max("n_i").alias("hi"),
        *[F.sum(f"xx_{k}_{m}").alias(f"xx_{k}_{m}") for k, m in zip(*upper)]).collect()
    out = {}
    for r in rows:
        xx = np.zeros((P, P))
        xx[upper] = [r[f"xx_{k}_{m}"] for k, m in zip(*upper)]
        xx = xx + np.triu(xx, 1).T
        out[r["__model"]] = (xx, _independent(xx[:-1, :-1]), int(r["n_obs"]), int(r["n_groups"]), int(r["lo"]), int(r["hi"]))
    return out


def _finish(found, total, design: Design, q: int) -> dict:
    """Estimates for the columns as they came, from those of the centred ones."""
    gam_c, (m2ll, beta_k, s2, inv), converged = found
    xx, keep, n, groups, lo, hi = total
    p = len(design.terms)
    fit = dict(n_obs=n, n_groups=groups, min_group=lo, max_group=hi, mean_group=n / groups, kept=keep, converged=converged,
               m2ll=None, beta=None, beta_centred=None, s2=None, cov=None, gamma=None, gamma_centred=None, theta=None,
               slope_centre=design.slope_centre, r2_marginal=None, r2_conditional=None)
    if beta_k is None:
        return fit
    centred, cov_c = np.zeros(p), np.zeros((p, p))
    centred[keep] = beta_k
    cov_c[np.ix_(keep, keep)] = inv * s2
    # intercept of the columns as they came: the outcome's centre less what the covariates' centres add
    back = np.eye(p)
    back[0, 1:] = -design.centres[1:p]
    beta = back @ centred
    beta[0] += design.centres[p]
    # u0 + u1 (v - c) = (u0 - c u1) + u1 v
    shift = np.array([[1.0]]) if q == 1 else np.array([[1.0, -design.slope_centre], [0.0, 1.0]])
    gam = shift @ gam_c @ shift.T
    # var(X b) with ddof 0; only the random-intercept variance enters the random part (MOD6)
    mean_x = xx[0, :p] / n
    spread = xx[:p, :p] / n - np.outer(mean_x, mean_x)
    var_fixed, re_var = float(centred @ spread @ centred), float(gam[0, 0] * s2)
    tot = var_fixed + re_var + s2
    fit.update(m2ll=m2ll, beta=beta, beta_centred=centred, s2=s2, cov=back @ cov_c @ back.T, gamma=gam, gamma_centred=gam_c,
               theta=_cholesky_parameters(gam), r2_marginal=var_fixed / tot, r2_conditional=(var_fixed + re_var) / tot)
    return fit


def _coef_table(spark, fits, terms) -> DataFrame:
    rows = []
    for m, f in fits.items():
        for k, t in enumerate(terms):
            if f["beta"] is None or k not in f["kept"]:
                rows.append((m, t, *[None] * 7))
                continue
            b, s = float(f["beta"][k]), math.sqrt(max(float(f["cov"][k, k]), 0.0))
            dof = f["n_obs"] - len(f["kept"])
            z = b / s if s > 0 else None
            p = 2 * S.norm_sf(abs(z)) if z is not None else None
            pt = S.t_two_sided(z, dof) if z is not None and dof > 0 else None
            rows.append((m, t, b, s, z, p, pt, b - 1.959963984540054 * s, b + 1.959963984540054 * s))
    df = spark.createDataFrame(rows, "model string, term string, coef double, se double, z double, p double, "
                                     "p_t double, ci_lo double, ci_hi double")
    return df.withColumn("stars", stars("p"))


def _variance_table(spark, fits, q) -> DataFrame:
    rows = []
    for m, f in fits.items():
        cov = f["gamma"] * f["s2"] if f["gamma"] is not None else None
        at = {"Group Var": (0, 0)} | ({"Group x Slope Cov": (0, 1), "Slope Var": (1, 1)} if q == 2 else {})
        rows += [(m, name, float(cov[ij]) if cov is not None else None) for name, ij in at.items()]
        rows.append((m, "Scale", f["s2"]))
    return spark.createDataFrame(rows, "model string, component string, value double")


def _fit_table(spark, fits) -> DataFrame:
    rows = [(m, f["n_obs"], f["n_groups"], f["min_group"], f["max_group"], float(f["mean_group"]), f["s2"],
             -0.5 * f["m2ll"] if f["m2ll"] is not None else None, bool(f["converged"]), f["r2_marginal"],
             f["r2_conditional"]) for m, f in fits.items()]
    return spark.createDataFrame(rows, "model string, n_obs bigint, n_groups bigint, min_group bigint, "
                                       "max_group bigint, mean_group double, scale double, reml_llf double, "
                                       "converged boolean, r2_marginal double, r2_conditional double")


def blups(ent: DataFrame, fits: dict, p: int, q: int) -> DataFrame:
    """u_i = G M_i^-1 Z_i'(y_i - X_i b) as a column expression per entity
    (q <= 2, closed-form inverse), on the centred sums of the entity table.
    The estimates come from a table of one row a model."""
    fitted = [(m, [float(b) for b in f["beta_centred"]], *[float(f["gamma_centred"][ij]) for ij in ((0, 0), (0, -1), (-1, -1))],
               f["slope_centre"]) for m, f in fits.items() if f["beta"] is not None]
    params = ent.sparkSession.createDataFrame(
        fitted, "__m string, __b array<double>, __g00 double, __g01 double, __g11 double, __c double")
    e = ent.join(bounded(params), F.col("__model") == F.col("__m"), "left")

    def residual(a):
        return F.col(f"a{a}_{p}") - sum((F.col(f"a{a}_{k}") * F.col("__b")[k] for k in range(p)), F.lit(0.0))

    n, sv, svv, g00 = F.col("n_i"), F.col("sv"), F.col("svv"), F.col("__g00")
    if q == 1:
        u0, u1 = g00 * residual(0) / (1 + n * g00), F.lit(0.0)
    else:
        g01, g11 = F.col("__g01"), F.col("__g11")
        r0, r1 = residual(0), residual(1)
        m00, m01 = 1 + n * g00 + sv * g01, n * g01 + sv * g11
        m10, m11 = sv * g00 + svv * g01, 1 + sv * g01 + svv * g11
        det = m00 * m11 - m01 * m10
        u1 = ((g01 * m11 - g11 * m10) * r0 + (g11 * m00 - g01 * m01) * r1) / det
        u0 = ((g00 * m11 - g01 * m10) * r0 + (g01 * m00 - g00 * m01) * r1) / det - F.col("__c") * u1
    return e.select(F.col("__model").alias("model"), F.col("__entity").alias("entity"), u0.alias("u0"), u1.alias("u1"))


def predict_fixed(result: LmmResult, model: str) -> Column:
    """X b as a column expression for one fitted model (MOD7); null for a model without a fit."""
    beta = result.fits[model]["beta"]
    if beta is None:
        return F.lit(None).cast("double")
    expr = F.lit(0.0)
    for k, t in enumerate(result.terms):
        if t == "Intercept":
            term = F.lit(1.0)
        elif "[T." in t:
            col, lv = t.split("[T.", 1)
            term = F.when(F.col(col).cast("string") == F.lit(lv[:-1]), 1.0).otherwise(0.0)
        else:
            term = F.col(t).cast("double")
        expr = expr + term * float(beta[k])
    return expr


def fit_errors(df: DataFrame, result: LmmResult, model: str, outcome: str, entity: str,
               slope: str | None) -> DataFrame:
    """RMSE and MAE of fitted values including the random effects (MOD8):
    per-entity BLUPs joined back to the rows (AQE splits a hot entity)."""
    u = result.blup().filter(F.col("model") == model).select(F.col("entity").alias(entity), "u0", "u1")
    cols = [outcome, *[t for t in result.terms if t != "Intercept" and "[T." not in t]]
    cols += [t.split("[T.", 1)[0] for t in result.terms if "[T." in t]
    cols = list(dict.fromkeys(cols + ([slope] if slope else [])))
    base = as_numbers(df, [c for c in cols if c in (outcome, slope, *result.terms)]).dropna(subset=cols)
    fitted = predict_fixed(result, model) + F.col("u0") + (F.col("u1") * F.col(slope) if slope else F.lit(0.0))
    j = base.join(u, entity, "inner").withColumn("__res", F.col(outcome) - fitted)
    return j.agg(F.sqrt(F.avg(F.col("__res") ** 2)).alias("rmse"), F.avg(F.abs("__res")).alias("mae"),
                 F.count(F.lit(1)).alias("n")).select(F.lit(model).alias("model"), "*")


def marginal_residuals(df: DataFrame, result: LmmResult, model: str, outcome: str) -> DataFrame:
    """Fixed-effects prediction and marginal residual per row (MOD7)."""
    pred = predict_fixed(result, model)
    return df.select("*", pred.alias("fitted"), (F.col(outcome) - pred).alias("residual"))


__all__ = ["fit_lmm", "LmmResult", "blups", "fit_errors", "marginal_residuals", "predict_fixed",
           "build_design", "entity_stats", "pattern_stats"]
