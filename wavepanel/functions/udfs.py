"""Arrow-batched helpers for the few distribution functions Spark lacks
(normal tail and quantile, chi-square tail). What is applied to data rows works
on whole arrays; the rest gets one statistic per variable, model or series.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf

from wavepanel.functions import special as S

#: Ranks evaluated at a time, and the most that one row may stand for.
RANKS_AT_ONCE = 1_000_000


def _apply(fn, *cols: pd.Series) -> pd.Series:
    out = np.full(len(cols[0]), np.nan)
    arrs = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
    for i in range(len(out)):
        args = [a[i] for a in arrs]
        if not any(np.isnan(args)):
            out[i] = fn(*args)
    s = pd.Series(out)
    return s.where(~np.isnan(s), None)


def _sf(x: pd.Series) -> pd.Series:
    return _apply(S.norm_sf, x)


def _log_tail(x: pd.Series) -> pd.Series:
    log = S.upper_tail(x.to_numpy(dtype=float, na_value=np.nan))[1]
    return pd.Series(log).where(~np.isnan(log), None)


def _order_sums(first: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the expected normal order statistics of ranks first .. first + count - 1 of n, and of their squares."""
    first, count, n = (s.to_numpy(dtype=np.int64) for s in (first, count, n))
    m, mm = np.zeros(len(n)), np.zeros(len(n))
    ends = np.cumsum(count)
    at = 0
    while at < len(n):
        # as many rows as hold about a million ranks
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RANKS_AT_ONCE, side="right")))
        c = count[at:to]
        row = np.repeat(np.arange(to - at), c)
        rank = np.repeat(first[at:to] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        q = S.normal_quantile((rank - 0.375) / (n[at:to][row] + 0.25))
        m[at:to], mm[at:to] = np.bincount(row, q, to - at), np.bincount(row, q * q, to - at)
        at = to
    return pd.DataFrame({"m": m, "mm": mm})


def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _apply(S.chi2_sf, x, df)


# The UDF wrappers are built on the driver when first used: a module-level
# decorator would run again when a Python worker imports this module, where
# no session exists.
@functools.cache
def _udf(fn, returns="double"):
    return pandas_udf(fn, returns)


def norm_sf(x):
    return _udf(_sf)(x)


def log_upper_tail(x):
    """log P(Z > x)."""
    return _udf(_log_tail)(x)


def order_sums(first, count, n):
    return _udf(_order_sums, "m double, mm double")(first, count, n)


def chi2_sf(x, df):
    return _udf(_chi2)(x, df)
