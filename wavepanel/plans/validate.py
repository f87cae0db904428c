"""Named check registry: ``validate(df, variables, checks)``
returns one result DataFrame per requested check. Unknown names are reported
in ``skipped`` rather than silently ignored, and a failing check raises
(the reference swallowed errors). Correlations and series tests read text
columns as numbers, null where they are none (PRJ4); distributions profile
them as categories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wavepanel.operators import correlate as C
from wavepanel.operators import describe as D
from wavepanel.operators import hypothesis as H
from wavepanel.operators import series as SR
from wavepanel.operators.clean import as_numbers
from wavepanel.session import write_shared


def _numeric(df: DataFrame, cols: list[str]) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [c for c in cols if isinstance(df.schema[c].dataType, num)]


def _distributions(df, variables, **kw):
    num = _numeric(df, variables)
    cat = [c for c in variables if c not in num]
    out = {}
    if num:
        out["numeric"] = H.numeric_profile(df, num)
        out["shapiro"] = H.shapiro_wilk(D.long_values(df, num))
    if cat:
        out["categorical"] = D.categorical_profile(df, cat)
    return out


def _group_sizes(df, variables, **kw):
    return {"group_sizes": D.group_sizes(df, kw.get("groups") or variables)}


def _multicollinearity(df, variables, **kw):
    corr = C.corr_long(df, variables)
    return {"correlation": corr, "high_pairs": C.high_pairs(corr), "vif": C.vif(df, variables)}


def _series(prefixes: tuple[str, ...]):
    """The columns of the series tests whose names start with one of ``prefixes``, per variable."""
    def check(df, variables, **kw):
        parts = kw["shared"].get("series")
        if parts is None:                          # both kinds of check read the same tests
            numbers = as_numbers(df, variables)
            parts = kw["shared"]["series"] = {
                v: write_shared(SR.series_tests(numbers, kw["series"], kw["order"], v), "series-tests") for v in variables}
        return {v: t.select("series", "n", *[c for c in t.columns if c.startswith(prefixes)]) for v, t in parts.items()}
    return check


CHECKS: dict[str, Callable[..., dict[str, DataFrame]]] = {
    "distributions": _distributions,
    "group_sizes": _group_sizes,
    "multicollinearity": _multicollinearity,
    "stationarity": _series(("adf_", "kpss_")),
    "heteroscedasticity": _series(("arch_",)),
}


def validate(df: DataFrame, variables: list[str], checks: list[str], **kw) -> dict[str, DataFrame]:
    """Run the named checks; returns {"check.table": DataFrame, ...} plus a
    ``skipped`` list of unknown check names under key ``"skipped"``."""
    results: dict = {}
    skipped = []
    kw = {**kw, "shared": {}}
    for name in checks:
        fn = CHECKS.get(name)
        if fn is None:
            skipped.append(name)
            continue
        for table, frame in fn(df, variables, **kw).items():
            results[f"{name}.{table}"] = frame
    results["skipped"] = skipped
    return results
