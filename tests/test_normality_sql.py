"""The SQL twins of the normality tests against the standard library's normal distribution."""

import math
from statistics import NormalDist

import duckdb
import pytest

from wavepanel.plans.normality_sql import normal_cdf, normal_quantile


@pytest.mark.parametrize("p", [1e-12, 1e-5, 0.01, 0.075, 0.3, 0.5, 0.7, 0.925, 0.97, 0.99999, 1 - 1e-9])
def test_quantile(p):
    got = duckdb.connect().execute(f"SELECT {normal_quantile('p')} FROM (SELECT CAST({p!r} AS DOUBLE) AS p)").fetchone()[0]
    assert math.isclose(got, NormalDist().inv_cdf(p), rel_tol=1e-14, abs_tol=1e-15)


@pytest.mark.parametrize("z", [-30.0, -6.0, -1.0, -1e-13, 0.0, 0.2, 3.0, 5.0, 11.0, 30.0])
def test_integral(z):
    got = duckdb.connect().execute(f"SELECT {normal_cdf('z')} FROM (SELECT CAST({z!r} AS DOUBLE) AS z)").fetchone()[0]
    assert abs(got - NormalDist().cdf(z)) < 1e-12
