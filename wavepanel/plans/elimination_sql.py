"""Quadratic forms d' A^-1 d as plain SQL, for the oracles of COR6 and TST6.

The symmetric matrix is eliminated one pivot a SELECT; what is left of d at each
pivot gives one square of the sum. The library takes pseudo-inverses instead.
"""

from __future__ import annotations


def quadratic_form(inner: str, matrix: dict[tuple[int, int], str], vector: dict[int, str], name: str) -> str:
    """``inner`` with the column ``name``. ``matrix`` has the column of each pair (i, j), i <= j."""
    left, sql = sorted(vector), inner
    a, d, squares = dict(matrix), dict(vector), []
    while left:
        i, *left = left
        squares.append(f"{d[i]} * {d[i]} / {a[i, i]}")
        fresh = [(f"{a[j, k]} - {a[i, j]} * {a[i, k]} / {a[i, i]}", f"{name}_a{i}_{j}_{k}", j, k) for j in left for k in left if j <= k]
        ends = [(f"{d[j]} - {a[i, j]} * {d[i]} / {a[i, i]}", f"{name}_d{i}_{j}", j) for j in left]
        if left:
            sql = f"SELECT *, {', '.join(f'{e} AS {c}' for e, c, *_ in (*fresh, *ends))} FROM ({sql})"
        a |= {(j, k): c for _, c, j, k in fresh}
        d |= {j: c for _, c, j in ends}
    return f"SELECT *, {' + '.join(squares) or '0.0'} AS {name} FROM ({sql})"


def chi2_tail(x: str, dof: str) -> str:
    """SQL of the upper tail of chi-square: 1 less the series of the lower incomplete gamma function."""
    half = f"({x} / 2)"
    term = f"exp(({dof} / 2.0 + k) * ln{half} - {half} - lgamma({dof} / 2.0 + k + 1))"
    return f"(1 - list_sum(list_transform(range(2000), lambda k: {term})))"


def vif_sql(cols: list[str], source: str) -> str:
    """(variable, vif, n): (X'X)_jj (X'X)^-1_jj over the complete rows of ``source``."""
    p = range(len(cols))
    cells = {(i, j): f"g_{i}_{j}" for i in p for j in p if i <= j}
    sums = ", ".join(f"sum(CAST({cols[i]} AS DOUBLE) * {cols[j]}) AS {c}" for (i, j), c in cells.items())
    gram = f"SELECT {sums}, count(*) AS n, 0.0 AS zero, 1.0 AS one FROM {source} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}"
    return "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, g_{j}_{j} * q AS vif, n FROM ({quadratic_form(gram, cells, {i: 'one' if i == j else 'zero' for i in p}, 'q')})"
        for j, c in enumerate(cols))


def little_sql(cols: list[str], source: str) -> str:
    """(d2, dof, p, n_patterns, verdict) of Little's test, each pattern's observed columns eliminated on their own."""
    p = range(len(cols))
    stats = ", ".join([f"avg({c}) AS mu_{i}" for i, c in enumerate(cols)] +
                      [f"covar_samp({cols[i]}, {cols[j]}) AS s_{i}_{j}" for i in p for j in p if i <= j])
    means = ", ".join(f"avg({c}) - any_value(mu_{i}) AS d_{i}" for i, c in enumerate(cols))
    covariances = ", ".join(f"any_value(s_{i}_{j}) AS s_{i}_{j}" for i in p for j in p if i <= j)
    parts = []
    for pattern in range(1 << len(cols)):
        seen = [i for i in p if pattern >> i & 1]
        where = " AND ".join(f"{c} IS {'NOT ' if i in seen else ''}NULL" for i, c in enumerate(cols))
        rows = f"SELECT count(*) AS n, {means}, {covariances} FROM {source}, (SELECT {stats} FROM {source}) WHERE {where} HAVING count(*) > 0"
        form = quadratic_form(rows, {(i, j): f"s_{i}_{j}" for i in seen for j in seen if i <= j}, {i: f"d_{i}" for i in seen}, "q")
        parts.append(f"SELECT n * q AS d2, {len(seen)} AS k FROM ({form})")
    total = f"SELECT sum(d2) AS d2, CAST(sum(k) - {len(cols)} AS BIGINT) AS dof, count(*) AS n_patterns FROM ({' UNION ALL '.join(parts)})"
    return f"""SELECT round(d2, 6) AS d2, dof, round(greatest(p, 0), 6) + 0.0 AS p, n_patterns, CASE WHEN p > 0.05 THEN 'MCAR' ELSE 'not MCAR' END AS verdict
FROM (SELECT *, {chi2_tail("d2", "dof")} AS p FROM ({total}))"""
