"""DuckDB SQL for mixed models: generalised least squares from per-entity sums.

Written from the model alone, apart from the fit's own code: for a covariance G
of the random effects (over the residual variance), X'W^-1 X and X'W^-1 y come
from cross products and per-entity sums (Woodbury), and a sweep of the augmented
matrix, one column a recursion step, gives coefficients, inverse, residual sum
of squares and determinant. With a random intercept only, G is one number g,
which is searched for on two grids and the vertex of a parabola; with a slope, G is given.
"""

from __future__ import annotations


def _sweep(name: str, source: str, p: int) -> str:
    """``source`` (g, ld, m) -> ``name`` (g, ld, m): the first p columns swept, their pivots' logarithms added to ld."""
    size = p + 1
    cell = ("CASE WHEN i = k AND j = k THEN -1 / m[k][k] WHEN i = k THEN m[k][j] / m[k][k] WHEN j = k THEN m[i][k] / m[k][k] "
            "ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END")
    step = f"list_transform(range(1, {size + 1}), lambda i: list_transform(range(1, {size + 1}), lambda j: {cell}))"
    return (f"{name}_steps AS (SELECT g, CAST(1 AS BIGINT) AS k, m, ld FROM {source} UNION ALL "
            f"SELECT g, k + 1, {step}, ld + ln(m[k][k]) FROM {name}_steps WHERE k <= {p}),\n"
            f"{name} AS (SELECT g, m, ld FROM {name}_steps WHERE k = {p + 1})")


def _matrix(cells: str) -> str:
    return f"SELECT g, ld, list(r ORDER BY i) AS m FROM (SELECT g, ld, i, list(v ORDER BY j) AS r FROM ({cells}) GROUP BY g, ld, i) GROUP BY g, ld"


def _sums(panel: str, outcome: str, terms: dict[str, str], slope: str | None, where: str) -> list[str]:
    p = len(terms)
    index = f"(SELECT unnest(range(1, {p + 2})) AS i)"
    return [
        f"panel AS ({panel})",
        f"base AS MATERIALIZED (SELECT *, CAST({outcome} AS DOUBLE) AS y, CAST({slope or '0'} AS DOUBLE) AS v, "
        f"[{', '.join(f'CAST({e} AS DOUBLE)' for e in terms.values())}, CAST({outcome} AS DOUBLE)] AS z FROM panel WHERE {where})",
        f"cells AS MATERIALIZED (SELECT entity_id, i, sum(z[i]) AS a0, sum(v * z[i]) AS a1, count(*) AS n, sum(v) AS sv, sum(v * v) AS svv "
        f"FROM base, {index} GROUP BY entity_id, i)",
        f"xx AS MATERIALIZED (SELECT a.i, b.i AS j, sum(z[a.i] * z[b.i]) AS v FROM base, {index} AS a, {index} AS b GROUP BY a.i, b.i)",
        f"size AS (SELECT count(*) AS n_obs, count(DISTINCT entity_id) AS n_groups, CAST({p} AS BIGINT) AS p FROM base)"]


CRITERION = "ld + (n_obs - p) * (ln(m[p + 1][p + 1] / (n_obs - p)) + ln(2 * pi()) + 1)"


def _fit(g: str) -> str:
    """The CTE ``fit`` from a swept matrix ``done`` (one row)."""
    return (f"fit AS MATERIALIZED (SELECT {g}, size.*, m, m[p + 1][p + 1] / (n_obs - p) AS s2, {CRITERION} AS m2ll, "
            "list_transform(range(1, p + 1), lambda i: m[i][p + 1]) AS beta, "
            "list_transform(range(1, p + 1), lambda i: -m[i][i]) AS inv FROM done, size)")


def intercept_model(panel: str, outcome: str, terms: dict[str, str], where: str) -> list[str]:
    """CTEs up to ``fit`` (g00, beta, inv, s2, m2ll, ...): random intercept by REML."""
    p = len(terms)
    at = "SELECT gs.g, i, j, l.ld, xx.v - coalesce(t.v, 0) AS v FROM {gs} AS gs CROSS JOIN xx JOIN ({l}) AS l USING (g) JOIN ({t}) AS t USING (g, i, j)"

    def level(name: str, grid: str) -> list[str]:
        log = f"SELECT g, sum(c * ln(1 + n * g)) AS ld FROM {name}_grid, counts GROUP BY g"
        less = f"SELECT g, i, j, sum(g / (1 + n * g) * v) AS v FROM {name}_grid, pats GROUP BY g, i, j"
        return [f"{name}_grid AS MATERIALIZED ({grid})",
                f"{name}_m AS MATERIALIZED ({_matrix(at.format(gs=name + '_grid', l=log, t=less))})", _sweep(name, f"{name}_m", p)]

    return [
        *_sums(panel, outcome, terms, None, where),
        "pats AS MATERIALIZED (SELECT a.n, a.i, b.i AS j, sum(a.a0 * b.a0) AS v FROM cells AS a JOIN cells AS b "
        "ON a.entity_id = b.entity_id GROUP BY ALL)",
        "counts AS MATERIALIZED (SELECT n, count(*) AS c FROM cells WHERE i = 1 GROUP BY n)",
        *level("far", "SELECT 0.0::DOUBLE AS g UNION ALL SELECT pow(10, e / 20.0) FROM (SELECT unnest(range(-120, 61)) AS e)"),
        f"best AS MATERIALIZED (SELECT g FROM far, size ORDER BY {CRITERION}, g LIMIT 1)",
        *level("near", "SELECT DISTINCT g * pow(10, e / 1000.0) AS g FROM best, (SELECT unnest(range(-60, 61)) AS e)"),
        f"ranked AS MATERIALIZED (SELECT g, {CRITERION} AS f, row_number() OVER (ORDER BY g) AS at FROM near, size)",
        "low AS MATERIALIZED (SELECT * FROM ranked ORDER BY f, g LIMIT 1)",
        # vertex of the parabola through the best point and those five steps beside it
        "top AS MATERIALIZED (SELECT CASE WHEN a.f IS NULL OR c.f IS NULL OR a.f - 2 * b.f + c.f <= 0 THEN b.g "
        "ELSE b.g * pow(10, 0.005 * 0.5 * (a.f - c.f) / (a.f - 2 * b.f + c.f)) END AS g "
        "FROM low AS b LEFT JOIN ranked AS a ON a.at = b.at - 5 LEFT JOIN ranked AS c ON c.at = b.at + 5)",
        *level("done", "SELECT g FROM top"),
        _fit("g AS g00")]


def slope_model(panel: str, outcome: str, terms: dict[str, str], slope: str, where: str, g: list[list[float]]) -> list[str]:
    """CTEs up to ``fit`` and ``ent`` (weights of each entity) for a given G of intercept and slope."""
    (g00, g01), (_, g11) = g
    return [
        *_sums(panel, outcome, terms, slope, where),
        f"ent AS MATERIALIZED (SELECT entity_id, det, ({g00} * m11 - {g01} * m10) / det AS w00, ({g01} * m00 - {g00} * m01) / det AS w01, "
        f"({g11} * m00 - {g01} * m01) / det AS w11 FROM (SELECT *, m00 * m11 - m01 * m10 AS det FROM (SELECT entity_id, "
        f"1 + n * {g00} + sv * {g01} AS m00, n * {g01} + sv * {g11} AS m01, sv * {g00} + svv * {g01} AS m10, "
        f"1 + sv * {g01} + svv * {g11} AS m11 FROM cells WHERE i = 1)))",
        "less AS MATERIALIZED (SELECT a.i, b.i AS j, sum(w00 * a.a0 * b.a0 + w01 * (a.a0 * b.a1 + a.a1 * b.a0) + w11 * a.a1 * b.a1) AS v "
        "FROM cells AS a JOIN cells AS b ON a.entity_id = b.entity_id JOIN ent ON ent.entity_id = a.entity_id GROUP BY a.i, b.i)",
        "given AS MATERIALIZED (" + _matrix("SELECT 0.0::DOUBLE AS g, i, j, (SELECT sum(ln(det)) FROM ent) AS ld, xx.v - less.v AS v "
                                            "FROM xx JOIN less USING (i, j)") + ")",
        _sweep("done", "given", len(terms)),
        _fit(f"{g00}::DOUBLE AS g00")]


#: Random effects of each entity: (entity_id, u0, u1).
INTERCEPT_EFFECTS = """effects AS MATERIALIZED (SELECT entity_id, g00 / (1 + any_value(n) * g00) * sum(a0 * CASE WHEN i = p + 1 THEN 1 ELSE -beta[i] END) AS u0,
       0.0::DOUBLE AS u1 FROM cells, fit GROUP BY entity_id, g00)"""
SLOPE_EFFECTS = """effects AS MATERIALIZED (SELECT entity_id, w00 * r0 + w01 * r1 AS u0, w01 * r0 + w11 * r1 AS u1 FROM ent JOIN (
       SELECT entity_id, sum(a0 * CASE WHEN i = p + 1 THEN 1 ELSE -beta[i] END) AS r0,
              sum(a1 * CASE WHEN i = p + 1 THEN 1 ELSE -beta[i] END) AS r1 FROM cells, fit GROUP BY entity_id) USING (entity_id))"""
#: Two-sided normal p by the series of the error function.
NORMAL_P = ("CASE WHEN abs(z) > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda k: "
            "CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * pow(abs(z) / sqrt(2), 2 * k + 1) / (gamma(k + 1) * (2 * k + 1)))) END")
FITTED = "list_sum(list_transform(range(1, p + 1), lambda i: z[i] * beta[i]))"


def coefficients(terms: dict[str, str], digits: int = 4) -> str:
    """term, coef, se, z, p, ci_lo, ci_hi, stars of ``fit``."""
    names = "[" + ", ".join(f"'{t}'" for t in terms) + "]"
    r = lambda e, d=digits: f"round({e}, {d}) + 0.0"
    return (f"SELECT term, {r('b')} AS coef, {r('se')} AS se, {r('z', 3)} AS z, {r('p')} AS p, {r('b - 1.959963984540054 * se')} AS ci_lo, "
            f"{r('b + 1.959963984540054 * se')} AS ci_hi, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' "
            f"ELSE '' END AS stars FROM (SELECT *, {NORMAL_P} AS p FROM (SELECT *, b / se AS z FROM (SELECT {names}[k] AS term, beta[k] AS b, "
            "sqrt(inv[k] * s2) AS se FROM fit, (SELECT unnest(range(1, p0 + 1)) AS k FROM (SELECT p AS p0 FROM fit)))))")


FIT_STATS = f"""SELECT n_obs, n_groups, round(s2, 4) AS scale, round(-0.5 * m2ll, 3) AS reml_llf,
       round(f / (f + g00 * s2 + s2), 5) AS r2_marginal, round((f + g00 * s2) / (f + g00 * s2 + s2), 5) AS r2_conditional
FROM fit, (SELECT var_pop({FITTED}) AS f FROM base, fit)"""
ERRORS = f"""SELECT 'model' AS model, round(sqrt(avg(e * e)), 5) AS rmse, round(avg(abs(e)), 5) AS mae, count(*) AS n
FROM (SELECT y - {FITTED} - u0 - u1 * v AS e FROM base JOIN effects USING (entity_id), fit)"""


def query(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body
