"""Normality tests as plain SQL, for the oracles of TST2, TST3 and TST4.

The library ranks distinct values and sums the weights of their ranks in
Arrow batches; here every row has its rank and its own normal score. The normal
quantile is the rational approximation AS 241 and the normal integral its power
series, neither of which the library uses.
"""

from __future__ import annotations

# Fixed values of algorithm AS 241 (PPND16): numerator and denominator, lowest power
# first, for the centre, the near tail and the far tail.
CENTRE = ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
           4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
          (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
           2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3))
NEAR = ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
         1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
         1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
FAR = ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
        2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
       (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
        7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))
#: Terms of the power series, enough for |z| < 12.
TERMS = 400


def _ratio(parts: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    def horner(c: tuple[float, ...]) -> str:
        out = f"CAST({c[-1]!r} AS DOUBLE)"
        for a in reversed(c[:-1]):
            out = f"({out} * {x} + CAST({a!r} AS DOUBLE))"
        return out
    return f"({horner(parts[0])} / {horner(parts[1])})"


def normal_quantile(p: str) -> str:
    """SQL of the normal quantile of column ``p``."""
    tail = f"sqrt(-ln(least({p}, 1 - {p})))"
    return (f"(CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {_ratio(CENTRE, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} "
            f"ELSE sign({p} - 0.5) * (CASE WHEN {tail} <= 5 THEN {_ratio(NEAR, f'({tail} - 1.6)')} ELSE {_ratio(FAR, f'({tail} - 5)')} END) END)")


def normal_cdf(z: str) -> str:
    """SQL of the normal integral up to column ``z``: 1/2 plus the density times z + z^3/3 + z^5/(3*5) + ..."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - k * ln(2) - lgamma(k + 1.5) + lgamma(1.5))"
    series = f"list_sum(list_transform(range({TERMS}), lambda k: {term}))"
    return (f"(CASE WHEN abs({z}) < 1e-12 THEN 0.5 WHEN abs({z}) >= 12 THEN (sign({z}) + 1) / 2 "
            f"ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {series} END)")


def _poly(c: list[float], x: str) -> str:
    return " + ".join(f"({a!r}) * power({x}, {i})" for i, a in enumerate(c))


def shapiro_sql(cells: str) -> str:
    """W and p of every variable of ``cells`` (variable, value), more than 11 values each
    (Royston's published polynomials)."""
    m = normal_quantile("p")
    return f"""
SELECT variable, n, round(w, 6) AS w, round(greatest(1 - {normal_cdf("z")}, 0), 6) + 0.0 AS sw_p FROM (
  SELECT variable, n, w, (ln(1 - w) - ({_poly([-1.5861, -0.31082, -0.083751, 0.0038915], "ln(n)")}))
                         / exp({_poly([-0.4803, -0.082676, 0.0030302], "ln(n)")}) AS z FROM (
    SELECT c.variable, any_value(c.n) AS n, power(sum(value * CASE
        WHEN i = c.n THEN last1 WHEN i = 1 THEN -last1 WHEN i = c.n - 1 THEN last2 WHEN i = 2 THEN -last2
        ELSE m / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * last1 * last1 - 2 * last2 * last2)) END), 2)
        / (var_pop(value) * any_value(c.n)) AS w
    FROM (SELECT *, {m} AS m FROM (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM (
            SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i,
                   count(*) OVER (PARTITION BY variable) AS n FROM ({cells}) AS cells))) AS c
    JOIN (SELECT *, m1 / sqrt(mm) + {_poly([0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056], "u")} AS last1,
                 m2 / sqrt(mm) + {_poly([0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633], "u")} AS last2 FROM (
            SELECT variable, 1 / sqrt(max(n)) AS u, sum(m * m) AS mm, max(m) AS m1, max(CASE WHEN i = n - 1 THEN m END) AS m2
            FROM (SELECT *, {m} AS m FROM (SELECT *, (i - 0.375) / (n + 0.25) AS p FROM (
                    SELECT variable, row_number() OVER (PARTITION BY variable ORDER BY value) AS i,
                           count(*) OVER (PARTITION BY variable) AS n FROM ({cells}) AS cells)))
            GROUP BY variable)) AS s ON c.variable = s.variable
    GROUP BY c.variable))"""


def anderson_sql(cells: str) -> str:
    """A2 of every variable of ``cells``, from the sum over ranks of (2i - 1) (log F(z_i) + log(1 - F(z_{n+1-i})))."""
    return f"""
SELECT r.variable, max(n) AS n, round(-max(n) - sum((2 * i - 1) * below + (2 * (n - i) + 1) * above) / max(n), 6) AS a2
FROM (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i,
             count(*) OVER (PARTITION BY variable) AS n FROM ({cells}) AS cells) AS r
JOIN (SELECT variable, value, ln({normal_cdf("z")}) AS below, ln({normal_cdf("(-z)")}) AS above
      FROM (SELECT DISTINCT c.variable, c.value, (c.value - mu) / sd AS z FROM ({cells}) AS c
            JOIN (SELECT variable, avg(value) AS mu, stddev_samp(value) AS sd FROM ({cells}) AS cells GROUP BY variable) AS s
              ON c.variable = s.variable)) AS f
  ON r.variable = f.variable AND r.value = f.value
GROUP BY r.variable"""


def dagostino_sql(moments: str) -> str:
    """``moments`` (n, g1, g2, ...) with ``k2``, the sum of the squared normal scores of skewness (D'Agostino) and
    kurtosis (Anscombe and Glynn), each by its mean, variance and third moment under normality."""
    skewness = f"""SELECT *, sqrt(6 * (n - 2) / ((n + 1) * (n + 3))) AS sd1,
        sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS omega,
        3 * (n - 1) / (n + 1) AS mean2, sqrt(24 * n * (n - 2) * (n - 3) / ((n + 3) * (n + 5))) / (n + 1) AS sd2,
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS third
      FROM ({moments}) WHERE n >= 8"""
    scores = f"""SELECT *, asinh(g1 / sd1 * sqrt((omega - 1) / 2)) / sqrt(ln(omega) / 2) AS z1,
        6 + 8 / third * (2 / third + sqrt(1 + pow(2 / third, 2))) AS a, (g2 + 3 - mean2) / sd2 AS x FROM ({skewness})"""
    return f"""SELECT *, z1 * z1 + pow(1 - 2 / (9 * a) - cbrt((1 - 2 / a) / (1 + x * sqrt(2 / (a - 4)))), 2) * 9 * a / 2 AS k2
      FROM ({scores})"""
