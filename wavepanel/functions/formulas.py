"""Closed-form test statistics as SQL expression text.

Each formula is a list of ``(column, expression)`` steps over columns
computed earlier, which ``apply_steps`` runs in Spark (``F.expr``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_steps(df: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    for name, expr in steps:
        df = df.withColumn(name, F.expr(expr))
    return df


# D'Agostino-Pearson K^2 from n, biased skewness g1 and biased excess
# kurtosis g2 (skewness test of D'Agostino 1970, kurtosis test of
# Anscombe & Glynn 1983, as combined by D'Agostino & Pearson 1973).
# Requires n >= 8 (null below).
DAGOSTINO = [
    ("_y", "g1 * sqrt(((n + 1) * (n + 3)) / (6.0 * (n - 2)))"),
    ("_beta2", "(3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9))"),
    ("_w2", "-1 + sqrt(2 * (_beta2 - 1))"),
    ("_delta", "1 / sqrt(0.5 * ln(_w2))"),
    ("_alpha", "sqrt(2.0 / (_w2 - 1))"),
    ("_yy", "CASE WHEN _y = 0 THEN 1.0 ELSE _y END"),
    ("z_skew", "_delta * ln(_yy / _alpha + sqrt(power(_yy / _alpha, 2) + 1))"),
    ("_e", "3.0 * (n - 1) / (n + 1)"),
    ("_varb2", "24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1.0) * (n + 3) * (n + 5))"),
    ("_x", "((g2 + 3) - _e) / sqrt(_varb2)"),
    ("_sb1", "6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt((6.0 * (n + 3) * (n + 5)) / (n * (n - 2) * (n - 3)))"),
    ("_a", "6.0 + 8.0 / _sb1 * (2.0 / _sb1 + sqrt(1 + 4.0 / (_sb1 * _sb1)))"),
    ("_t1", "1 - 2 / (9.0 * _a)"),
    ("_den", "1 + _x * sqrt(2 / (_a - 4.0))"),
    ("_t2", "CASE WHEN _den = 0 THEN NULL ELSE sign(_den) * power((1 - 2.0 / _a) / abs(_den), 1 / 3.0) END"),
    ("z_kurt", "(_t1 - _t2) / sqrt(2 / (9.0 * _a))"),
    ("k2", "CASE WHEN n >= 8 THEN z_skew * z_skew + z_kurt * z_kurt END"),
    ("k2_p", "CASE WHEN n >= 8 THEN exp(-k2 / 2) END"),
]
DAGOSTINO_TEMPS = [n for n, _ in DAGOSTINO if n.startswith("_")]


# Anderson-Darling normality: small-sample adjustment and the piecewise
# p-value approximation of D'Agostino & Stephens (1986), from column a2.
ANDERSON_P = [
    ("a2_adj", "a2 * (1 + 0.75 / n + 2.25 / (n * n))"),
    ("ad_p", """CASE WHEN a2_adj >= 0.6 THEN exp(1.2937 - 5.709 * a2_adj + 0.0186 * a2_adj * a2_adj)
                     WHEN a2_adj >= 0.34 THEN exp(0.9177 - 4.279 * a2_adj - 1.38 * a2_adj * a2_adj)
                     WHEN a2_adj >= 0.2 THEN 1 - exp(-8.318 + 42.796 * a2_adj - 59.938 * a2_adj * a2_adj)
                     ELSE 1 - exp(-13.436 + 101.14 * a2_adj - 223.73 * a2_adj * a2_adj) END"""),
]


# Shapiro-Wilk coefficients (Royston 1992/1995): from n, mm = sum(m_i^2),
# mn = m_n and mn1 = m_{n-1} (expected normal order statistics).
SHAPIRO_COEF = [
    ("_u", "1 / sqrt(n)"),
    ("a_n", "CASE WHEN n = 3 THEN sqrt(0.5) ELSE mn / sqrt(mm) + 0.221157 * _u - 0.147981 * power(_u, 2)"
            " - 2.071190 * power(_u, 3) + 4.434685 * power(_u, 4) - 2.706056 * power(_u, 5) END"),
    ("a_n1", "mn1 / sqrt(mm) + 0.042981 * _u - 0.293762 * power(_u, 2) - 1.752461 * power(_u, 3)"
             " + 5.682633 * power(_u, 4) - 3.582633 * power(_u, 5)"),
    ("phi", """CASE WHEN n <= 3 THEN 1.0
                    WHEN n > 5 THEN (mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * a_n * a_n - 2 * a_n1 * a_n1)
                    ELSE (mm - 2 * mn * mn) / (1 - 2 * a_n * a_n) END"""),
]

# Shapiro-Wilk p-value: normalising transform of W (Royston 1995) to z;
# p = P(Z > z) is finished with the normal tail.
SHAPIRO_Z = [
    ("_ln", "ln(n)"),
    ("_g", "-2.273 + 0.459 * n"),
    ("_mu", """CASE WHEN n <= 11 THEN 0.5440 - 0.39978 * n + 0.025054 * n * n - 0.0006714 * n * n * n
                    ELSE -1.5861 - 0.31082 * _ln - 0.083751 * _ln * _ln + 0.0038915 * _ln * _ln * _ln END"""),
    ("_sd", """CASE WHEN n <= 11 THEN exp(1.3822 - 0.77857 * n + 0.062767 * n * n - 0.0020322 * n * n * n)
                    ELSE exp(-0.4803 - 0.082676 * _ln + 0.0030302 * _ln * _ln) END"""),
    ("sw_z", """CASE WHEN n <= 3 OR w >= 1 THEN NULL
                     WHEN n <= 11 THEN (-ln(_g - ln(1 - w)) - _mu) / _sd
                     ELSE (ln(1 - w) - _mu) / _sd END"""),
]
