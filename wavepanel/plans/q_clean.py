"""Cleaning queries (PRJ1-PRJ7) on the raw text panel and the orders panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators.clean import NUMBER_RE, clip_audit, clip_ranges, infer_numeric, null_codes, \
    residual_codes, reverse_code
from wavepanel.operators.describe import categorical_profile, describe
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, RAW_ORDERS_PANEL_SQL, orders_panel, \
    raw_orders_panel, with_cte

_NUM = f"regexp_matches({{c}}, '{NUMBER_RE}')"
_CODES = "(-9, -8, -7, -1)"


def _nulled(c: str) -> str:
    parsed = f"CASE WHEN {_NUM.format(c=c)} THEN TRY_CAST(trim({c}) AS DOUBLE) END"
    return (f"CASE WHEN {c} IN ('-9', '-8', '-7', '-1', ' ') OR ({parsed}) IN {_CODES} "
            f"THEN NULL ELSE {c} END")


@register("null_codes", with_cte(f"""
SELECT entity_id, order_key, stage_code,
       {_nulled('r1')} AS r1, {_nulled('r2')} AS r2, {_nulled('r3')} AS r3
FROM raw""", raw=RAW_ORDERS_PANEL_SQL))
def q_null_codes(spark, sf_dir):
    return null_codes(raw_orders_panel(spark, sf_dir))


@register("infer_numeric", with_cte("""
SELECT CAST(entity_id AS DOUBLE) AS entity_id, CAST(order_key AS DOUBLE) AS order_key,
       CAST(stage_code AS DOUBLE) AS stage_code,
       TRY_CAST(trim(r1) AS DOUBLE) AS r1, r2, TRY_CAST(trim(r3) AS DOUBLE) AS r3
FROM nulled""", raw=RAW_ORDERS_PANEL_SQL, nulled=f"""
SELECT entity_id, order_key, stage_code,
       {_nulled('r1')} AS r1, {_nulled('r2')} AS r2, {_nulled('r3')} AS r3 FROM raw"""))
def q_infer_numeric(spark, sf_dir):
    return infer_numeric(null_codes(raw_orders_panel(spark, sf_dir)))


RAW_COLS = ["r1", "r2", "r3"]
_NUMBERS = "\nUNION ALL ".join(f"SELECT '{c}' AS variable, CASE WHEN {_NUM.format(c=c)} THEN TRY_CAST(trim({c}) AS DOUBLE) END AS value FROM raw"
                               for c in RAW_COLS)


@register("coerced_profile", with_cte("""
SELECT variable, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, max(value) AS max
FROM cells GROUP BY variable""", raw=RAW_ORDERS_PANEL_SQL, cells=_NUMBERS))
def q_coerced_profile(spark, sf_dir):
    """PRJ4 at the analysis boundary: text columns profiled as numbers, bad text as null."""
    out = describe(raw_orders_panel(spark, sf_dir), RAW_COLS)
    return out.select("variable", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "p25", "p50", "p75", "max")


@register("trimmed_profile", with_cte("""
SELECT variable, value, n, round(n / sum(n) OVER (PARTITION BY variable), 6) AS proportion,
       CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value ASC) AS BIGINT) AS rank
FROM (SELECT variable, value, count(*) AS n FROM cells WHERE value <> '' GROUP BY variable, value)""",
    raw=RAW_ORDERS_PANEL_SQL,
    cells="\nUNION ALL ".join(f"SELECT '{c}' AS variable, trim({c}) AS value FROM raw" for c in RAW_COLS)))
def q_trimmed_profile(spark, sf_dir):
    """PRJ22, AGG20: levels of raw text, trimmed, blanks left out."""
    return categorical_profile(raw_orders_panel(spark, sf_dir), RAW_COLS)


def _cells(cols):
    parts = []
    for c in cols:
        parts.append(f"SELECT '{c}' AS variable, CASE WHEN {_NUM.format(c=c)} "
                     f"THEN TRY_CAST(trim({c}) AS DOUBLE) END AS code FROM raw")
    return "\nUNION ALL ".join(parts)


@register("residual_codes", with_cte("""
SELECT c.variable, c.code, c.n, CAST(r.column_total AS BIGINT) AS column_total,
       CAST(r.column_rank AS BIGINT) AS column_rank
FROM counts c JOIN ranked r ON c.variable = r.variable WHERE r.column_rank <= 3""",
    raw=RAW_ORDERS_PANEL_SQL,
    cells=_cells(["entity_id", "order_key", "stage_code", "r1", "r2", "r3"]),
    counts=f"SELECT variable, code, count(*) AS n FROM cells WHERE code IN {_CODES} GROUP BY variable, code",
    totals="SELECT variable, sum(n) AS column_total FROM counts GROUP BY variable",
    ranked="""SELECT variable, column_total,
              row_number() OVER (ORDER BY column_total DESC, variable ASC) AS column_rank FROM totals"""))
def q_residual_codes(spark, sf_dir):
    out = residual_codes(raw_orders_panel(spark, sf_dir), top=3)
    return out.select(F.col("column").alias("variable"), "code", "n", "column_total",
                      F.col("column_rank").cast("bigint").alias("column_rank"))


CLIP_RANGES = {"m1": (0, 12), "x1": (1, 50), "x2": (1, 5)}


def _clip_sql(c, lo, hi):
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN {c} = 0 THEN {c} WHEN {c} < {lo} THEN {float(lo)} "
            f"WHEN {c} > {hi} THEN {float(hi)} ELSE {c} END")


@register("clip_ranges", with_cte(f"""
SELECT entity_id, visit, {_clip_sql('m1', 0, 12)} AS m1, {_clip_sql('x1', 1, 50)} AS x1,
       {_clip_sql('x2', 1, 5)} AS x2
FROM panel""", panel=ORDERS_PANEL_SQL))
def q_clip_ranges(spark, sf_dir):
    p = orders_panel(spark, sf_dir).select("entity_id", "visit", "m1", "x1", "x2")
    return clip_ranges(p, CLIP_RANGES)


AUDIT_RANGES = {"m1": (0, 12), "x1": (1, 50), "x2": (1, 5), "visit": (0, 22)}


def _audit_cells():
    parts = []
    for c, (lo, hi) in AUDIT_RANGES.items():
        parts.append(f"SELECT '{c}' AS variable, CAST({c} AS DOUBLE) AS value, CAST({float(lo)} AS DOUBLE) AS lo, "
                     f"CAST({float(hi)} AS DOUBLE) AS hi FROM panel WHERE {c} IS NOT NULL")
    return "\nUNION ALL ".join(parts)


@register("clip_audit", with_cte("""
SELECT c.variable, c.lo, c.hi, c.n_zero, c.n_below, c.n_above, l.originals
FROM counts c LEFT JOIN listed l ON c.variable = l.variable
WHERE c.n_below + c.n_above > 0""",
    panel=ORDERS_PANEL_SQL,
    cells=_audit_cells(),
    counts="""SELECT variable, lo, hi,
                CAST(count_if(value = 0) AS BIGINT) AS n_zero,
                CAST(count_if(value < lo AND value <> 0) AS BIGINT) AS n_below,
                CAST(count_if(value > hi) AS BIGINT) AS n_above
              FROM cells GROUP BY variable, lo, hi""",
    listed="""SELECT variable,
                array_to_string(list_transform(list_sort(list(value)), lambda x: CAST(x AS VARCHAR)), ',') AS originals
              FROM cells WHERE (value < lo AND value <> 0) OR value > hi
              GROUP BY variable HAVING count(*) < 10"""))
def q_clip_audit(spark, sf_dir):
    return clip_audit(orders_panel(spark, sf_dir), AUDIT_RANGES)


@register("reverse_code", with_cte("""
SELECT entity_id, visit, e1 AS e1_original,
       CASE WHEN e1 IN (1, 2, 3, 4, 5) THEN 6 - e1 ELSE e1 END AS e1
FROM panel""", panel=ORDERS_PANEL_SQL))
def q_reverse_code(spark, sf_dir):
    p = orders_panel(spark, sf_dir).select("entity_id", "visit", F.col("e1").alias("e1_original"),
                                           F.col("e1"))
    return reverse_code(p, "e1", 1, 5)
