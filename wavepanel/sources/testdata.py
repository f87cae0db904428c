"""Panels derived from the shared test tables.

The test tables are a TPC-H-like star schema, not a panel, so the fixture
panels below map them onto the (entity, visit) shape:

* ``orders_panel``: entity = customer, visit = order sequence per customer
  (ties on date broken by order key), stage = order priority (5 levels),
  measures derived from the order price with deterministic missingness.
* ``entity_dimension``: one row per customer, with every tenth customer
  removed so that left joins have unmatched ids.
* ``order_lines``: numeric per-order aggregates of ``lineitem``.
* ``event_series``: one series per user over ``events`` ordered by time.

Each builder has a SQL twin (``*_SQL``) with the same definitions, valid in
both Spark SQL and DuckDB; the oracle queries embed those as CTEs. Only
``floor`` is used to turn doubles into integers (a cast truncates in Spark and
rounds in DuckDB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

MEASURES = ["m1", "m2", "e1", "e2", "e3"]     # measures with missing cells
NUMERIC = ["m1", "m2", "e1", "e2", "e3", "x1", "x2", "age"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _scaled(price: Column, div: float, mod: int, add: int = 0) -> Column:
    base = F.floor(price / F.lit(div)) if div != 1 else F.floor(price)
    return ((base % mod) + add).cast("double")


def _holed(key: Column, mul: int, off: int, below: int, value: Column,
           extra: Column | None = None) -> Column:
    hole = ((key * mul + off) % 10) < below
    if extra is not None:
        hole = hole | extra
    return F.when(hole, F.lit(None).cast("double")).otherwise(value)


def orders_panel(spark: SparkSession, sf_dir: str, chunk_days=None) -> DataFrame:
    """``chunk_days``: number the visits per (customer, chunk of that many days,
    or of that many rows if it is ``segments.Rows``) and add the earlier chunks' counts, so a customer with a huge share of the
    orders is numbered by many tasks (identical visit numbers)."""
    # Alias the entity key before the window so the hash partitioning on
    # ``entity_id`` is visible to every later per-entity window/aggregate.
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("entity_id"), "o_orderdate", "o_orderpriority",
        "o_orderstatus", "o_totalprice")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    if chunk_days:
        from wavepanel.operators.segments import chunked_row_number
        o = o.withColumn("__day", F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")))
        o = chunked_row_number(o, "entity_id", ["__day", "o_orderdate", "o_orderkey"], chunk_days, name="__rn")
        visit = (F.col("__rn") - 1).cast("bigint")
    else:
        w = Window.partitionBy("entity_id").orderBy("o_orderdate", "o_orderkey")
        visit = (F.row_number().over(w) - 1).cast("bigint")
    return o.select(
        "entity_id",
        k.alias("order_key"),
        visit.alias("visit"),
        F.col("o_orderpriority").alias("stage"),
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("stage_code"),
        F.col("o_orderstatus").alias("status"),
        _holed(k, 7, 3, 3, _scaled(p, 1, 13)).alias("m1"),
        _holed(k, 7, 3, 2, _scaled(p, 7, 13), extra=(k % 17) == 0).alias("m2"),
        _holed(k, 11, 5, 1, _scaled(p, 3, 5, 1)).alias("e1"),
        _holed(k, 13, 7, 1, _scaled(p, 11, 5, 1)).alias("e2"),
        _holed(k, 17, 1, 1, _scaled(p, 19, 5, 1)).alias("e3"),
        _scaled(p, 101, 60).alias("x1"),
        (_scaled(p, 1, 9) - 2).alias("x2"),
        ((F.col("entity_id") % 7 + 40).cast("double") + visit.cast("double")).alias("age"),
    )


ORDERS_PANEL_SQL = """
SELECT o_custkey AS entity_id, o_orderkey AS order_key,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS visit,
  o_orderpriority AS stage,
  CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS stage_code,
  o_orderstatus AS status,
  CASE WHEN (o_orderkey * 7 + 3) % 10 < 3 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 13 AS DOUBLE) END AS m1,
  CASE WHEN (o_orderkey * 7 + 3) % 10 < 2 OR o_orderkey % 17 = 0 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 7) AS BIGINT) % 13 AS DOUBLE) END AS m2,
  CASE WHEN (o_orderkey * 11 + 5) % 10 < 1 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 3) AS BIGINT) % 5 + 1 AS DOUBLE) END AS e1,
  CASE WHEN (o_orderkey * 13 + 7) % 10 < 1 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 11) AS BIGINT) % 5 + 1 AS DOUBLE) END AS e2,
  CASE WHEN (o_orderkey * 17 + 1) % 10 < 1 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 19) AS BIGINT) % 5 + 1 AS DOUBLE) END AS e3,
  CAST(CAST(floor(o_totalprice / 101) AS BIGINT) % 60 AS DOUBLE) AS x1,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 9 AS DOUBLE) - 2 AS x2,
  CAST(o_custkey % 7 + 40 AS DOUBLE)
    + CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS DOUBLE) AS age
FROM orders
"""


def raw_orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String-typed panel carrying missing codes, blanks and junk text, the way
    per-visit TSV files arrive (all columns read as text)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    d = k % 10

    def txt(c: Column) -> Column:
        return c.cast("bigint").cast("string")

    r1 = (F.when(d == 0, F.lit("-9")).when(d == 1, F.lit(" ")).when(d == 2, F.lit(" -8 "))
          .when(d == 3, F.lit("-1.0")).otherwise(txt(F.floor(p) % 13)))
    r2 = (F.when(k % 50 == 0, F.lit("abc")).when(d == 7, F.lit("-7"))
          .otherwise(txt(F.floor(p / 3) % 5 + 1)))
    r3 = (F.when(d == 4, F.lit("-9")).when(d == 5, F.lit("-2"))
          .otherwise(txt(F.floor(p / 101) % 60)))
    return o.select(
        txt(F.col("o_custkey")).alias("entity_id"),
        txt(k).alias("order_key"),
        F.substring("o_orderpriority", 1, 1).alias("stage_code"),
        r1.alias("r1"), r2.alias("r2"), r3.alias("r3"))


RAW_ORDERS_PANEL_SQL = """
SELECT CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderkey AS VARCHAR) AS order_key,
  substr(o_orderpriority, 1, 1) AS stage_code,
  CASE o_orderkey % 10 WHEN 0 THEN '-9' WHEN 1 THEN ' ' WHEN 2 THEN ' -8 ' WHEN 3 THEN '-1.0'
       ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) % 13 AS VARCHAR) END AS r1,
  CASE WHEN o_orderkey % 50 = 0 THEN 'abc' WHEN o_orderkey % 10 = 7 THEN '-7'
       ELSE CAST(CAST(floor(o_totalprice / 3) AS BIGINT) % 5 + 1 AS VARCHAR) END AS r2,
  CASE WHEN o_orderkey % 10 = 4 THEN '-9' WHEN o_orderkey % 10 = 5 THEN '-2'
       ELSE CAST(CAST(floor(o_totalprice / 101) AS BIGINT) % 60 AS VARCHAR) END AS r3
FROM orders
"""


def entity_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return (c.filter(F.col("c_custkey") % 10 != 0)
             .select(F.col("c_custkey").alias("entity_id"),
                     F.col("c_mktsegment").alias("segment"),
                     F.col("c_nationkey").cast("bigint").alias("nation"),
                     F.col("c_acctbal").alias("acctbal")))


ENTITY_DIMENSION_SQL = """
SELECT c_custkey AS entity_id, c_mktsegment AS segment, CAST(c_nationkey AS BIGINT) AS nation,
       c_acctbal AS acctbal
FROM customer WHERE c_custkey % 10 <> 0
"""


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("qty"),
        F.sum("l_extendedprice").alias("price"),
        F.avg("l_discount").alias("disc"),
        F.avg("l_tax").alias("tax"))


ORDER_LINES_SQL = """
SELECT l_orderkey AS order_key, count(*) AS n_lines, sum(l_quantity) AS qty,
       sum(l_extendedprice) AS price, avg(l_discount) AS disc, avg(l_tax) AS tax
FROM lineitem GROUP BY l_orderkey
"""


def numeric_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders panel with per-order line aggregates attached (left join: some
    orders have no lines)."""
    return orders_panel(spark, sf_dir).join(order_lines(spark, sf_dir), "order_key", "left")


NUMERIC_PANEL_SQL = f"""
SELECT p.*, l.n_lines, l.qty, l.price, l.disc, l.tax
FROM ({ORDERS_PANEL_SQL}) p LEFT JOIN ({ORDER_LINES_SQL}) l ON p.order_key = l.order_key
"""


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("series_id"), F.col("ts").alias("t"),
                    "event_id", "event_type", "value")


EVENT_SERIES_SQL = """
SELECT user_id AS series_id, ts AS t, event_id, event_type, value FROM events
"""


def with_cte(body: str, **ctes: str) -> str:
    """Prefix ``body`` with ``WITH name AS (sql), ...``."""
    parts = [f"{name} AS ({sql})" for name, sql in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body
