"""Sources and sinks as round trips through the session's shared folder (SRC1-SRC4, SNK1, SNK3)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavepanel.plans.registry import register
from wavepanel.session import checkpoint_dir
from wavepanel.sources import io
from wavepanel.sources.testdata import table

VISITS = (1, 2, 3, 4)


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def visit_files_of_orders(spark, sf) -> str:
    """Orders as tab-separated files, one folder a visit: names end in the visit
    number, the second visit lacks the priority, the third has a status."""
    root = _folder(spark, "visits")
    o = table(spark, sf, "orders")
    for v in VISITS:
        cols = [F.col("o_orderkey").alias(f"order_key{v}"), F.col("o_totalprice").alias(f"price{v}")]
        cols += [F.col("o_orderpriority").alias(f"priority{v}")] if v != 2 else []
        cols += [F.col("o_orderstatus").alias("status")] if v == 3 else []
        part = o.filter(F.col("o_orderkey") % len(VISITS) == v - 1).select(*cols)
        io.write_rows(part, f"{root}/orders_timestamp_{v}.tsv", "csv", sep="\t")
    io.write_table(o.limit(0).select("o_orderkey"), f"{root}/notes", "csv")
    return root


@register("panel_files", """
SELECT CAST(o_orderkey AS DOUBLE) AS order_key, CAST(o_totalprice AS DOUBLE) AS price,
       CASE WHEN o_orderkey % 4 <> 1 THEN o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 4 = 2 THEN o_orderstatus END AS status, CAST(o_orderkey % 4 + 1 AS INTEGER) AS source_visit FROM orders""")
def q_panel_files(spark, sf):
    """SRC1, SRC2: all visit files as one scan, visit numbers off the names, missing columns null."""
    return io.read_panel(spark, visit_files_of_orders(spark, sf))


@register("panel_files_of_visits", """
SELECT CAST(o_orderkey AS DOUBLE) AS order_key, CAST(o_totalprice AS DOUBLE) AS price,
       CASE WHEN o_orderkey % 4 = 2 THEN o_orderpriority END AS priority,
       CASE WHEN o_orderkey % 4 = 2 THEN o_orderstatus END AS status, CAST(o_orderkey % 4 + 1 AS INTEGER) AS source_visit FROM orders
WHERE o_orderkey % 4 IN (1, 2)""")
def q_panel_of_visits(spark, sf):
    """SRC1 of chosen visits: only their files are read."""
    return io.read_panel(spark, visit_files_of_orders(spark, sf), visits=[2, 3])


@register("dimension_file", """
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       CASE WHEN c_acctbal NOT IN (-9, -8, -7, -1) THEN CAST(c_acctbal AS DOUBLE) END AS c_acctbal FROM customer""")
def q_dimension_file(spark, sf):
    """SRC3, SRC4: a dimension as CSV, types from its text, missing codes null."""
    path = _folder(spark, "dimension")
    io.write_rows(table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path, "csv")
    return io.read_table(spark, path)


@register("table_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders")
def q_table_round_trip(spark, sf):
    """SNK1: a partitioned Parquet table written and read."""
    path = _folder(spark, "orders")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    io.write_rows(o, path, partition_by=["o_orderstatus"])
    return spark.read.parquet(path).select(*o.columns)


@register("rows_written", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def q_rows_written(spark, sf):
    """SNK3: the counts that the guarded writer returns, a table a status."""
    o = table(spark, sf, "orders")
    found = [r[0] for r in o.select("o_orderstatus").distinct().collect()]                 # a few statuses
    counts = [(s, io.write_rows(o.filter(F.col("o_orderstatus") == s), _folder(spark, "status"))) for s in found]
    return spark.createDataFrame(counts, "o_orderstatus string, n long")
