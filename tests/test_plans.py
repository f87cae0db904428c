"""Plan-shape regressions: shuffles, column pruning and filter pushdown, read
from ``explain()`` output."""

import re

from tests.conftest import SF_SMALL
import __spark_entry__ as entry
from wavepanel.operators.derive import keep_codes
from wavepanel.sources.testdata import table


def _plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_flagship_single_entity_shuffle_and_pruned_scan(spark, capsys):
    plan = _plan(entry.queries()["decline_rates"](spark, SF_SMALL), capsys)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^,]+)", plan)
    # one shuffle by entity for all windows, one for the final (map-side combined) aggregate
    assert len([e for e in exchanges if e.startswith("entity_id")]) == 1
    assert len(exchanges) == 2
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "o_orderstatus" not in scan and "o_orderpriority" in scan


def test_knn_single_shuffle_for_all_variables(spark, capsys):
    plan = _plan(entry.queries()["knn_impute"](spark, SF_SMALL), capsys)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "SortMergeJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_code_filter_reaches_the_scan(spark, capsys):
    df = keep_codes(table(spark, SF_SMALL, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    plan = _plan(df.select("o_orderkey"), capsys)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "PushedFilters: [In(o_orderpriority" in scan or "PushedFilters: [IsNotNull(o_orderpriority), In(" in scan
