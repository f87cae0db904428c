"""Checked broadcasts.

Three cases only:

* ``bounded(df)``: the side is bounded by construction (a global aggregate
  row, a per-stage table with a fixed number of levels, a literal lookup),
  so an explicit ``broadcast`` hint is safe at any data size.
* ``level_table(df)``: one row per level of a grouping column, usually few. It
  is brought to the driver if it has at most ``MOST_LEVELS`` rows and handed out
  as a literal broadcast table, so the data rows are not shuffled on a key of a
  handful of values; a larger one stays as it is.
* ``sized_at_run_time(df)``: the size grows with the data, so no hint is
  given; AQE measures the materialised shuffle output at run time and turns
  the join into a broadcast only when it is under
  ``spark.sql.adaptive.autoBroadcastJoinThreshold`` -- a checked size with the
  sort-merge join as the way beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rows up to which a level table is broadcast.
MOST_LEVELS = 10_000


def sized_at_run_time(df: DataFrame) -> DataFrame:
    return df


def level_table(df: DataFrame) -> DataFrame:
    rows = df.limit(MOST_LEVELS + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= MOST_LEVELS else df


def bounded(df: DataFrame) -> DataFrame:
    return F.broadcast(df)
