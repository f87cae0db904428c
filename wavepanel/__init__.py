"""wavepanel: longitudinal (entity x visit) panel analytics on Spark.

Every public operator takes DataFrames and returns DataFrames built from
Spark SQL expressions, windows, joins and aggregates. Only small aggregate
tables (p x p matrices, per-pattern sums, result rows) ever reach the driver.
"""

from wavepanel.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
