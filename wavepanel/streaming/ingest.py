"""Structured Streaming ingestion of per-visit files as they arrive.

The batch reader (``sources.io.read_panel``) handles files whose headers
differ per visit. A stream has one declared schema, so here every file in the
folder must share one column layout (columns are read by position); the visit
number comes from the file name. Each micro-batch is cleaned with the same
stateless projections as the batch path (missing codes, optional typing of
declared numeric columns, range clipping) and appended to Parquet partitioned
by visit. Progress lives in the checkpoint folder, so a restarted query (or a
lost executor) resumes without duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from wavepanel.operators.clean import clip_ranges, null_codes, parse_number


def visit_stream(spark: SparkSession, src_dir: str, columns: list[str], numeric: list[str] | None = None,
                 ranges: dict[str, tuple[float, float]] | None = None, pattern: str = r"timestamp_(\d+)",
                 sep: str = "\t", glob: str = "*.tsv") -> DataFrame:
    """Streaming DataFrame of cleaned visit rows (SRC1, PRJ1, PRJ4, PRJ5)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (spark.readStream.format("csv").schema(schema).option("sep", sep).option("header", True)
                .option("pathGlobFilter", glob).load(src_dir))
    raw = raw.withColumn("visit_from_file",
                         F.regexp_extract(F.col("_metadata.file_name"), pattern, 1).try_cast("int"))
    raw = raw.filter(F.col("visit_from_file").isNotNull())
    clean = null_codes(raw, cols=columns)
    if numeric:
        clean = clean.select(*[parse_number(F.col(c)).alias(c) if c in numeric else F.col(c)
                               for c in clean.columns])
    if ranges:
        clean = clip_ranges(clean, ranges)
    return clean


def ingest(spark: SparkSession, src_dir: str, out_dir: str, checkpoint: str, columns: list[str],
           numeric: list[str] | None = None, ranges: dict[str, tuple[float, float]] | None = None,
           available_now: bool = True) -> StreamingQuery:
    """Append cleaned rows to Parquet partitioned by visit. ``available_now``
    processes everything present and stops (incremental batch); otherwise
    the query keeps running and picks up new files."""
    stream = visit_stream(spark, src_dir, columns, numeric, ranges)
    w = (stream.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
               .partitionBy("visit_from_file").outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
