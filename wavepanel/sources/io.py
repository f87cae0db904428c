"""Sources and sinks (SRC1-SRC4, SNK1-SNK3).

Per-visit files carry the visit number in their name and, often, as a suffix on
every column name, so headers differ between files. All files are one scan of
text lines, whatever their number: the first line of each is its header (one
aggregate, a row a file), which says where in a line each column of the panel
stands. Cleaning and typing then run once (one projection and one audit aggregate).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wavepanel.operators.clean import infer_numeric, null_codes
from wavepanel.session import write_shared


def strip_visit_suffix(names: list[str], visit: int) -> list[str]:
    """Drop one trailing occurrence of the visit number from each name (SRC2).

    Like the reference, this also trims genuine trailing digits equal to the
    visit number (at visit 1, ``X1`` becomes ``X``). Two columns that end up
    with the same name raise.
    """
    suffix = str(visit)
    out = [n[: -len(suffix)] if n.endswith(suffix) and len(n) > len(suffix) else n for n in names]
    seen: dict[str, str] = {}
    for orig, new in zip(names, out):
        if new in seen:
            raise ValueError(f"columns {seen[new]!r} and {orig!r} both map to {new!r} at visit {visit}")
        seen[new] = orig
    return out


def visit_files(names: list[str], pattern: str = r"timestamp_(\d+)", ext: str = ".tsv",
                exclude: str | None = "cross_sectional") -> list[tuple[str, int]]:
    """(file name, visit) of those of ``names`` that ``read_panel`` takes: with the
    extension, not excluded, and with a visit number; others are skipped (SRC1)."""
    out = []
    rx = re.compile(pattern)
    for n in names:
        if not n.endswith(ext) or (exclude and exclude in n):
            continue
        m = rx.search(n)
        if m:
            out.append((n, int(m.group(1))))
    return out


def _lines(spark: SparkSession, path: str, pattern: str, ext: str, exclude: str | None) -> DataFrame:
    """(file, visit, first, at, value): the lines of the visit files under ``path``. A
    visit file is a file, or a folder of part files, with the extension, not excluded, whose
    name carries a visit number; others are skipped (by name, before they are read)."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    root = re.escape(path.rstrip("/").rsplit("/", 1)[-1])
    file = F.col("_metadata.file_path")
    name = F.regexp_extract(file, f"/{root}/([^/]+)", 1)
    visit = F.regexp_extract(name, pattern, 1)
    wanted = name.endswith(ext) & (visit != "")
    if exclude:
        wanted = wanted & ~name.contains(exclude)
    return text.filter(wanted).select(file.alias("file"), visit.cast("int").alias("visit"),
                                      (F.col("_metadata.file_block_start") == 0).alias("first"),
                                      F.monotonically_increasing_id().alias("at"), "value")


def _cells(column: str, width: int, sep: str):
    """The cells of a line, quotes and escapes as in any CSV."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(F.col(column), ", ".join(f"{n} STRING" for n in names), {"sep": sep})
    return F.array(*[parsed[n] for n in names])


def read_panel(spark: SparkSession, path: str, pattern: str = r"timestamp_(\d+)", ext: str = ".tsv",
               exclude: str | None = "cross_sectional", sep: str = "\t", clean: bool = True,
               source_visit: str | None = "source_visit", visits: list[int] | None = None) -> DataFrame:
    """Multi-file panel scan (SRC1, SRC2, SET1, PRJ1, PRJ2).

    Every cell is read as text; a column that a file lacks is null there. Columns come
    in the order in which the files (by visit, then name) bring them. Missing codes are
    nulled in all columns and columns whose values all parse become doubles. Blank
    lines, and lines that repeat a file's header, are skipped. ``visits`` reads only those visits' files.
    """
    lines = _lines(spark, path, pattern, ext, exclude)
    if visits is not None:
        lines = lines.filter(F.col("visit").isin(list(visits)))
    heads = lines.filter("first").groupBy("file", "visit").agg(F.min_by("value", "at").alias("head"))
    width = heads.agg(F.max(F.size(F.split("head", re.escape(sep), -1)))).first()[0]
    if width is None:
        raise ValueError(f"no visit files under {path}")
    end = F.col("visit").cast("string")
    strip = lambda n: F.when(n.endswith(end) & (F.length(n) > F.length(end)), F.left(n, F.length(n) - F.length(end))).otherwise(n)
    given = F.filter(_cells("head", width, sep), lambda n: n.isNotNull())
    heads = write_shared(heads.withColumn("given", given).withColumn("names", F.transform("given", strip)), "headers")
    clash = heads.filter(F.size(F.array_distinct("names")) < F.size("names")).select("given", "visit").first()
    if clash:
        strip_visit_suffix(clash["given"], clash["visit"])            # names the columns that clash
    each = heads.select(F.posexplode("names").alias("pos", "name"), "visit", "file")
    found = each.groupBy("name").agg(F.min(F.struct("visit", "file", "pos")).alias("o")).orderBy("o").collect()      # one row a column
    columns = [r["name"] for r in found]
    at = F.array(*[F.array_position("names", F.lit(c)) for c in columns]).alias("places")
    heads = heads.select(F.col("file").alias("of"), "head", at)
    rows = lines.filter(F.trim("value") != "").join(heads, F.col("file") == F.col("of")).filter(F.col("value") != F.col("head"))
    rows = rows.withColumn("cells", _cells("value", width, sep))
    out = rows.select(*[F.get("cells", F.col("places")[i].cast("int") - 1).alias(c) for i, c in enumerate(columns)],
                      *([F.col("visit").alias(source_visit)] if source_visit else []))
    return infer_numeric(null_codes(out)) if clean else out


def read_table(spark: SparkSession, path: str, sep: str = ",", clean: bool = True) -> DataFrame:
    """CSV/TSV table with the type rule: text first, then numeric where every
    value parses (SRC3, SRC4). Missing codes are nulled here too, so a
    dimension joined later is as clean as the panel."""
    df = spark.read.csv(path, sep=sep, header=True, inferSchema=False)
    return infer_numeric(null_codes(df)) if clean else df


def require_rows(df: DataFrame, what: str = "result") -> DataFrame:
    """Raise on an empty result before writing it (SNK3)."""
    if df.isEmpty():
        raise ValueError(f"no rows in {what}")
    return df


def write_rows(df: DataFrame, path: str, fmt: str = "parquet", **options) -> int:
    """Write a table and return its number of rows, which are counted while they are
    written, so the plan runs once; an empty result raises (SNK1, SNK3)."""
    seen = Observation()
    write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, fmt, **options)
    if not seen.get["rows"]:
        raise ValueError(f"no rows written to {path}")
    return seen.get["rows"]


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None, header: bool = True, sep: str = ",") -> None:
    """Table sink (SNK1): Parquet between stages, CSV at the edges."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", header).option("sep", sep).csv(path)
    else:
        w.format(fmt).save(path)


def metric_table(section: str, df: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Long report table (section, variable, metric, value) from a wide
    result (SNK2): the values that the reference printed as text."""
    return df.select(
        F.lit(section).alias("section"), F.col(key).cast("string").alias("variable"),
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
                            for m in metrics])).alias("mv")).select("section", "variable", "mv.metric", "mv.value")
