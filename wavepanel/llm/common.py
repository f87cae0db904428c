"""Helpers shared by the text operators.

The text operators select the id and text columns they need and return their
own columns, so extra input columns with clashing names never meet theirs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Collection, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.session import checkpoint_dir

#: Rows of one Arrow batch sent to Python. Documents vary from a word to many
#: thousands, so a few hundred rows keep a batch in the low tens of megabytes.
ARROW_ROWS = 1000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(df: DataFrame, text: str = "text") -> Column:
    return F.coalesce(df[text].cast("string"), F.lit(""))


def bound_arrow_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch to ``ARROW_ROWS`` rows, if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def shared_path(spark: SparkSession, stem: str) -> str:
    """A new path below the shared checkpoint folder of the session."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, stem: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the
    lineage in a form that survives lost executors and later reads by column."""
    spark = df.sparkSession
    path = shared_path(spark, stem)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes (one row at least)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


class WordCache:
    """Values of the words used last, in two generations of bounded size. What a
    slice of texts needs is handed out as a dictionary of its own, small enough
    to be looked up quickly for every word."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest = size, longest
        self.new: dict = {}
        self.old: dict = {}

    def take(self, words: Collection, make: Callable[[list], list]) -> dict[Any, Any]:
        """The value of each word; ``make`` gives those of unknown words (never None)."""
        new, old, out, fresh = self.new, self.old, {}, []
        for w in words:
            value = new.get(w)
            if value is None:
                value = old.pop(w, None)
                if value is None:
                    fresh.append(w)
                    continue
                new[w] = value
            out[w] = value
        for w, value in zip(fresh, make(fresh)) if fresh else ():
            out[w] = value
            if len(w) <= self.longest:
                new[w] = value
        if len(new) > self.size:
            self.new, self.old = {}, new
        return out
