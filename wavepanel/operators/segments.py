"""Ordered per-key windows that stay split when one key is hot.

A window partitioned by entity puts every row of an entity in one task; an
entity holding a third of the data would make one enormous task. The chunked
forms below partition by (entity, chunk), where ``chunk`` is a contiguous range
of the rows in order: with ``Rows(n)`` of about n rows, cut on the whole order
key, so that rows of one key that share one place (all on one date) are split as
well; with a number of that width of the first order column
(``floor(order / width)``). The chunk boundaries are repaired from small
per-chunk summaries:

* ``chunked_lag``: lag-1 of columns; the first row of a chunk takes the last
  row of the previous non-empty chunk (``max_by`` per chunk, ``lag`` over the
  chunk summaries).
* ``chunked_neighbours``: the k previous / next *non-null* items of columns
  (``lag/lead ... IGNORE NULLS``); items missing inside a chunk come from
  halos: the last k non-null items of the preceding chunks and the first k of
  the following chunks, carried across empty chunks.
* ``chunk_totals``: per-key totals (rows, non-null counts) summed from chunk
  aggregates.

Every summary table has one row per non-empty chunk and at most 2k items per
row, so it grows with data / chunk size, never with the size of one key;
joins back to the rows are on (entity, chunk), which has no hot key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavepanel.session import write_shared

CHUNK = "__chunk"


@dataclass(frozen=True)
class Rows:
    """Chunks of about ``n`` rows."""
    n: int


HOT_ROWS = 2_000_000      # rows one task should hold for one key before the key is chunked
RANGE_ROWS = 200_000      # rows dealt to one task, which cuts them into chunks


def place(df: DataFrame, col: str) -> Column:
    """A number, double, in the order of ``col``: times in seconds, dates in days.
    A time without zone is counted by its own calendar, so no session time zone
    can reorder it."""
    kind, c = df.schema[col].dataType, F.col(col)
    if isinstance(kind, T.TimestampNTZType):
        return (F.unix_date(c.cast("date")) * F.lit(86400.0) + F.hour(c) * 3600 + F.minute(c) * 60
                + F.date_part(F.lit("SECOND"), c).cast("double"))
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    return c.cast("double")


def auto_rows(df: DataFrame, key: str, target_rows: int = HOT_ROWS) -> Rows | None:
    """None when no key holds more than ``target_rows`` rows, else chunks of that
    size. One partial aggregate per key; no key is collected."""
    largest = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return Rows(target_rows) if largest is not None and largest > target_rows else None


def resolve_width(df: DataFrame, key: str, width: float | str | Rows | None) -> float | Rows | None:
    """``width`` may be None (plain window), a number, ``Rows`` or ``"auto"``."""
    return auto_rows(df, key, HOT_ROWS) if width == "auto" else width


def in_chunks(df: DataFrame, key: str, order: list[str], width: float | Rows) -> DataFrame:
    """``df`` with the chunk of each row, numbered upwards in the order of a key."""
    return row_chunks(df, key, order, width.n) if isinstance(width, Rows) else with_chunk(df, order[0], width)


def row_chunks(df: DataFrame, key: str, order: list[str], rows: int) -> DataFrame:
    """Rows dealt by ranges of (key, order), each range cut in order into chunks of ``rows`` rows;
    a range holds many chunks, so the sample that finds the ranges stays small. Written to the
    shared folder, as ranges come from a sample and all readers of a chunk must
    see the same one; rows equal in key and order share a chunk."""
    n_ranges = max(1, -(-df.count() // max(rows, RANGE_ROWS)))
    by = [F.col(c) for c in (key, *order)]
    # number of the range in the upper bits, place in it in the lower
    dealt = df.repartitionByRange(n_ranges, *by).sortWithinPartitions(*by).withColumn(CHUNK, F.monotonically_increasing_id())
    first = F.min(CHUNK).over(Window.partitionBy(*by))                      # dealt and sorted so already: no shuffle
    within = F.col(CHUNK).bitwiseAND(F.lit((1 << 33) - 1))
    cut = dealt.withColumn(CHUNK, first).withColumn(CHUNK, F.col(CHUNK) - within % F.lit(rows))
    return write_shared(cut, "chunks")


def with_chunk(df: DataFrame, order_col: str, width: float) -> DataFrame:
    # rows without a place come first, as in a window
    chunk = F.floor(place(df, order_col) / float(width)).cast("long")
    return df.withColumn(CHUNK, F.coalesce(chunk, F.lit(-2 ** 62)))


def _beside(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their (key, chunk) in ``summary``; rows without a key are one key."""
    side = summary.withColumnsRenamed({key: "__k", CHUNK: "__c"})
    return rows.join(side, F.col(key).eqNullSafe(F.col("__k")) & (F.col(CHUNK) == F.col("__c")), "left").drop("__k", "__c")


def chunked_row_number(df: DataFrame, key: str, order: list[str], width: float | Rows,
                       name: str = "row_number") -> DataFrame:
    """``row_number() over (partition by key order by order)`` computed as the
    local row number inside (key, chunk) plus the row count of the key's
    earlier chunks (a running sum over the chunk counts)."""
    d = in_chunks(df, key, order, width)
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    local = d.withColumn("__rn", F.row_number().over(w))
    counts = d.groupBy(key, CHUNK).agg(F.count(F.lit(1)).alias("__cnt"))
    before = Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, CHUNK, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__off"))
    j = _beside(local, offsets, key)
    return j.select(*df.columns, (F.col("__rn") + F.col("__off")).alias(name))


def chunk_totals(df: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """(key, chunk) -> per-key row count and non-null counts of ``cols``,
    from chunk-level partial aggregates."""
    per = df.groupBy(key, CHUNK).agg(F.count(F.lit(1)).alias("__rows"),
                                     *[F.count(c).alias(f"__n_{c}") for c in cols])
    whole = Window.partitionBy(key)
    return per.select(key, CHUNK, F.sum("__rows").over(whole).alias("__nrows"),
                      *[F.sum(f"__n_{c}").over(whole).alias(f"__nobs_{c}") for c in cols])


def chunked_lag(df: DataFrame, key: str, order: list[str], cols: list[str], width: float | Rows,
                prefix: str = "__lag_") -> DataFrame:
    """Adds ``{prefix}{c}`` = value of ``c`` on the previous row of the key
    in ``order`` (exactly ``lag(c)`` over partitionBy(key).orderBy(order))."""
    d = in_chunks(df, key, order, width)
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    inner = d.select("*", F.row_number().over(w).alias("__rn"),
                     *[F.lag(c).over(w).alias(f"__in_{c}") for c in cols])
    last = d.groupBy(key, CHUNK).agg(F.max_by(F.struct(*[F.col(c) for c in cols]),
                                              F.struct(*[F.col(o) for o in order])).alias("__last"))
    prev = last.select(key, CHUNK, F.lag("__last").over(Window.partitionBy(key).orderBy(CHUNK)).alias("__prev"))
    j = _beside(inner, prev, key)
    return j.select(*df.columns, CHUNK, *[
        F.when(F.col("__rn") == 1, F.col("__prev")[c]).otherwise(F.col(f"__in_{c}")).alias(f"{prefix}{c}")
        for c in cols])


def _item(df: DataFrame, c: str, order: list[str]) -> Column:
    fields = [place(df, order[0]).alias("p")]
    fields += [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    fields.append(F.col(c).cast("double").alias("x"))
    return F.when(F.col(c).isNotNull(), F.struct(*fields))


def chunked_neighbours(df: DataFrame, key: str, order: list[str], cols: list[str], k: int,
                       width: float | Rows) -> DataFrame:
    """Adds ``__cand_{c}``: an array holding the k previous and k next
    non-null items of ``c`` around each row within its key, each item a
    struct (p, o0.., x) -- the same contract as the single-window form -- plus
    ``__nrows`` and ``__nobs_{c}`` per key."""
    d = in_chunks(df, key, order, width)
    d = d.select("*", *[_item(d, c, order).alias(f"__it_{c}") for c in cols])
    w = Window.partitionBy(key, CHUNK).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key, CHUNK)
    sel = []
    for c in cols:
        it = f"__it_{c}"
        lags = [F.expr(f"lag({it}, {j}) IGNORE NULLS").over(w) for j in range(1, k + 1)]
        leads = [F.expr(f"lead({it}, {j}) IGNORE NULLS").over(w) for j in range(1, k + 1)]
        sel.append(F.array(*lags, *leads).alias(f"__in_{c}"))
        sel.append(F.count(it).over(upto).alias(f"__cu_{c}"))      # non-null items up to this row
        sel.append(F.count(it).over(whole).alias(f"__ct_{c}"))     # non-null items in the chunk
    inner = d.select("*", *sel)
    for c in cols:                                                 # non-null items from this row on
        inner = inner.withColumn(f"__ca_{c}", F.col(f"__ct_{c}") - F.col(f"__cu_{c}")
                                 + F.col(f"__it_{c}").isNotNull().cast("long"))

    # per chunk: first k and last k non-null items of each column (<= 2k per row)
    aggs = []
    for c in cols:
        it = F.col(f"__it_{c}")
        aggs.append(F.sort_array(F.collect_list(F.when(it.isNotNull() & (F.col(f"__cu_{c}") <= k), it)))
                    .alias(f"__head_{c}"))
        aggs.append(F.sort_array(F.collect_list(F.when(it.isNotNull() & (F.col(f"__ca_{c}") <= k), it)))
                    .alias(f"__tail_{c}"))
    summ = inner.groupBy(key, CHUNK).agg(*aggs)

    halos = summ.select(key, CHUNK)
    for c in cols:
        halos = _beside(halos, _halo(summ, key, c, k), key)
    totals = chunk_totals(d, key, cols)
    j = _beside(_beside(inner, halos, key), totals, key)
    out = []
    for c in cols:
        inside = F.col(f"__in_{c}")
        before, after = (F.coalesce(F.col(f"__{side}_{c}"), F.array()) for side in ("before", "after"))
        # what a chunk lacks of the k before and the k after, so that the items are those of one window
        lack, lack_after = (F.lit(k) - F.size(F.filter(F.slice(inside, at, k), lambda x: x.isNotNull())) for at in (1, k + 1))
        out.append(F.concat(inside, F.slice(before, F.greatest(F.size(before) - lack + 1, F.lit(1)), lack),
                            F.slice(after, F.lit(1), lack_after)).alias(f"__cand_{c}"))
    return j.select(*df.columns, CHUNK, "__nrows", *[f"__nobs_{c}" for c in cols], *out)


def _halo(summ: DataFrame, key: str, c: str, k: int) -> DataFrame:
    """(key, chunk) -> last k non-null items before the chunk and first k after it."""
    head, tail = f"__head_{c}", f"__tail_{c}"
    obs = summ.filter(F.size(tail) > 0).select(key, CHUNK, head, tail)
    wo = Window.partitionBy(key).orderBy(CHUNK)
    # cumulative last-k up to and including an obs-bearing chunk: the last k of the
    # tails of the k most recent obs-bearing chunks (each holds >= 1 item)
    back = F.flatten(F.collect_list(tail).over(wo.rowsBetween(-(k - 1), Window.currentRow)))
    fwd = F.flatten(F.collect_list(head).over(wo.rowsBetween(Window.currentRow, k - 1)))
    srt = F.array_sort(back)
    cum = obs.select(key, CHUNK,
                     F.slice(srt, F.greatest(F.size(srt) - k + 1, F.lit(1)), k).alias("__cb"),   # last k
                     F.slice(F.array_sort(fwd), 1, k).alias("__cf"))                              # first k
    # carry to every chunk: nearest obs-bearing chunk strictly before / after
    rows = summ.select(key, CHUNK, F.lit(1).alias("__tag"), F.lit(None).cast(cum.schema["__cb"].dataType).alias("__cb"),
                       F.lit(None).cast(cum.schema["__cf"].dataType).alias("__cf"))
    both = rows.unionByName(cum.withColumn("__tag", F.lit(0)).select(key, CHUNK, "__tag", "__cb", "__cf"))
    # running frames only (unbounded preceding): ascending for "before", descending for
    # "after"; within a chunk the data row (tag 1) comes first, so its own chunk is excluded
    w_b = Window.partitionBy(key).orderBy(CHUNK, F.col("__tag").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    w_f = Window.partitionBy(key).orderBy(F.col(CHUNK).desc(), F.col("__tag").desc()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(key, CHUNK, "__tag",
                          F.last("__cb", ignorenulls=True).over(w_b).alias(f"__before_{c}"),
                          F.last("__cf", ignorenulls=True).over(w_f).alias(f"__after_{c}"))
    return carried.filter(F.col("__tag") == 1).drop("__tag")
