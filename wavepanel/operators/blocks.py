"""Ordered values of each key, packed into blocks that stay split when a key is hot.

Rows are dealt by ranges of (key, order columns, value), so a key with any share
of the rows spreads over as many tasks as its rows need, also where all of them
share one place of the order. A task packs the consecutive values of a key into
blocks of bounded size. A key whose rows are in one task and one block is
``whole``; the blocks of other keys (at most two a task but for long keys) are
numbered from their counts and dealt anew by position into chunks of equal size,
each with the values before it that it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wavepanel.session import write_shared

BLOCK_ROWS = 65_536
#: Blocks or pieces handed on at once: so many, or so many bytes of values.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def key_field(df: DataFrame) -> T.StructField:
    return T.StructField("key", df.schema["key"].dataType)


def ordered_blocks(df: DataFrame, key: str, order: list[str], value: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, part, place, edge, n, low, mean, square, values): ``values`` holds doubles
    in order, less ``low``, their first; ``mean`` and ``square`` (sum of squares about
    it) are the block's. Rows without a value have no place. ``edge`` marks blocks whose key may have others."""
    by = [f"o{i}" for i in range(len(order))]
    slim = df.select(F.col(key).alias("key"), *[F.col(o).alias(b) for o, b in zip(order, by)], F.col(value).cast("double").alias("x")) \
        .filter(F.col("x").isNotNull() & ~F.isnan("x")).withColumn("salt", F.monotonically_increasing_id())
    sort = ["key", *by, "x", "salt"]                      # rows that are equal throughout may be dealt apart
    schema = T.StructType([key_field(slim), *T.StructType.fromDDL(
        "part long, place long, edge boolean, n long, low double, mean double, square double, `values` binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, held, n, waiting = TaskContext.get().partitionId(), 0, [], 0, 0
        now, first, cut, done, kind = None, True, False, [], None

        def block(edge: bool) -> tuple:
            nonlocal place, held, n, waiting
            x = np.concatenate(held) if len(held) > 1 else held[0]
            own, rest = x[:block_rows], x[block_rows:]
            held, n = ([rest] if len(rest) else []), len(rest)
            low = float(own[0])
            own = own - low
            mean = float(own.mean())
            place += 1
            waiting += own.nbytes
            return (now, part, place, edge or first or cut, len(own), low, low + mean, float(((own - mean) ** 2).sum()), own.tobytes())

        def out() -> pa.RecordBatch:
            nonlocal waiting
            waiting = 0
            columns = list(zip(*done))
            types = [kind, pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, x = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            kind = keys.type
            runs = pc.run_end_encode(keys)
            start = 0
            for end, k in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if n and k != now:
                    done.append(block(False))
                    first, cut = False, False
                now = k
                held.append(x[start:end])
                n += end - start
                start = end
                while n > block_rows:                     # a full block waits until it is known whether more follow
                    cut = True
                    done.append(block(True))
                if len(done) >= BATCH_ROWS or waiting >= BATCH_BYTES:
                    yield out()
        if n:
            done.append(block(True))
        if done:
            yield out()

    ranged = slim.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return write_shared(ranged.select("key", "x").mapInArrow(run, schema), "blocks")


def split_keys(blocks: DataFrame) -> DataFrame:
    """(same): the keys of several blocks."""
    return blocks.filter("edge").groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("same"))


def whole_keys(blocks: DataFrame) -> DataFrame:
    edge = blocks.filter("edge").join(split_keys(blocks), F.col("key").eqNullSafe(F.col("same")), "left_anti")
    return blocks.filter("NOT edge").unionByName(edge)


def chunks(blocks: DataFrame, before: Callable[[int], int], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, chunk, start, at, total, mean, square, low, values) pieces of the split keys: the
    chunk of positions [c * size, (c + 1) * size), from ``start``, and ``before(total)`` values ahead of it,
    size being at least twice that many. ``total``, ``mean`` and ``square`` are the key's."""
    part = blocks.filter("edge").join(split_keys(blocks), F.col("key").eqNullSafe(F.col("same")), "left_semi")
    slim = part.select("key", "part", "place", "n", "mean", "square")
    key = W.partitionBy("key")
    counted = slim.select("*", F.sum("n").over(key).alias("total"), (F.sum(F.col("n") * F.col("mean")).over(key)
                                                                  / F.sum("n").over(key)).alias("whole"),
                          (F.sum("n").over(key.orderBy("part", "place")) - F.col("n")).alias("at"))     # one row a block
    counted = counted.select("*", F.sum(F.col("square") + F.col("n") * (F.col("mean") - F.col("whole")) ** 2).over(key).alias("all"))
    placed = part.select("key", "part", "place", "low", "values").join(
        counted.select(F.col("key").alias("k"), F.col("part").alias("p"), F.col("place").alias("q"), "at", "total", "whole", "all"),
        F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")) & (F.col("place") == F.col("q")))
    schema = T.StructType([key_field(part), *T.StructType.fromDDL(
        "chunk long, start long, at long, total long, mean double, square double, low double, `values` binary").fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [*[pa.int64()] * 4, *[pa.float64()] * 3, pa.binary()]

        def out(keys: pa.Array, pieces: list[tuple]) -> pa.RecordBatch:
            row, *columns = zip(*pieces)
            return pa.RecordBatch.from_arrays([keys.take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, types))],
                                              names=schema.names)

        for batch in batches:
            pieces, waiting = [], 0
            for row, (at, total, mean, square, low, raw) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), batch.column(6))):
                x = np.frombuffer(raw.as_buffer())
                ahead = before(total)
                size = max(block_rows, 2 * ahead)
                for c in range(at // size, min((at + len(x) + ahead - 1) // size, (total - 1) // size) + 1):
                    a, b = max(at, c * size - ahead), min(at + len(x), (c + 1) * size)
                    if a < b:
                        pieces.append((row, c, c * size, a, total, mean, square, low, x[a - at:b - at].tobytes()))
                        waiting += 8 * (b - a)
                        if len(pieces) >= BATCH_ROWS or waiting >= BATCH_BYTES:
                            yield out(batch.column(0), pieces)
                            pieces, waiting = [], 0
            if pieces:
                yield out(batch.column(0), pieces)

    return placed.select("key", "at", "total", F.col("whole").alias("mean"), F.col("all").alias("square"), "low", "values") \
        .mapInArrow(deal, schema)
