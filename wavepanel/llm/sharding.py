"""Sharding by jump consistent hashing.

A key's shard follows from its hash and the number of shards alone, without a
ring table: a generator seeded by the key jumps over shard numbers until it
passes the last one. With one more shard, a key either stays or moves to the
new shard, and 1/(n+1) of the keys move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavepanel.llm.common import text_or_empty, write_shared

#: Fixed values of the published jump consistent hash.
MULTIPLIER = np.uint64(2862933555777941757)
TWO_31 = float(1 << 31)
#: Rows of a slot bucket, about.
BUCKET_ROWS = 50_000


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, 0 to ``shards`` - 1."""
    state = np.ascontiguousarray(keys).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = jump[live]
        with np.errstate(over="ignore"):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
        step = TWO_31 / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        jump[live] = ((shard[live] + 1).astype(np.float64) * step).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def jump_shard(key: Column, shards: int) -> Column:
    """Shard of a long key column (a stable hash of the row's key)."""

    @F.arrow_udf("int")
    def shard_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for keys in batches:
            yield pa.array(jump_hash(keys.to_numpy(zero_copy_only=False), shards).astype(np.int32))

    return shard_of(key)


def shard_documents(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``size`` (UTF-8 bytes of the text, plus 1;
    a null text has none), ``text_crc32`` (unsigned), ``law`` = 'key', ``shard``,
    ``slot`` (0, 1, 2 ... within the shard), ``grown_shard`` (with one shard more).

    Rows of one id share a shard, null ids count as one key. Slots follow
    (bucket, id, checksum, size), where the bucket is a hash of these three:
    the count of each (shard, bucket) gives where a bucket's slots begin, and
    rows are numbered within a bucket only, so no task holds a whole shard.
    Rows equal in all three differ in nothing that is returned: they are counted
    before any shuffle, and given their slots in runs of ``BUCKET_ROWS``, so a
    row that is repeated any number of times is no hot bucket. Null and empty
    texts and very long ones are sized like others; an empty table gives no rows.
    """
    body = text_or_empty(df, text)
    sized = df.select(df[id_col].alias(id_col), (F.octet_length(body) + 1).cast("long").alias("size"),
                      F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    key = F.xxhash64(F.col(id_col))
    what = [id_col, "size", "text_crc32"]
    # written once: the counts and the slots must see the same rows, and the texts are read only here
    rows = write_shared(sized.groupBy(*what).agg(F.count(F.lit(1)).alias("_n")).select(
        "*", jump_shard(key, shards).alias("shard"), jump_shard(key, shards + 1).alias("grown_shard")), "shards")
    n_buckets = max(1, -(-rows.count() // BUCKET_ROWS))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "text_crc32", "size"), F.lit(n_buckets)))
    counts = rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    earlier = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_start"))
    in_bucket = W.partitionBy("shard", "_bucket").orderBy(id_col, "text_crc32", "size")
    numbered = rows.withColumn("_first", F.sum("_n").over(in_bucket.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    placed = numbered.join(starts, ["shard", "_bucket"]).withColumn("_first", F.col("_start") + F.col("_first"))
    last = F.col("_first") + F.col("_n") - 1
    runs = placed.select(*what, "shard", "grown_shard", last.alias("_last"),
                         F.explode(F.sequence("_first", last, F.lit(BUCKET_ROWS).cast("long"))).alias("_from"))
    # the runs of one row are dealt out; a row by itself is a run of one
    runs = runs.repartition("shard", "_from")
    to = F.least(F.col("_last"), F.col("_from") + BUCKET_ROWS - 1)
    return runs.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                       F.explode(F.sequence("_from", to)).alias("slot"), "grown_shard")
