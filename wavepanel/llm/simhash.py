"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link at r = 3 or fewer differing bits. Half the radius is 1,
and balls of radius 1 around both meet if they differ in 2 bits. The odd third
bit is met by masking: the 64 bits form three blocks, and if two fingerprints
differ in 1 to 3 bits, masking a block that holds one of these leaves at most
2. So every fingerprint emits, for each masked block, all variants within one
bit (129 in all); two fingerprints that link share a masked variant. (Balls of
radius 2 need 2,081 variants.)

Variants are shuffled and grouped. A group of two is a candidate pair, which is
verified on all 64 bits. The few fingerprints in larger groups are linked
without forming pairs: they emit all variants within two bits of the whole
fingerprint, and all members of such a group link to one that is within one
bit of the variant, if there is one; any two that differ in at most 3 bits
meet this way, and members linked this way differ in at most 1 + 2 bits.

Documents with equal fingerprints are one node from the start, so groups of
copies of any size cost as much as one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavepanel.llm.common import bound_arrow_batches, text_or_empty, write_shared
from wavepanel.llm.components import components

BITS = 64
BLOCKS = 3
SEED = 42
#: Bits of each byte value, by bit position.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str, shingle: int = 3) -> int:
    """Majority bits of the hashes of the word shingles, repeats included; a
    shorter text is one shingle, a text without words has fingerprint zero."""
    words = text.encode().lower().split()       # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) < shingle else \
        list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(p, SEED) for p in parts), np.uint64, len(parts)).astype("<u8").view(np.uint8).reshape(-1, 8)
    value = 0
    for byte in range(8):
        ones = np.bincount(hashes[:, byte], minlength=256) @ BYTE_BITS
        value |= int(((2 * ones > len(parts)) << np.arange(8)).sum()) << (8 * byte)
    return value


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ``text_hash``, ``fp`` long) for each row, a null text counts as empty."""
    bound_arrow_batches(df.sparkSession)
    body = text_or_empty(df, text)
    slim = df.select(df[id_col].alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint(t, shingle)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64())],
                                             names=["id", "text_hash", "fp"])

    return slim.mapInArrow(run, f"id {id_type}, text_hash long, fp long")


def _flips(bits: list[int], radius: int) -> list[tuple[int, int]]:
    """(xor mask, number of bits) of all flips of at most ``radius`` of the bits."""
    return [(_signed(reduce(lambda m, b: m | 1 << b, chosen, 0)), n) for n in range(radius + 1)
            for chosen in combinations(bits, n)]


def _balls(prints: DataFrame, radius: int, masked: bool) -> DataFrame:
    """(variant, fp): all variants within ``radius`` bits, of each masked form if
    asked. Masks share the column: a chance meeting of two is verified away."""
    edges = [round(i * BITS / BLOCKS) for i in range(BLOCKS + 1)]
    spaces = [range(a, b) for a, b in zip(edges, edges[1:])] if masked else [range(0)]
    steps = []
    for block in spaces:
        free = [b for b in range(BITS) if b not in block]
        keep = _signed(reduce(lambda m, b: m | 1 << b, free, 0))
        steps += [(keep, flip) for flip, _ in _flips(free, radius)]
    step = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("keep"), F.lit(f).cast("long").alias("flip"))
                               for k, f in steps]))
    return prints.select("fp", step.alias("s")) \
        .select(F.col("fp").bitwiseAND(F.col("s.keep")).bitwiseXOR(F.col("s.flip")).alias("variant"), "fp")


def _apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def links(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """Edges (a, b) that connect whatever fingerprints differ in at most
    ``max_bits`` (0 to 3) bits. ``prints``: distinct values in column ``fp``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits is 0 to 3")
    half, odd = divmod(max_bits, 2)
    # one shuffle finds the groups and their members: a variant is rarely seen twice, so the rows left are few
    same = W.partitionBy("variant")
    met = _balls(prints, half, bool(odd)).select("variant", "fp", F.count(F.lit(1)).over(same).alias("n"),
                                                 F.min("fp").over(same).alias("a"), F.max("fp").over(same).alias("b"))
    met = write_shared(met.filter("n > 1 AND a <> b"), "variants")
    pairs = met.filter("n = 2 AND fp = a").filter(_apart("a", "b") <= max_bits).select("a", "b").distinct()
    crowd = met.filter("n > 2").select("fp").distinct()
    wide = _flips(list(range(BITS)), half + odd)
    step = F.explode(F.array(*[F.struct(F.lit(f).cast("long").alias("flip"), F.lit(n).alias("bits")) for f, n in wide]))
    near = crowd.select("fp", step.alias("s")).select(
        F.col("fp").bitwiseXOR(F.col("s.flip")).alias("variant"), "fp", F.col("s.bits").alias("bits"))
    middle = F.min(F.when(F.col("bits") <= half, F.col("fp"))).over(W.partitionBy("variant"))
    stars = near.withColumn("middle", middle).filter(F.col("middle").isNotNull() & (F.col("middle") != F.col("fp"))) \
        .filter(_apart("middle", "fp") <= max_bits).select(F.col("middle").alias("a"), F.col("fp").alias("b")).distinct()
    return pairs.union(stars)


def groups_of(df: DataFrame, shingle: int, max_bits: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows: id, text_hash, fp; groups: fp, first), where ``first`` holds the
    smallest (id is null, id, text_hash) of the group that a fingerprint is in."""
    rows = write_shared(fingerprints(df, shingle, id_col, text), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")).alias("first"))
    nodes = write_shared(nodes, "nodes")
    roots = components(links(nodes.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("first").alias("group_first"))
    return rows, rooted.join(firsts, "root").select("fp", F.col("group_first").alias("first"))


def near_duplicates(df: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 lowercase hex digits),
    ``component_id`` (smallest id of all documents reachable by links, itself
    included; null if none of them has an id). Null and empty texts have
    fingerprint zero and link like any other.
    Texts of any length are fingerprinted whole, repeated rows
    are each returned, and an empty table gives no rows."""
    rows, groups = groups_of(df, shingle, max_bits, id_col, text)
    return rows.join(groups, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("first.id").alias("component_id"))


def keep_one(df: DataFrame, shingle: int = 3, max_bits: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The input with one row of each group of near-duplicates: that of the
    smallest id (then text hash; rows without id come last).
    Null and empty texts are one group; an empty table stays empty."""
    _, groups = groups_of(df, shingle, max_bits, id_col, text)
    kept = groups.select(F.col("first.id").alias("_kept_id"), F.col("first.text_hash").alias("_kept_hash")).distinct()
    row, key = F.struct(*[df[c] for c in df.columns]).alias("row"), F.xxhash64(text_or_empty(df, text)).alias("_hash")
    rows = df.select(row, df[id_col].alias("_id"), key)
    # rows that repeat the kept one, id and text alike, are the same document
    found = rows.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    return found.dropDuplicates(["_id", "_hash"]).select("row.*")
