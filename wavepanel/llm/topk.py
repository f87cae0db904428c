"""Exact top-k search by integer inner product on a bit-sliced index.

Index: the vectors are dealt to blocks. In a block, each attribute is stored as
offset binary numbers, one bitmap over the block's rows for each bit (slice).
The slices are made once and written to the shared folder; the search reads them.

Search: a query's score is a sum of attributes times small integers, so it is
a sum of slices, shifted by the bits of the query's components. Slices of equal
weight are added as bitmaps by carry-save adders, three into two, whose carries
join the next weight; a negative component uses the complement of its slices,
which leaves a constant to subtract. That gives the slices of all scores of the
block. The best k rows are then selected from the most significant slice
downward: rows with the bit set go ahead while there are more than k of them,
and are taken when there are not. Rows that are level to the last slice are
resolved exactly by their ids.

Queries go in batches to every index block (each row's search must see every
row); a block returns at most k rows for a query, so nothing larger meets in
the final ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from wavepanel.llm.common import write_shared

#: Vectors of an index block, queries of a batch, and batches that one task works off, about.
BLOCK_ROWS, BATCH_ROWS, TASK_BATCHES = 16_384, 256, 8
PACKED = "block long, dims int, ids binary, comps binary"
INDEX = "block long, dims int, bits int, ids binary, low binary, slices binary"
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(df: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, comps): floor(scale * x) of each component. Rows without id, vectors
    that are null or hold null or non-finite components take no part."""
    whole = F.forall(vec_col, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.filter(df[id_col].isNotNull() & df[vec_col].isNotNull()).filter(whole)
    comps = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(rows[id_col].cast("long").alias("id"), comps.alias("comps"))


def pack(rows: DataFrame, n_blocks: int, dims: int) -> DataFrame:
    """Deal rows evenly to ``n_blocks`` blocks, each one row of ids (ascending)
    and of a components matrix; vectors shorter than ``dims`` end in zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, mats = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            comps = batch.column(1)
            lengths = np.diff(comps.offsets.to_numpy())
            mat = np.zeros((batch.num_rows, dims), "<i8")
            mat[np.arange(dims)[None, :] < lengths[:, None]] = comps.flatten().to_numpy()
            ids.append(batch.column(0).to_numpy())
            mats.append(mat)
        if ids:
            all_ids, mat = np.concatenate(ids), np.concatenate(mats)
            order = np.lexsort((*mat.T[::-1], all_ids)) if dims else np.argsort(all_ids, kind="stable")
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([dims], pa.int32()),
                 pa.array([all_ids[order].astype("<i8").tobytes()], pa.binary()),
                 pa.array([mat[order].tobytes()], pa.binary())], names=["block", "dims", "ids", "comps"])

    return rows.repartition(n_blocks).mapInArrow(run, PACKED)


def slices_of(comps: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Offsets (dims), bitmaps (dims, bits, words) and bits of a block."""
    n, dims = comps.shape
    low = comps.min(axis=0)
    shifted = (comps - low).T
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    words = -(-n // 64)
    out = np.zeros((dims, bits, words * 8), np.uint8)
    for b in range(bits):
        raw = np.packbits(((shifted >> b) & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, :raw.shape[1]] = raw
    return low, out.view(np.uint64), bits


def index_of(rows: DataFrame, n_blocks: int, dims: int) -> DataFrame:
    """The bit-sliced index, a row a block: ids (ascending), offsets, slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, maps, bits = slices_of(_matrix(row["comps"], row["dims"]))
                cells = (row["block"], row["dims"], bits, row["ids"], low.astype("<i8").tobytes(), maps.astype("<u8").tobytes())
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([c], kind) for c, kind in zip(cells, kinds)],
                                                 names=["block", "dims", "bits", "ids", "low", "slices"])

    return write_shared(pack(rows, n_blocks, dims).mapInArrow(run, INDEX), "topk-index")


def _with_complements(raw: bytes, dims: int, bits: int) -> np.ndarray:
    """Bitmaps (dims, 2, bits, words): the slices and their complements."""
    maps = np.frombuffer(raw, "<u8").reshape(dims, bits, -1)
    return np.stack((maps, ~maps), axis=1)


def sum_slices(columns: list[np.ndarray], maps: np.ndarray) -> list[np.ndarray]:
    """Add bitmaps: ``columns[w]`` numbers the rows of ``maps`` of weight 2^w."""
    out: list[np.ndarray] = []
    carries: list[np.ndarray] = []
    while len(out) < len(columns) or carries:
        own = [maps[columns[len(out)]]] if len(out) < len(columns) and len(columns[len(out)]) else []
        rows = np.concatenate(own + carries) if own or carries else np.zeros((1, maps.shape[1]), np.uint64)
        carries = []
        while len(rows) > 2:
            m = len(rows) // 3
            x, y, z = rows[:m], rows[m:2 * m], rows[2 * m:3 * m]
            odd = x ^ y
            carries.append((x & y) | (odd & z))
            rows = np.concatenate((odd ^ z, rows[3 * m:]))
        if len(rows) == 2:
            carries.append((rows[0] & rows[1])[None])
            rows = (rows[0] ^ rows[1])[None]
        out.append(rows[0])
    return out


def select_top(slices: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are surely among the best k, and the level ones that fill up the rest."""
    count = lambda m: int(np.bitwise_count(m).sum())
    none = np.zeros_like(alive)
    if count(alive) <= k:
        return alive, none
    sure, level, n_sure = none.copy(), alive.copy(), 0
    for bitmap in reversed(slices):
        ahead = level & bitmap
        n = count(ahead)
        if n_sure + n > k:
            level = ahead
        else:
            sure |= ahead
            n_sure += n
            level &= ~bitmap
            if n_sure == k:
                return sure, none
    return sure, level


def row_numbers(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def search_block(low: np.ndarray, maps: np.ndarray, bits: int, ids: np.ndarray, query_id: int, query: np.ndarray,
                 k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of a block's best k rows for one query."""
    n, words = len(ids), maps.shape[-1]
    alive = np.full(words, ONES)
    if n % 64:
        alive[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
    for own in range(np.searchsorted(ids, query_id), np.searchsorted(ids, query_id, "right")):
        alive[own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    size, negative = np.abs(query), (query < 0).astype(np.int64)
    base = (2 * np.arange(len(query)) + negative) * bits
    n_bits = int(size.max(initial=0)).bit_length()
    columns: list[list[np.ndarray]] = [[] for _ in range(n_bits + bits - 1 if n_bits else 0)]
    for i in range(n_bits):
        rows = base[(size >> i) & 1 == 1]
        for j in range(bits):
            columns[i + j].append(rows + j)
    flat = maps.reshape(-1, words)
    slices = sum_slices([np.concatenate(c) for c in columns], flat)
    constant = int(query @ low) - int(size[query < 0].sum()) * ((1 << bits) - 1)
    sure, level = select_top(slices, alive, k)
    best = row_numbers(sure)
    if len(best) < k:
        best = np.concatenate((best, row_numbers(level)[:k - len(best)]))
    word, bit = best // 64, (best % 64).astype(np.uint64)
    scores = np.full(len(best), constant, np.int64)
    for w, bitmap in enumerate(slices):
        scores += ((bitmap[word] >> bit) & np.uint64(1)).astype(np.int64) << w
    return ids[best], scores


def _matrix(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(-1, dims)


def _search(k: int):
    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        query_ids, found_ids, found_scores = [], [], []
        if index.num_rows and queries.num_rows:
            dims = index["dims"][0].as_py()
            ids = np.frombuffer(index["ids"][0].as_py(), "<i8")
            bits, low = index["bits"][0].as_py(), np.frombuffer(index["low"][0].as_py(), "<i8")
            maps = _with_complements(index["slices"][0].as_py(), dims, bits)
            for row in range(queries.num_rows):
                qids = np.frombuffer(queries["ids"][row].as_py(), "<i8")
                for qid, query in zip(qids.tolist(), _matrix(queries["comps"][row].as_py(), dims)):
                    best, scores = search_block(low, maps, bits, ids, qid, query, k)
                    query_ids.append(np.full(len(best), qid))
                    found_ids.append(best)
                    found_scores.append(scores)
        join = lambda parts: pa.array(np.concatenate(parts) if parts else [], pa.int64())
        return pa.table({"query_id": join(query_ids), "vec_id": join(found_ids), "score": join(found_scores)})
    return run


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row with ``is_query`` (a
    condition on the column ``id``), the k other rows of highest inner product
    of floor(scale * x), ties to the smaller id; all rows if fewer.

    Candidates are all rows of another id. Of query rows that share an id, the
    first vector in array order asks; as candidates, repeated rows each count.
    Shorter vectors count as ending in zeros. An empty table gives no rows.
    Other columns of ``df``, whatever their names, take no part.
    """
    rows = write_shared(quantised(df, scale, id_col, vec_col), "topk-rows")
    asking = rows.filter(is_query).groupBy("id").agg(F.min("comps").alias("comps"))
    n, dims, n_queries = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("comps")), F.lit(0)),
                                  F.count_distinct(F.when(is_query, F.col("id")))).first()
    n_blocks, n_batches = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_queries // BATCH_ROWS))
    n_tasks = -(-n_batches // TASK_BATCHES)
    index = index_of(rows, n_blocks, max(1, dims)).withColumn("task", F.explode(F.sequence(F.lit(0), F.lit(n_tasks - 1))))
    batches = pack(asking, n_batches, max(1, dims)).withColumn("task", (F.col("block") % n_tasks).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    found = index.groupBy("block", "task").cogroup(batches.groupBy("block", "task")) \
        .applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
