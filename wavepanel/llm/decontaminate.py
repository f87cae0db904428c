"""Benchmark decontamination by spaced-seed hashing.

A mask is a fixed window of word positions, some of which it ignores. The words
at the other positions are hashed, at every position of every benchmark item
and every document. With these masks any passage of 13 words or more in which
a fifth of the words is replaced still has a hit; items of fewer words have
shorter masks as well, with which a copy of the whole item always has one
(tests work both out).

Document hashes are first tried on a bitmap of the benchmark's hashes, whose
size is bounded; only hits are joined, on the hash. A hit puts an item beside
the document's words; the longest run of words that agrees at both ends and in
at least 80 % of its positions is the overlap. An item leaks into a document if
the overlap has 13 words, or the whole item if it is shorter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import bound_arrow_batches, text_or_empty, write_shared

MASKS = ("11111", "1110101", "10010111")
#: Beside these, for items that are shorter than an overlap. Documents are tried on them only if there are such items.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
#: Words of an overlap, share of them that agree, and fewest words of an item that takes part.
MIN_WORDS, MIN_SHARE, MIN_ITEM = 13, 0.8, 5
#: The bitmap has 256 bits for each of the benchmark's hashes, within these powers of two (2 to 16 MB). A fuller
#: bitmap lets more chance hits through to the join and loses none.
FILTER_BITS = (24, 27)
SALTS = 16
CACHE_WORDS = 200_000
GOLDEN = 0x9E3779B97F4A7C15
#: ASCII other than letters, digits and the underscore separates words, and so do these marks.
SEPARATORS = bytes(c if chr(c).isalnum() or c == 0x5F or c >= 0x80 else 0x20 for c in range(256))
MARKS = tuple(c.encode() for c in " «»¿¡·“”„‘’–—…　、。")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _Hashes()


def words_of(text: str) -> list[bytes]:
    raw = text.lower().encode()
    if not text.isascii():
        for mark in MARKS:
            if mark in raw:
                raw = raw.replace(mark, b" ")
    return raw.translate(SEPARATORS).split()


def word_hashes(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of ``words`` under a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2) * GOLDEN % (1 << 64), np.uint64)
    factor = 1
    with np.errstate(over="ignore"):
        for at, used in enumerate(mask):
            if used == "1":
                factor = factor * GOLDEN % (1 << 64)
                total += words[at:at + n] * np.uint64(factor)
        return _mixed(total)


def _bit_numbers(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint64((1 << bits) - 1)
    return [(hashes >> np.uint64(s)) & low for s in (0, (64 - bits) // 2, 64 - bits)]


def longest_overlap(agree: np.ndarray, share: float, agreeing_ends: bool = False) -> tuple[int, int]:
    """The longest [start, end) in which at least ``share`` agree, less what
    disagrees at its ends; (0, 0) if nothing agrees. With ``agreeing_ends`` only
    stretches that agree at both ends are tried, so none is longer than the one
    found; without, one padded by disagreements can win and then be cut."""
    padded = agree | (not agreeing_ends)
    may_start, may_end = [*padded.tolist(), not agreeing_ends], [not agreeing_ends, *padded.tolist()]
    gain = np.where(agree, 1000 - round(1000 * share), -round(1000 * share))
    height = [0, *np.cumsum(gain).tolist()]
    # starts worth trying have a lower height than all before them; ends are tried from the last on
    starts: list[int] = []
    for i, h in enumerate(height):
        if may_start[i] and (not starts or h < height[starts[-1]]):
            starts.append(i)
    start = end = 0
    for j in range(len(height) - 1, -1, -1):
        while may_end[j] and starts and height[starts[-1]] <= height[j]:
            if j - starts[-1] > end - start:
                start, end = starts[-1], j
            starts.pop()
    while start < end and not agree[start]:
        start += 1
    while end > start and not agree[end - 1]:
        end -= 1
    return start, end


def _items(benchmark: DataFrame, item_col: str, text: str, min_words: int) -> tuple[DataFrame, DataFrame, tuple[str, ...]]:
    """(items: item_id, item_hash, words; seeds: hash, item_id, item_hash, item_len, item_pos; masks used)."""
    slim = benchmark.select(benchmark[item_col].alias("item_id"), text_or_empty(benchmark, text).alias("text"))
    id_type = slim.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, word_hashes(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            rows = [(i, w) for i, w in rows if len(w) >= MIN_ITEM]
            found = []
            for _, words in rows:
                each = [seed_hashes(words, m) for m in MASKS + (SHORT_MASKS if len(words) < min_words else ())]
                found.append([{"hash": h, "pos": p} for hashes in each
                              for p, h in enumerate(hashes.view(np.int64).tolist())])
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], batch.schema.field(0).type),
                 pa.array([xxhash.xxh64_intdigest(w.tobytes()) >> 1 for _, w in rows], pa.int64()),
                 pa.array([w.tobytes() for _, w in rows], pa.binary()),
                 pa.array(found, pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())])))],
                names=["item_id", "item_hash", "words", "seeds"])

    made = slim.mapInArrow(run, f"item_id {id_type}, item_hash long, words binary, seeds array<struct<hash:long,pos:int>>")
    made = write_shared(made.dropDuplicates(["item_id", "item_hash"]), "benchmark")
    seeds = made.select("item_id", "item_hash", (F.length("words") / 8).cast("int").alias("item_len"), F.explode("seeds").alias("s"))
    seeds = seeds.select(F.col("s.hash").alias("hash"), "item_id", "item_hash", "item_len", F.col("s.pos").alias("item_pos"))
    masks = MASKS if seeds.filter(F.col("item_len") < min_words).isEmpty() else MASKS + SHORT_MASKS
    return made.select("item_id", "item_hash", "words"), seeds, masks


def _bitmap(seeds: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of the seed hashes, three bits each, made by Spark in pages."""
    n = seeds.count()
    bits = min(FILTER_BITS[1], max(FILTER_BITS[0], (256 * max(1, n) - 1).bit_length()))
    page = 4096 * 8
    low = (1 << bits) - 1
    numbers = F.array(*[F.shiftrightunsigned("hash", s).bitwiseAND(F.lit(low)) for s in (0, (64 - bits) // 2, 64 - bits)])
    pages = seeds.select(F.explode(numbers).alias("bit")).groupBy(F.floor(F.col("bit") / page).alias("page")) \
        .agg(F.bitmap_construct_agg(F.col("bit") % page).alias("map"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in pages.collect():        # at most 2^27 bits in all
        out[row.page * 4096:row.page * 4096 + 4096] = np.frombuffer(row.map, np.uint8)
    return out, bits


def _hits(docs: DataFrame, masks: tuple[str, ...], bitmap: np.ndarray, bits: int, id_col: str, text: str) -> DataFrame:
    """Documents with hits: id, text_hash, words, hits (hash, position)."""
    body = text_or_empty(docs, text)
    slim = docs.select(docs[id_col].alias("id"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    id_type = slim.schema["id"].dataType.simpleString()
    hit_type = pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [word_hashes(t) for t in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, each), np.int64, len(each))
            words = np.concatenate(each) if each else np.zeros(0, np.uint64)
            ends = np.cumsum(sizes)
            doc_of = np.repeat(np.arange(len(each)), sizes)
            rows, hashes, places = [], [], []
            for mask in masks:
                found = seed_hashes(words, mask)
                at = np.arange(len(found))
                for number in _bit_numbers(found, bits):
                    number = number[at]
                    at = at[(bitmap[number >> np.uint64(3)] >> (number & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                at = at[at + len(mask) <= ends[doc_of[at]]]          # windows within one document
                rows.append(doc_of[at])
                hashes.append(found[at])
                places.append(at - (ends - sizes)[doc_of[at]])
            row, key, place = (np.concatenate(x) for x in (rows, hashes, places))
            order = np.argsort(row, kind="stable")
            row, key, place = row[order], key[order].view(np.int64), place[order]
            docs_hit, first = np.unique(row, return_index=True)
            last = [*first[1:].tolist(), len(row)]
            take = pa.array(docs_hit, pa.int64())
            lists = [[{"hash": h, "pos": p} for h, p in zip(key[a:b].tolist(), place[a:b].tolist())]
                     for a, b in zip(first.tolist(), last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take),
                 pa.array([each[d].tobytes() for d in docs_hit.tolist()], pa.binary()), pa.array(lists, hit_type)],
                names=["id", "text_hash", "words", "hits"])

    return slim.mapInArrow(run, f"id {id_type}, text_hash long, words binary, hits array<struct<hash:long,pos:int>>")


def _verified(placed: DataFrame, min_words: int, min_share: float) -> DataFrame:
    schema = placed.schema
    types = ", ".join(f"{c} {schema[c].dataType.simpleString()}" for c in ("id", "text_hash", "item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n) for n in batch.schema.names}
            keep, out = [], []
            for row in range(batch.num_rows):
                doc = np.frombuffer(cols["words"][row].as_py(), np.uint64)
                item = np.frombuffer(cols["item_words"][row].as_py(), np.uint64)
                shift = cols["shift"][row].as_py()
                lo = max(0, -shift)
                same = doc == item[lo:lo + len(doc)]
                start, end = longest_overlap(same, min_share, agreeing_ends=True)
                agree = int(same[start:end].sum())
                if end - start >= min_words or agree >= min_share * len(item):
                    keep.append(row)
                    out.append((end - start, agree, lo + shift + start, lo + start, len(item)))
            take = pa.array(keep, pa.int64())
            numbers = np.array(out, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays(
                [cols[c].take(take) for c in ("id", "text_hash", "item_id")] +
                [pa.array(numbers[:, i], pa.int64()) for i in range(5)],
                names=["id", "text_hash", "item_id", "n_words", "n_agree", "doc_word", "item_word", "item_words"])

    return placed.mapInArrow(run, types + ", n_words long, n_agree long, doc_word long, item_word long, item_words long")


def _overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str, text: str, item_col: str, item_text: str,
              min_words: int, min_share: float) -> DataFrame:
    bound_arrow_batches(docs.sparkSession)
    items, seeds, masks = _items(benchmark, item_col, item_text, min_words)
    bitmap, bits = _bitmap(seeds)
    hit = write_shared(_hits(docs, masks, bitmap, bits, id_col, text), "hits")
    # a passage in many documents makes a hot hash: its hits are salted, the benchmark's few rows repeated
    salted = hit.select("id", "text_hash", F.explode("hits").alias("h")).select(
        "id", "text_hash", F.col("h.hash").alias("hash"), F.col("h.pos").alias("pos"),
        F.pmod(F.xxhash64("id", "text_hash"), F.lit(SALTS)).alias("salt"))
    seeds = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    placed = salted.join(seeds, ["hash", "salt"]).select(
        "id", "text_hash", "item_id", "item_hash", "item_len", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct()
    docs_once = hit.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), "words") \
        .dropDuplicates(["_id", "_hash"])
    beside = placed.join(docs_once, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    # of a document only the words beside the item go on, so a long document with many hits stays small
    shift = F.col("shift")
    part = F.substring("words", F.greatest(shift, F.lit(0)) * 8 + 1, (F.col("item_len") + F.least(shift, F.lit(0))) * 8)
    beside = beside.select("id", "text_hash", "item_id", "item_hash", "shift", part.alias("words"))
    items = items.select(F.col("item_id").alias("_item"), F.col("item_hash").alias("_item_hash"),
                         F.col("words").alias("item_words"))
    whole = beside.join(items, F.col("item_id").eqNullSafe(F.col("_item")) & (F.col("item_hash") == F.col("_item_hash"))) \
        .select("id", "text_hash", "item_id", "shift", "words", "item_words")
    return _verified(whole, min_words, min_share)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id",
          item_text: str = "text", min_words: int = MIN_WORDS, min_share: float = MIN_SHARE) -> DataFrame:
    """One row for each document id and benchmark item that leaked into it, with
    the longest overlap: ``n_words`` of it, ``n_agree`` of them equal,
    ``doc_word`` and ``item_word`` (where it starts, in words), ``item_words``,
    ``similarity`` (n_agree / n_words).

    Words are runs of letters, digits and underscores, in lower case. Null and
    empty texts have none; items of fewer than five words take no part. Texts of
    any length are compared whole. Repeated rows give one row; ids may be null.
    Of equally long overlaps the first in the document, then in the item, is
    named. Empty tables on either side give no rows.
    """
    found = _overlaps(docs, benchmark, id_col, text, item_col, item_text, min_words, min_share)
    best = found.groupBy("id", "item_id").agg(F.max(F.struct(
        "n_agree", "n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i"), "item_words")).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.n_words", "b.n_agree", (-F.col("b.d")).alias("doc_word"),
                       (-F.col("b.i")).alias("item_word"), "b.item_words",
                       F.round(F.col("b.n_agree") / F.col("b.n_words"), 6).alias("similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents into which no benchmark item leaked, all columns as they are.
    Null and empty texts and rows without id stay (unless their text leaks), repeated
    rows stay or go together; an empty table stays empty, an empty benchmark drops nothing."""
    found = _overlaps(docs, benchmark, id_col, text, "item_id", "text", MIN_WORDS, MIN_SHARE) \
        .select(F.col("id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].alias("_id"),
                       F.xxhash64(text_or_empty(docs, text)).alias("_hash"))
    return rows.join(found, F.col("_id").eqNullSafe(F.col("_leak_id")) & (F.col("_hash") == F.col("_leak_hash")),
                     "left_anti").select("row.*")
