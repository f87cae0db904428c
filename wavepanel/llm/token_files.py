"""Token-id files: documents in id order, ids packed in patched
frame-of-reference blocks (``pfor``).

Documents are dealt to ordered ranges of ``doc_id`` (ties by a hash of the
text, so a repeated id is spread), sorted within a range, encoded and packed
into files of bounded size. The files are the rows of a Parquet table in the
shared folder, so Spark's commit protocol makes them whole or absent when an
executor is lost. A file holds a run of documents: their ids, their token
counts and the packed tokens.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from wavepanel.llm import pfor
from wavepanel.llm.common import WordCache, bound_arrow_batches, byte_slices, shared_path, text_or_empty

#: A file is closed once it has so many ids; a longer document has a file of its own.
FILE_IDS = 1 << 20
CACHE_PARTS = 400_000
SLICE_BYTES = 8 << 20
LETTERS_AT_ONCE = 1000
#: Latin letters, but for the one whose lower case is not a single letter.
LATIN = "A-Za-zÀ-ÖØ-öø-įıĲ-ɏ"
LETTERS = re.compile(f"[{LATIN}]+")
#: ASCII marks other than apostrophes, around something that begins and ends in a Latin letter or an ASCII digit.
MARKS = r"[!-&(-/:-@\[-`{-~]*"
WRAPPED = f"(?s)^(?P<before>{MARKS})(?P<word>[0-9{LATIN}](?:.*[0-9{LATIN}])?)(?P<after>{MARKS})$"

FILES = T.StructType([
    T.StructField("range_no", T.LongType()), T.StructField("file_no", T.LongType()),
    T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()),
    T.StructField("tokens_before", T.LongType()),          # of the same range
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_tokens", T.BinaryType()),
    T.StructField("tokens", T.BinaryType()),
])


class WordEncoder:
    """Encodes texts with a lower-casing vocabulary that drops white space and
    whose words end in a marked token.

    Texts are cut at ASCII white space, and ASCII marks around a segment's letters
    apart from these, as the library's own word splitting does; Arrow's kernels
    do it for many texts at once. Each distinct part is encoded once, and a
    text's ids are those of its parts in order. Unknown runs of Latin letters go
    to the library as one text of many words, whose ids are cut behind the
    tokens that end a word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        # as of the stored settings, no padding or truncation takes place here
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        probe = ["a", "b", "c", "'d", "e", "(", "éa", ").", "x0"]
        self.cuts = self._ids(["a b\t\nc 'd e (ÉA). X0"])[0] == b"".join(self._ids(probe))
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = "|".join(re.escape(x) for x in added) or "[^\\s\\S]"
        self.cache = WordCache(CACHE_PARTS)

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters, many in a call."""
        out: list[bytes] = []
        for at in range(0, len(words), LETTERS_AT_ONCE):
            some = words[at:at + LETTERS_AT_ONCE]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(some):
                raw, stops = ids.tobytes(), (4 * stops).tolist()
                out += [raw[a:b] for a, b in zip([0, *stops], stops)]
            else:
                out += self._ids(some)
        return out

    def _make_parts(self, words: list[str]) -> list[bytes]:
        plain = [w for w in words if LETTERS.fullmatch(w)]
        known = dict(zip(plain, self._letters(plain)))
        other = [w for w in words if w not in known]
        known.update(zip(other, self._ids(other)))
        return [known[w] for w in words]

    def _parts(self, segments: pa.Array) -> list[pa.Array]:
        """What stands before, in and after the letters of each segment, to be
        encoded apart; a segment not of that form is whole in the middle."""
        found = pc.extract_regex(segments, WRAPPED)
        whole = pc.or_(pc.is_null(found), pc.match_substring_regex(segments, self.added))
        empty = pa.scalar("", segments.type)
        before, word, after = (found.field(i) for i in range(3))
        return [pc.if_else(whole, empty, before), pc.if_else(whole, segments, pc.utf8_lower(word)),
                pc.if_else(whole, empty, after)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not self.cuts:
            each = [np.frombuffer(x, "<u4") for x in self._ids(texts.to_pylist())]
            return np.concatenate([np.zeros(0, "<u4"), *each]), np.array([len(x) for x in each], np.int64)
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        n_words = np.diff(words.offsets.to_numpy())
        coded = words.flatten().dictionary_encode()
        columns = self._parts(coded.dictionary)
        parts = pa.concat_arrays(columns).dictionary_encode()
        known = parts.dictionary.to_pylist()
        values = self.cache.take(known, self._make_parts)
        raw = [values[p] for p in known]
        ids = np.frombuffer(b"".join(raw), "<u4")
        sizes = np.array([len(x) for x in raw], np.int64) // 4
        firsts = np.cumsum(sizes) - sizes
        # each word's three parts in order, then each part's ids
        by_segment = parts.indices.to_numpy().reshape(3, -1).T
        order = by_segment[coded.indices.to_numpy()].reshape(-1)
        order = order[sizes[order] > 0]
        length = sizes[order]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        out = ids[np.repeat(firsts[order] - (ends - length), length) + np.arange(total)]
        per_segment = sizes[by_segment].sum(axis=1)
        before = np.concatenate(([0], np.cumsum(per_segment[coded.indices.to_numpy()])))
        edges = np.concatenate(([0], np.cumsum(n_words)))
        return out, np.diff(before[edges])


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    if path not in _LOADED:
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def _slices(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    """The two columns of the batches, put together and cut by bytes of text."""
    held: list[pa.RecordBatch] = []

    def cut() -> Iterator[tuple[pa.Array, pa.Array]]:
        keys, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(2))
        for a, b in byte_slices(pc.binary_length(texts).to_pylist(), limit):
            yield keys.slice(a, b - a), texts.slice(a, b - a)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.nbytes for b in held) >= limit:
            yield from cut()
            held = []
    if held:
        yield from cut()


def write_token_files(df: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text",
                      path: str | None = None) -> str:
    """Encode every text (null: empty), append ``end_id`` to each, and write the
    ids in ascending order of (id, text); null ids come first. Returns the path
    of the files. Repeated rows are written as often as they come.
    Texts of any length are encoded whole; an empty table gives no documents."""
    spark = df.sparkSession
    bound_arrow_batches(spark)
    path = path or shared_path(spark, "token-files")
    slim = df.select(df[id_col].cast("long").alias("_id"), text_or_empty(df, text).alias("_text"))
    tie = F.xxhash64("_text")
    ordered = slim.repartitionByRange("_id", tie).sortWithinPartitions("_id", tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, range_no = loaded(vocabulary), TaskContext.get().partitionId()
        file_no, before, ids, counts, parts, total = 0, 0, [], [], [], 0

        def closed() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            return pa.RecordBatch.from_arrays([
                pa.array([range_no], pa.int64()), pa.array([file_no], pa.int64()), pa.array([len(ids)], pa.int64()),
                pa.array([len(tokens)], pa.int64()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([pfor.encode(np.array(counts, "<u4"))], pa.binary()),
                pa.array([pfor.encode(tokens)], pa.binary())], names=FILES.fieldNames())

        for keys, texts in _slices(batches, SLICE_BYTES):
            tokens, sizes = encoder.encode(texts)
            # the end id goes behind each document
            ends = np.cumsum(sizes)
            tokens = np.insert(tokens, ends, end_id).astype("<u4")
            at = 0
            for key, n in zip(keys.to_pylist(), (sizes + 1).tolist()):
                if ids and total + n > FILE_IDS:
                    yield closed()
                    file_no, before, ids, counts, parts, total = file_no + 1, before + total, [], [], [], 0
                ids.append(key)
                counts.append(n)
                parts.append(tokens[at:at + n])
                at, total = at + n, total + n
        if ids:
            yield closed()

    ordered.mapInArrow(run, FILES).write.parquet(path)
    return path


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id``, ``start`` (ids of all documents before
    it), ``n_tokens`` (with the end id), ``ids`` (u32 little-endian).

    A file knows what stands before it in its range; the running sum over the
    ranges needs one row for each writing task and is broadcast."""
    bound_arrow_batches(spark)
    files = spark.read.schema(FILES).parquet(path)
    earlier = W.orderBy("range_no").rowsBetween(W.unboundedPreceding, -1)
    ranges = files.groupBy("range_no").agg(F.sum("n_tokens").alias("n")).select(
        "range_no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_range_start"))
    located = files.join(F.broadcast(ranges), "range_no").select(
        (F.col("_range_start") + F.col("tokens_before")).alias("_start"), "doc_ids", "doc_tokens", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, ids = batch.column(0)[row].as_py(), batch.column(1)[row].as_py()
                counts = pfor.decode(batch.column(2)[row].as_py()).astype(np.int64)
                raw = pfor.decode(batch.column(3)[row].as_py()).astype("<u4").tobytes()
                ends = np.cumsum(counts)
                begins = ends - counts
                docs = [raw[4 * a:4 * b] for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(begins + first, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array(docs, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return located.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def id_checksums(docs: DataFrame) -> DataFrame:
    """``ids_crc32`` (unsigned) in place of the ids."""
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
