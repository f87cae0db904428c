"""Token counts of whole texts, lengths only.

A text is cut at safe boundaries: before a run of spaces that follows another
character. No piece of the vocabulary holds a space after another character
(checked when the model is loaded), so no merge crosses such a cut and the
counts of the segments add up to the count of the text. Arrow batches are
worked off in slices of bounded bytes; a slice's new segments are encoded in
one call, and only their lengths are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from wavepanel.llm.common import WordCache, bound_arrow_batches, byte_slices, text_or_empty

SPACE = "▁"
SEGMENT = re.compile(" *[^ ]+| +$")
CACHE_SEGMENTS = 250_000
SLICE_BYTES = 4 << 20


class PieceCounter:
    """Counts the tokens of texts for one sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # identity normalisation with a space before the text, and no piece with a space after another character
        probe = "ﬁ  Å\ta "
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in pieces) and \
            self.model.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.cache = WordCache(CACHE_SEGMENTS)
        #: tokens of a lone space at the end of a text
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))

    def segments(self, text: str) -> list[str]:
        """Segments without the space that the model puts before each."""
        text = text.replace(SPACE, " ")
        if not text:
            return []
        if not (text[0] == " " or text[-1] == " " or "  " in text):
            return text.split(" ")
        found = SEGMENT.findall(text)
        return [found[0], *(s[1:] for s in found[1:])]

    def count(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        split = [self.segments(t) for t in texts]
        get = self.cache.take(set().union(*split), self._lengths).__getitem__
        return [sum(map(get, segments)) for segments in split]

    def _lengths(self, segments: list[str]) -> list[int]:
        counts = [len(x) for x in self.model.encode(segments, num_threads=1)]
        return [n if s else self.lone_space for s, n in zip(segments, counts)]


_LOADED: dict[str, PieceCounter] = {}


def loaded(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def token_counts(df: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``,
    ``over_limit`` (more than ``limit`` tokens). A null text counts as empty:
    no bytes, no tokens. Null and repeated ids are kept as they are.
    Texts of any length count whole, in slices; an empty table gives no rows."""
    bound_arrow_batches(df.sparkSession)
    slim = df.select(df[id_col], text_or_empty(df, text).alias("_text"))
    id_type = slim.schema.fields[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) for t in texts]
            counts: list[int] = []
            for a, b in byte_slices(sizes, SLICE_BYTES):
                counts += counter.count(texts[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())],
                names=[batch.schema.names[0], "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
