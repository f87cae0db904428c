"""Toxicity by multiple-instance learning.

A document is a bag of sentences. With z the bias and the weights of a sentence's
distinct words, its score is p = max(0, s(z) - s(bias)) / (1 - s(bias)), s the
logistic function: a sentence without evidence has none. Labels are known for
documents only. A document's score is the noisy-or 1 - (1 - s(bias)) prod(1 - p)
over all its sentences, wherever they stand, the bias being the chance that a
document without evidence is toxic; it counts once, so length alone adds nothing.
The weights are learned through this same score, so that a sentence comes to
stand out if it helps to tell toxic documents from others, and offending
sentences are located by their own scores.

A word's weight is the sum of the weights of its features: the word and its
beginnings of 4, 5 and 6 letters. Features whose share of toxic documents could be
chance have none, else they would add up in long clean texts. Weights are
not negative, and learned by proximal Adam steps with an L1 penalty. The training
documents, a bounded sample, are a table of features in the shared folder; each
step is a Spark job that sums gradients.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.common import bound_arrow_batches, text_or_empty, write_shared

#: Most labelled documents that the model is fitted on (those of smallest hash).
TRAIN_ROWS = 20_000
TRAIN_PARTS = 6
STEPS, RATE, L1 = 60, 0.3, 2e-4
#: Logit of a sentence without evidence.
BIAS = -7.0
#: Fewest training documents that have a feature.
LEAST_DOCS = 3
BEGINNINGS = (4, 5, 6)
CACHE_WORDS = 150_000
LIMIT = 30.0
#: Sentences end at . ! ? and line ends; other ASCII marks separate words.
BREAKS = bytes(0x0A if c in b".!?\n" else c if chr(c).isalnum() or c == 0x5F or c >= 0x80 else 0x20 for c in range(256))
SENTENCE = re.compile(r"[^.!?\n]*")


def sentences(text: str) -> list[list[bytes]]:
    """Words of each stretch between sentence ends, empty ones included."""
    return [s.split() for s in text.lower().encode().translate(BREAKS).split(b"\n")]


def features(word: bytes) -> list[str]:
    w = word.decode("utf-8", "replace")
    return [w, *(w[:n] + "*" for n in BEGINNINGS if len(w) > n)]


@dataclass
class Model:
    """Weights of features, and the bias of a sentence."""

    bias: float
    weights: dict[str, float]
    _words: dict[bytes, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "_words": {}}

    def weight(self, word: bytes) -> float:
        known = self._words.get(word)
        if known is None:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            get = self.weights.get
            known = self._words[word] = sum(get(f, 0.0) for f in features(word))
        return known

    def logits(self, text: str) -> tuple[list[int], list[float]]:
        """Numbers and logits of the sentences that have words; a text without
        words is one empty sentence."""
        weight, numbers, out = self.weight, [], []
        for i, words in enumerate(sentences(text)):
            if words:
                numbers.append(i)
                out.append(self.bias + sum(map(weight, set(words))))
        return (numbers, out) if out else ([0], [self.bias])

    def document_score(self, logits: np.ndarray) -> float:
        """The noisy-or of the bias and of all sentences."""
        return float(-np.expm1(-softplus(self.bias) - evidence(logits, self.bias).sum()))

    def sentence_score(self, logit: float) -> float:
        return float(-np.expm1(-evidence(np.array([logit]), self.bias)[0]))


def softplus(z):
    return np.logaddexp(0.0, np.clip(z, -LIMIT, LIMIT))


def evidence(logits: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of each sentence: what its words raise it above the bias."""
    return np.maximum(0.0, softplus(logits) - softplus(bias))


def held_out(id_col: Column) -> Column:
    """Documents whose labels are never learned from; a missing id is not one."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, rows: int) -> DataFrame:
    """(text, y) of at most ``rows`` labelled documents that aren't held out. Of
    several labels of an id the largest counts, of several texts the first in
    order; labels other than 0 and 1 are left out."""
    known = labels.filter(labels[label].isin(0, 1) & labels[id_col].isNotNull() & ~held_out(labels[id_col])) \
        .groupBy(labels[id_col].alias("_id")).agg(F.max(label).alias("y"))
    # only labels of documents that are there
    present = docs.select(docs[id_col].alias("_id")).distinct()
    chosen = known.join(present, "_id", "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(docs[id_col].alias("_id"), text_or_empty(docs, text).alias("text"))
    # at most TRAIN_ROWS ids and labels
    joined = texts.join(F.broadcast(chosen), "_id")
    return joined.groupBy("_id").agg(F.min("text").alias("text"), F.first("y").cast("int").alias("y")) \
        .select("text", "y", F.xxhash64("_id").alias("_order"))


def _sentence_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words)) - (1 << 63)


def _feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n, k): documents and toxic documents that have it. A sentence that
    several documents share counts for the first of them, so copies of a document add nothing."""
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list({_sentence_key(s) for s in sentences(t) if s}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["_order", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                own = set(own)
                found.append(list({f for s in sentences(text) if s and _sentence_key(s) in own for w in s for f in features(w)}))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["y", "f"])

    each = rows.select("text", "_order").mapInArrow(keys, "_order long, keys array<long>").select("_order", F.explode("keys").alias("key"))
    own = each.groupBy("key").agg(F.min("_order").alias("_order")).groupBy("_order").agg(F.collect_list("key").alias("own"))
    return rows.join(own, "_order").select("text", "y", "own").mapInArrow(run, "y int, f array<string>") \
        .select("y", F.explode("f").alias("feature")).groupBy("feature") \
        .agg(F.count(F.lit(1)).alias("n"), F.sum("y").cast("long").alias("k"))


def telling(n: np.ndarray, k: np.ndarray, rate: float) -> np.ndarray:
    """Features that are in toxic documents more often than about one of so many
    features would be by chance (n KL(k/n, rate) at least the logarithm of their
    number)."""
    share = k / n
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(k > 0, k * np.log(share / rate), 0.0) + np.where(k < n, (n - k) * np.log((1 - share) / (1 - rate)), 0.0)
    return (share > rate) & (gain >= np.log(max(2, len(n))))


def _bags(rows: DataFrame, numbers: dict[str, int]) -> DataFrame:
    """(y, feats, sizes): feature numbers of each sentence's distinct words, and
    how many each sentence has."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            feats, sizes = [], []
            for text in batch.column(0).to_pylist():
                own, size = [], []
                for words in sentences(text):
                    if words:
                        before = len(own)
                        for w in set(words):
                            if w not in known:
                                known[w] = [numbers[f] for f in features(w) if f in numbers]
                            own += known[w]
                        size.append(len(own) - before)
                feats.append(np.array(own, "<i4").tobytes())
                sizes.append(np.array(size or [0], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(feats, pa.binary()), pa.array(sizes, pa.binary())],
                                             names=["y", "feats", "sizes"])
    return rows.select("text", "y").mapInArrow(run, "y int, feats binary, sizes binary")


def gradient(y: np.ndarray, feats: np.ndarray, sentence: np.ndarray, doc: np.ndarray, bias: float,
             weights: np.ndarray) -> np.ndarray:
    """Gradient of the summed log loss of the documents' scores by the weights."""
    z = np.clip(bias + np.bincount(sentence, weights=weights[feats], minlength=len(doc)), -LIMIT, LIMIT)
    total = softplus(bias) + np.bincount(doc, weights=evidence(z, bias), minlength=len(y))
    toxic = np.clip(-np.expm1(-total), 1e-9, 1.0)
    slope = np.where(z >= bias, np.exp(z - softplus(z)), 0.0)                 # at the bias, words may yet rise
    by_z = slope * np.where(y[doc] == 1, -(1.0 - toxic[doc]) / toxic[doc], 1.0)
    return np.bincount(feats, weights=by_z[sentence], minlength=len(weights))


def _step(bags: DataFrame, bias: float, weights: np.ndarray) -> np.ndarray:
    packed = weights.astype("<f4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(packed, "<f4").astype(np.float64)
        total = np.zeros(len(w))
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = [np.frombuffer(x, "<i4") for x in batch.column(2).to_pylist()]
            feats = np.concatenate([np.frombuffer(x, "<i4") for x in batch.column(1).to_pylist()])
            doc = np.repeat(np.arange(len(sizes)), [len(s) for s in sizes])
            each = np.concatenate(sizes)
            total += gradient(np.array(batch.column(0).to_pylist()), feats, np.repeat(np.arange(len(each)), each), doc, bias, w)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["g"])

    total = np.zeros(len(weights))
    for row in bags.mapInArrow(run, "g binary").collect():                 # one small vector for each of TRAIN_PARTS
        total += np.frombuffer(row.g, "<f4")
    return total


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        rows: int = TRAIN_ROWS, steps: int = STEPS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out. Without
    any, or without both labels among them, the model has no weights and calls
    nothing toxic."""
    bound_arrow_batches(docs.sparkSession)
    sample = write_shared(training_rows(docs, labels, id_col, text, label, rows).repartition(TRAIN_PARTS, "_order")
                          .sortWithinPartitions("_order", "text"), "toxicity-sample")
    n, n_toxic = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if n_toxic in (0, n):
        return Model(BIAS, {})
    counted = _feature_counts(sample).filter(F.col("n") >= LEAST_DOCS).toArrow()       # bounded by the sample
    kept = telling(counted["n"].to_numpy(), counted["k"].to_numpy(), n_toxic / n)
    names = sorted(counted["feature"].filter(pa.array(kept)).to_pylist())
    if not names:
        return Model(BIAS, {})
    bags = write_shared(_bags(sample, {f: i for i, f in enumerate(names)}).repartition(TRAIN_PARTS), "toxicity-bags") \
        .coalesce(TRAIN_PARTS)
    weights, mean, square = (np.zeros(len(names)) for _ in range(3))
    for step in range(1, steps + 1):
        g = _step(bags, BIAS, weights) / n
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        rate = RATE / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        weights = np.maximum(0.0, weights - rate * (mean / (1 - 0.9 ** step) + L1))
    return Model(BIAS, {names[i]: float(weights[i]) for i in np.flatnonzero(weights)})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted``
    (1 from 0.5 on), ``n_offending`` sentences with a score of their own from 0.5
    on, and where the worst sentence of a toxic document stands (``worst_start``,
    ``worst_end``, code points; else null). A null text counts as empty; an empty
    text has the score of the bias. Texts may be of any length, repeated rows are
    each returned, of equally bad sentences the first is named, and an empty table gives no rows."""
    bound_arrow_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("_id"), held_out(docs[id_col]).alias("_held"), text_or_empty(docs, text).alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, offending, spans = [], [], []
            for t in batch.column(2).to_pylist():
                numbers, logits = model.logits(t)
                z = np.array(logits)
                scores.append(round(model.document_score(z), 9))
                offending.append(int((z >= 0).sum()))
                spans.append(sentence_span(t, numbers[int(z.argmax())]) if scores[-1] >= 0.5 else (None, None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(offending, pa.int64()),
                 pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())],
                names=[id_col, "held_out", "score", "predicted", "n_offending", "worst_start", "worst_end"])

    return slim.mapInArrow(run, f"`{id_col}` {id_type}, held_out boolean, score double, predicted int, n_offending long, "
                                "worst_start long, worst_end long")


def sentence_span(text: str, number: int) -> tuple[int, int]:
    """Where the given stretch between sentence ends stands."""
    at = 0
    for _ in range(number):
        at = SENTENCE.match(text, at).end() + 1
    return at, SENTENCE.match(text, at).end()


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5, id_col: str = "doc_id",
                        text: str = "text") -> DataFrame:
    """(id, start, end, score) of each sentence whose own score is ``least`` or more;
    none for null and empty texts and empty tables."""
    bound_arrow_batches(docs.sparkSession)
    slim = docs.select(docs[id_col].alias("_id"), text_or_empty(docs, text).alias("_text"))
    id_type = slim.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, starts, ends, scores = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                numbers, logits = model.logits(t)
                for number, z in zip(numbers, logits):
                    p = model.sentence_score(z)
                    if p >= least:
                        a, b = sentence_span(t, number)
                        row.append(i)
                        starts.append(a)
                        ends.append(b)
                        scores.append(round(p, 9))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
                 pa.array(scores, pa.float64())], names=[id_col, "start", "end", "score"])

    return slim.mapInArrow(run, f"`{id_col}` {id_type}, start long, end long, score double")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents whose score is below 0.5, all columns as they are. Null and
    empty texts stay, repeated rows stay or go together; an empty table stays empty."""
    bound_arrow_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def toxic(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([model.document_score(np.array(model.logits(t)[1])) for t in texts.to_pylist()], pa.float64())

    return docs.filter(F.round(toxic(text_or_empty(docs, text)), 9) < 0.5)
