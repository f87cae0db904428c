"""Byte-level BPE by prefix-sharing trie traversal.

The distinct words of a batch form a trie. It is walked depth first (the words
in byte order are its leaves in that order, so only the path from the root to
the current word is held), and each node gets the last token of the encoding
of its prefix. That token is unique: of all tokens that end the prefix, it is
the one that may follow the last token of what stands before it. So a prefix
that many words share is encoded once, and a word's tokens are read off by
following the last tokens back to the root.

A token may follow another if the merges, applied in rank order to the bytes
of both, never join a piece of the first with a piece of the second.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wavepanel.llm.common import WordCache, bound_arrow_batches, byte_slices, text_or_empty

#: The words of a byte-level pre-tokenizer.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Characters on which the installed regex module and the tokenizers library agree about letters, digits and
#: white space (tests try every one); texts with others are split by the library itself.
UNSURE = regex.compile(r"[^\x00-ԩ‐-⁤、-ヿ一-龥가-힣]")
CACHE_WORDS = 250_000
SLICE_BYTES = 4 << 20
NEVER = 1 << 60


def byte_characters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: a
    printable byte stands for itself, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if (model["type"], pre.get("type"), pre.get("use_regex"), pre.get("add_prefix_space"), spec["normalizer"]) != \
                ("BPE", "ByteLevel", True, False, None) or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        self.path = path
        chars = byte_characters()
        raw = {bytes(chars[c] for c in token): i for token, i in model["vocab"].items()}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in raw.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = (raw[bytes(chars[c] for c in x)] for x in (left, right))
            self.rank[a, b] = rank
            self.parts.setdefault(raw[self.bytes_of[a] + self.bytes_of[b]], (a, b, rank))
        self.extra: dict[str, int] = {}
        for token in spec["added_tokens"]:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
                raise ValueError(f"added token with white-space or normalisation rules: {token['content']}")
            self.extra[token["content"]] = token["id"]
            self.bytes_of[token["id"]] = token["content"].encode()
        longest = sorted(self.extra, key=len, reverse=True)
        self.extra_pattern = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        # tokens that the merges can make, and their lengths by last two bytes
        self.token_of: dict[bytes, int] = {}
        for b, i in sorted(raw.items(), key=lambda x: len(x[0])):
            if len(b) == 1 or i in self.parts and self._makes(i):
                self.token_of[b] = i
        ends: dict[bytes, set[int]] = {}
        for b in self.token_of:
            if len(b) > 1:
                ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {end: sorted(n, reverse=True) for end, n in ends.items()}
        self.cache = WordCache(CACHE_WORDS)
        self._library = None

    # -- which tokens may stand side by side --------------------------------
    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The pieces at one edge of a token while it is put together: (piece,
        rank of the merge that takes it into the next one)."""
        known = self._left if side == 0 else self._right
        if token not in known:
            if token in self.parts:
                a, b, rank = self.parts[token]
                inner = self._edge((a, b)[side], side)
                known[token] = [*inner[:-1], (inner[-1][0], rank), (token, NEVER)]
            else:
                known[token] = [(token, NEVER)]
        return known[token]

    def _meet(self, a: int, b: int) -> int:
        """The rank at which a piece of ``a`` first joins a piece of ``b``."""
        left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
        while True:
            (x, x_rank), (y, y_rank) = left[i], right[j]
            joined = self.rank.get((x, y), NEVER)
            # equal ranks are applied from the left
            if joined < x_rank and joined <= y_rank:
                return joined if (i, j) != (len(left) - 1, len(right) - 1) else joined + NEVER
            if x_rank == y_rank == NEVER:
                return 2 * NEVER
            if x_rank <= y_rank:
                i += 1
            else:
                j += 1

    def _makes(self, token: int) -> bool:
        """Whether the token's own merge joins its two finished parts."""
        a, b, rank = self.parts[token]
        return self.bytes_of[a] in self.token_of and self.bytes_of[b] in self.token_of and self._meet(a, b) == rank + NEVER

    def follows(self, a: int, b: int) -> bool:
        known = self._follows.get((a, b))
        if known is None:
            known = self._follows[a, b] = self._meet(a, b) == 2 * NEVER
        return known

    # -- the trie -----------------------------------------------------------
    def encode_words(self, words: Iterable[bytes]) -> dict[bytes, array]:
        """Token ids of each distinct word."""
        out: dict[bytes, array] = {}
        token_of, lengths, bytes_of, follows = self.token_of, self.lengths, self.bytes_of, self.follows
        last: list[int] = [-1]          # last token at each depth of the path
        before = b""
        for word in sorted(set(words)):
            shared, most = 0, min(len(before), len(word))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del last[shared + 1:]
            for depth in range(shared + 1, len(word) + 1):
                found = -1
                if depth > 1:
                    for n in lengths.get(word[depth - 2:depth], ()):
                        if n <= depth:
                            token = token_of.get(word[depth - n:depth])
                            if token is not None and (n == depth or follows(last[depth - n], token)):
                                found = token
                                break
                if found < 0:
                    found = token_of[word[depth - 1:depth]]
                last.append(found)
            ids, depth = [], len(word)
            while depth:
                ids.append(last[depth])
                depth -= len(bytes_of[last[depth]])
            out[word] = array("I", reversed(ids))
            before = word
        return out

    # -- texts --------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        if not UNSURE.search(text):
            return WORDS.findall(text)
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Words of a text, with added tokens where they stand (no word has their
        mixture of marks and letters)."""
        if not self.extra_pattern or not self.extra_pattern.search(text):
            return self.split(text)
        out: list[str] = []
        at = 0
        for m in self.extra_pattern.finditer(text):
            out += self.split(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.split(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.pieces(t) for t in texts]
        get = self.cache.take(set().union(*split), self._words).__getitem__
        return [b"".join(map(get, words)) for words in split]

    def _words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        done = self.encode_words(raw)
        return [self.extra[w].to_bytes(4, "little") if w in self.extra else done[b].tobytes() for w, b in zip(words, raw)]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded ids; broken sequences become U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        return raw.decode("utf-8", "replace").encode()


_LOADED: dict[str, TrieBpe] = {}


def loaded(path: str) -> TrieBpe:
    """One encoder per Python worker, kept between its tasks."""
    if path not in _LOADED:
        _LOADED[path] = TrieBpe(path)
    return _LOADED[path]


def bpe_round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False,
                   keep: list[str] | None = None) -> DataFrame:
    """One row per input row: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``
    (digests of the ids and of the text decoded from them) and, if asked, the
    ``ids`` themselves. A null text counts as empty and has no tokens; null and
    repeated ids are kept as they are; ``keep`` names columns passed through.
    Texts of any length are encoded whole; an empty table gives no rows.
    """
    bound_arrow_batches(df.sparkSession)
    keep = keep or []
    slim = df.select(df[id_col], *[df[c] for c in keep], text_or_empty(df, text).alias("_text"))
    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]]
    schema += ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"] + ["ids binary"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            counts, sums, decoded, kept = [], [], [], []
            for a, b in byte_slices([len(t) for t in texts], SLICE_BYTES):
                for ids in bpe.encode(texts[a:b]):
                    counts.append(len(ids) // 4)
                    sums.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        kept.append(ids)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(decoded, pa.string())]
            names = [*batch.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(kept, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return slim.mapInArrow(run, ", ".join(schema))
