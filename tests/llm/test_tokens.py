"""BPE round trip, token counts and token files against the libraries."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute, fixtures
from wavepanel.llm import bpe, pfor, token_counts, token_files

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
LIBRARY = Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@pytest.fixture(scope="module")
def own():
    return bpe.TrieBpe(BYTE)


def odd_texts(n=400):
    rng = random.Random(3)
    out = ["".join(rng.choice("abet ing12'sé\n.,") for _ in range(200)) for _ in range(n)]
    out += [bytes(rng.randrange(256) for _ in range(60)).decode("latin1") for _ in range(n)]
    pick = [lambda: rng.randrange(32, 0x2000), lambda: rng.randrange(0x4E00, 0x9000), lambda: rng.randrange(0x1F300, 0x1F700)]
    return out + ["".join(chr(rng.choice(pick)()) for _ in range(60)) for _ in range(n)] + ["a" * 3000, "ab" * 2000]


def test_trie_encoding_equals_library(library, own):
    texts = odd_texts() + [t or "" for _, t in fixtures.TEXTS]
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = own.encode(texts)
    assert [list(memoryview(g).cast("I")) for g in got] == expected
    assert [own.decode(g).decode() for g in got] == [library.decode(e, skip_special_tokens=False) for e in expected]


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_trie_encoding_of_any_text(text):
    got = bpe.loaded(BYTE).encode([text])[0]
    assert got == brute.u32(LIBRARY.encode(text, add_special_tokens=False).ids)


def test_broken_ids_decode_like_the_library(library, own):
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(256) for _ in range(rng.randrange(1, 9))]
        assert own.decode(brute.u32(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_shared_prefixes_give_the_same_as_single_words(own):
    words = [w.encode() for w in ("", "a", "ab", "abc", " the", " then", " thence", " there", "zz")]
    together = own.encode_words(words)
    assert all(own.encode_words([w])[w] == together[w] for w in words)


def test_word_splitting_agrees_with_the_library_wherever_it_is_used(library):
    # every character on which the regex module splits, between letters, digits, spaces and itself
    chars = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not bpe.UNSURE.match(chr(c))]
    for at in range(0, len(chars), 500):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}{chr(c)}!  " for c in chars[at:at + 500])
        assert bpe.WORDS.findall(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_round_trip_operator(spark, library):
    docs = fixtures.documents(spark)
    got = bpe.bpe_round_trip(docs, BYTE, with_ids=True).collect()
    expected = Counter()
    for i, t in fixtures.TEXTS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = brute.u32(ids)
        expected[i, len(ids), brute.sha(raw), brute.sha(library.decode(ids, skip_special_tokens=False).encode()), raw] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got) == expected
    assert bpe.bpe_round_trip(fixtures.empty(spark), BYTE).count() == 0


def test_token_counts_equal_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = odd_texts(200) + [t or "" for _, t in fixtures.TEXTS] + ["a ▁b", "▁", "a  ", "  "]
    assert token_counts.loaded(PIECE).count(texts) == [len(e) for e in model.encode(texts)]
    got = token_counts.token_counts(fixtures.documents(spark), PIECE, limit=4096).collect()
    expected = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096)
                       for i, t in fixtures.TEXTS)
    assert Counter(tuple(r) for r in got) == expected
    assert token_counts.token_counts(fixtures.empty(spark), PIECE).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300), st.integers(1, 70), st.floats(0.01, 1.0))
def test_pfor_round_trip(values, block, share):
    ids = np.array(values, np.uint32)
    raw = pfor.encode(ids, block, share)
    assert pfor.decode(raw).tolist() == values
    whole = pfor.decode(raw, 1, 2).tolist()
    assert whole == values[block:2 * block]


def test_pfor_stores_outliers_as_exceptions():
    ids = np.full(1024, 1000, np.uint32)
    ids[::7] += 5
    plain = len(pfor.encode(ids))
    ids[13] = 4_000_000_000
    assert len(pfor.encode(ids)) == plain + 8


def test_token_files(spark):
    tokenizer = Tokenizer.from_file(WORD)
    path = token_files.write_token_files(fixtures.documents(spark), WORD, end_id=1)
    got = token_files.read_token_files(spark, path)
    rows = sorted(token_files.id_checksums(got).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in fixtures.TEXTS], key=lambda i: (i is not None, i))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    expected = Counter()
    for i, t in fixtures.TEXTS:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        expected[i, len(ids), brute.crc(brute.u32(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == expected
    assert got.filter(F.length("ids") != F.col("n_tokens") * 4).count() == 0
    path = token_files.write_token_files(fixtures.empty(spark), WORD, end_id=1)
    assert token_files.read_token_files(spark, path).count() == 0


def test_word_encoder_on_odd_texts():
    texts = odd_texts(200) + [" ́x", "ΑΣ ΑΣΑ", "a x b y", "a\x00b \x00 c", "\x1ca\x85b\xa0c", "(Ünï-ködé's!) 'tis DON'T ß ẞ İi ªº²µ 12,3 _x_", "\x00", "x <|endoftext|> y<|endoftext|>"]
    tokenizer = Tokenizer.from_file(WORD)
    ids, sizes = token_files.loaded(WORD).encode(pa.array(texts))
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [g.tolist() for g in got] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
