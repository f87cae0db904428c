"""Benchmark decontamination against every shift of every item."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF_SMALL
from tests.llm import brute, fixtures
from wavepanel.llm import decontaminate, queries


def fewest_substitutions(masks, length):
    """Fewest replaced words of a passage that leave no mask without one."""
    span = max(map(len, masks))
    uses = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in masks]
    states = {(): 0}
    for _ in range(length):
        later = {}
        for state, n in states.items():
            for replaced in (0, 1):
                s = state + (replaced,)
                if all(len(s) < k or any(s[len(s) - k + i] for i in at) for k, at in uses):
                    key = s[-(span - 1):]
                    later[key] = min(later.get(key, 99), n + replaced)
        states = later
    return min(states.values())


@pytest.mark.parametrize("length", range(15, 60, 4))
def test_masks_find_passages_with_a_fifth_replaced(length):
    assert fewest_substitutions(decontaminate.MASKS, length) > length // 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.booleans(), max_size=40))
def test_longest_overlap(agree):
    start, end = decontaminate.longest_overlap(np.array(agree, bool), 0.8)
    spans = [(b - a, a, b) for a in range(len(agree)) for b in range(a + 1, len(agree) + 1) if sum(agree[a:b]) >= 0.8 * (b - a) - 1e-9]
    assert end - start <= max(spans, default=(0,))[0]
    if spans:
        n = max(spans)[0]
        trimmed = set()
        for _, a, b in (s for s in spans if s[0] == n):
            while not agree[a]:
                a += 1
            while not agree[b - 1]:
                b -= 1
            trimmed.add((a, b))
        assert (start, end) in trimmed


@pytest.mark.parametrize("length", (13, 14))
def test_masks_find_the_shortest_overlaps(length):
    assert fewest_substitutions(decontaminate.MASKS, length) > length // 5


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from((True, True, True, False)), max_size=50))
def test_longest_overlap_with_agreeing_ends(agree):
    start, end = decontaminate.longest_overlap(np.array(agree, bool), 0.8, agreeing_ends=True)
    spans = [b - a for a in range(len(agree)) for b in range(a + 1, len(agree) + 1)
             if agree[a] and agree[b - 1] and sum(agree[a:b]) >= 0.8 * (b - a) - 1e-9]
    assert end - start == max(spans, default=0)
    assert not spans or agree[start] and agree[end - 1] and sum(agree[start:end]) >= 0.8 * (end - start) - 1e-9


def test_overlap_beside_a_padded_stretch(spark):
    agree = [n % 2 == 0 for n, k in enumerate((12, 8, 6, 1, 3, 1, 2, 7)) for _ in range(k)]
    item = [f"w{i}" for i in range(40)]
    doc = [w if a else f"x{i}" for i, (w, a) in enumerate(zip(item, agree))]
    short = [f"s{i}" for i in range(13)]
    part = [w if i not in (5, 10) else "other" for i, w in enumerate(short)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join([*short, *(f"t{i}" for i in range(20))]))],
                                  "item_id long, text string")
    docs = fixtures.documents(spark, [(1, " ".join(doc)), (2, " ".join(["a", *part, "b"])), (3, " ".join(doc[:32]))])
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, bench).collect())
    assert got == [(1, 1, 13, 11, 20, 20, 40, round(11 / 13, 6)), (2, 2, 13, 11, 1, 0, 33, round(11 / 13, 6))]
    assert [r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()] == [3]


def passage(rng, n):
    return [rng.choice(["the", "of", "alpha", "beta", "gamma", "delta"]) + str(rng.randrange(60)) for _ in range(n)]


def replaced(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = "other"
    return out


def test_operator_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(passage(rng, rng.choice([5, 6, 9, 15, 20, 40])))) for i in range(25)]
    items += [(30, None), (31, ""), (32, "one two three four"), (None, " ".join(passage(rng, 20))), (33, items[3][1])]
    docs = [(i, t) for i, t in fixtures.TEXTS if i not in (11, 2, 7, None)]
    for d in range(60):
        words = passage(rng, rng.randrange(0, 120))
        i, text = rng.choice(items[:25])
        item = text.split()
        if d % 3:
            at = rng.randrange(len(words) + 1)
            part = replaced(rng, item, rng.randrange(0, len(item) // 5 + 1)) if len(item) >= 15 else item
            if d % 5 == 0:
                part = part[:rng.randrange(1, len(part) + 1)]
            words = words[:at] + part + words[at:]
        docs.append((100 + d, ("\n" if d % 2 else ", ").join(words).title()))
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, words string")
    got = {(r.doc_id, r.item_id): (r.n_agree, r.n_words) for r in decontaminate.leaks(
        fixtures.documents(spark, docs), bench).collect()}
    expected = brute.leaks(docs, items)
    assert set(got) <= set(expected)
    whole = dict(items)
    for key, (agree, words) in expected.items():
        # parts of long items with words replaced may be too short for any mask
        if key not in got:
            assert words < 15 and agree < words and agree < len(whole[key[1]].split())
    assert len(got) > 30 and sum(got[k] == expected[k] for k in got) >= 0.9 * len(got)


def test_repeated_and_null_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    bench = spark.createDataFrame([(1, item), (1, item), (2, "nothing of it here at all")], "item_id long, text string")
    docs = fixtures.documents(spark, [(1, "x " + item), (1, "x " + item), (None, item.upper()), (None, "clean"), (3, None), (4, item[:30])])
    got = sorted(tuple(r) for r in decontaminate.leaks(docs, bench).fillna(-1, ["doc_id"]).collect())
    assert got == [(-1, 1, 16, 16, 0, 0, 16, 1.0), (1, 1, 16, 16, 1, 0, 16, 1.0)]
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, "clean"), (3, ""), (4, item[:30])]
    assert decontaminate.leaks(fixtures.empty(spark), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("length", range(5, 13))
def test_masks_find_every_copy_of_a_short_item(length):
    least = next(n for n in range(length + 1) if n >= 0.8 * length - 1e-9)
    assert fewest_substitutions(decontaminate.MASKS + decontaminate.SHORT_MASKS, length) > length - least


def test_short_items_with_any_word_replaced(spark):
    items, docs = [], []
    for length in (5, 6, 7, 8, 10, 12):
        words = [f"i{length}w{n}" for n in range(length)]
        items.append((length, " ".join(words)))
        for n in range(length):
            copy = [*words[:n], "other", *words[n + 1:]]
            docs.append((100 * length + n, " ".join(["before", *copy, "after"])))
            if length >= 10:
                copy[(n + 4) % length] = "other"
                docs.append((100 * length + 50 + n, " ".join(copy)))
        docs.append((100 * length + 90, " ".join(["other", *words[1:3], "other", "other", *words[5:]][:length])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(fixtures.documents(spark, docs), bench).collect()}
    assert got == set(brute.leaks(docs, items)) and len(got) >= 48


def test_very_long_text(spark):
    rng = random.Random(5)
    item = passage(rng, 20)
    text = " ".join([*(f"n{i % 977}" for i in range(40_000)), *replaced(rng, item, 3), *(f"m{i % 991}" for i in range(40_000))])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "five words of no text")], "item_id long, text string")
    docs = fixtures.documents(spark, [(1, text), (2, text.replace("n5 ", "z ")), (3, "word " * 60_000), (4, "x" * 300_000)])
    got = decontaminate.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1)} and all(r.doc_word >= 40_000 for r in got)
    assert {r.doc_id for r in decontaminate.drop_leaks(docs, bench).collect()} == {3, 4}


def test_query_on_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in queries.op8_benchmark_leaks(spark, SF_SMALL).collect()}
    grams = {}
    for i, t in items:
        w = brute.leak_words(t)
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k:k + 5]), set()).add(i)
    near = {(d, i) for d, t in docs for w in [brute.leak_words(t)] for k in range(len(w) - 4) for i in grams.get(tuple(w[k:k + 5]), ())}
    expected = {(d, i) for d, t in docs for i, b in items if (d, i) in near and brute.leaks([(d, t)], [(i, b)])}
    assert got == expected and got
