"""Toxicity by held-out accuracy and against the plain formula; license scans
against planted notices."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm import brute, fixtures
from wavepanel.llm import licenses, queries, toxicity

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = int(rng.random() < 0.3)
        sents = [" ".join(rng.choice(["lamp", "tree", "stone", "river", "cloud"]) + str(rng.randrange(30)) for _ in range(8))
                 for _ in range(rng.randrange(1, 12))]
        if toxic:
            at = rng.randrange(len(sents))
            sents[at] = "you " + rng.choice(["zorgface", "blimpnut", "grubhead"]) + " " + sents[at]
        docs.append((i, ". ".join(sents) + "."))
        labels.append((i, 1, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    df = fixtures.documents(spark, docs)
    return docs, labels, df, toxicity.fit(df, spark.createDataFrame(labels, LABELS))


def test_learns_from_documents_and_locates_sentences(fitted):
    docs, labels, df, model = fitted
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    held = [(i, y) for i, _, y in labels if brute.crc(str(i).encode()) % 5 == 0]
    assert {i for i, r in rows.items() if r.held_out} == {i for i, _ in held}
    assert sum(rows[i].predicted == y for i, y in held) >= 0.98 * len(held)
    texts = dict(docs)
    for i, _, y in labels:
        r = rows[i]
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if y and r.predicted:
            assert any(w in texts[i][r.worst_start:r.worst_end] for w in ("zorgface", "blimpnut", "grubhead"))
    found = toxicity.offending_sentences(df, model).collect()
    assert found and all(0.5 <= f.score <= 1 for f in found)
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_held_out_labels_are_not_learned_from(spark, fitted):
    docs, labels, df, model = fitted
    turned = [(i, q, 1 - y if brute.crc(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    again = toxicity.fit(df, spark.createDataFrame(turned, LABELS))
    assert again.weights.keys() == model.weights.keys()
    assert max(abs(again.weights[k] - model.weights[k]) for k in model.weights) < 1e-3


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 6, 15))
    doc[:6] = np.arange(6)
    doc.sort()
    sentence = np.sort(rng.integers(0, 15, 60))
    feats, y, w = rng.integers(0, 9, 60), np.array([0, 1, 0, 1, 1, 0]), rng.normal(0, 0.5, 9)

    def loss(w):
        z = -1.0 + np.bincount(sentence, weights=w[feats], minlength=15)
        p = [brute.noisy_or([z[s] for s in np.flatnonzero(doc == d)], -1.0) for d in range(6)]
        return -sum(math.log(p[d]) if y[d] else math.log(1 - p[d]) for d in range(6))

    g = toxicity.gradient(y, feats, sentence, doc, -1.0, w)
    e = 1e-6
    for k in range(9):
        step = np.eye(9)[k] * e
        assert abs((loss(w + step) - loss(w - step)) / 2 / e - g[k]) < 1e-4


def test_scores_equal_the_plain_noisy_or(spark, fitted):
    """Every document, also with evidence further apart than any other document is long."""
    docs, labels, _, model = fitted
    clean = ". ".join(t for (_, t), (_, _, y) in zip(docs, labels) if not y)
    weak = toxicity.Model(model.bias, {"meh": 6.6, "tree1": -2.0, "bad*": 9.0})
    texts = [t for _, t in docs] + ["meh", "meh. meh", f"meh. {clean} meh. ", f"meh. {clean} {clean} {clean} tree1 meh. x meh", "badly! good? tree1"]
    texts += [t or "" for _, t in fixtures.TEXTS]
    df = fixtures.documents(spark, list(enumerate(texts)))
    for m in (model, weak):
        for r in toxicity.score(df, m).collect():
            want = brute.toxicity_score(texts[r.doc_id], m.bias, m.weights)
            assert abs(r.score - want) < 1e-6 and r.predicted == (want >= 0.5)


def test_distance_between_sentences_does_not_matter(fitted):
    model = toxicity.Model(-7.0, {"meh": 6.6})
    scores = [model.document_score(np.array(model.logits("A meh. " + "Some fine words. " * n + "Meh.")[1])) for n in (0, 30, 3000)]
    assert scores[0] > 0.5 and max(scores) - min(scores) < 1e-12


def test_features_that_chance_explains_have_no_weight():
    n, k = np.array([3, 3, 40, 40, 9, 30]), np.array([3, 1, 40, 5, 9, 12])
    assert toxicity.telling(n, k, 0.12).tolist() == [True, False, True, False, True, True]
    many = np.full(100_000, 3)
    assert not toxicity.telling(many, many, 0.12).any()


def test_copies_do_not_count_as_evidence(spark):
    docs = [(i, "The rare zyxw stood here. More of it. ") for i in range(40)]
    docs += [(100 + i, f"words number{i} are plain grubhead{'s' * (i % 2)}.") for i in range(40)] + [(200 + i, f"plain number{i}.") for i in range(200)]
    labels = [(i, 1, int(i < 140)) for i, _ in docs]
    model = toxicity.fit(fixtures.documents(spark, docs), spark.createDataFrame(labels, LABELS))
    assert "grubh*" in model.weights and not {"zyxw", "rare", "stood"} & set(model.weights)


def test_awkward_rows_and_labels(spark, fitted):
    model = fitted[3]
    got = toxicity.score(fixtures.documents(spark), model).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in fixtures.TEXTS)
    empty = 1 / (1 + math.exp(-model.bias))
    assert all(abs(r.score - empty) < 1e-6 for r in got if r.doc_id in (3, 4, 5, 15))
    assert toxicity.score(fixtures.empty(spark), model).count() == 0
    odd = [(1, 1, 1), (1, 1, 0), (None, 1, 1), (2, 1, None), (99, 1, 1), (6, None, 0)]
    for labels in (odd, []):
        m = toxicity.fit(fixtures.documents(spark), spark.createDataFrame(labels, LABELS))
        assert all(r.predicted == 0 for r in toxicity.score(fixtures.documents(spark), m).collect())
    assert toxicity.fit(fixtures.empty(spark), spark.createDataFrame(odd, LABELS)).weights == {}


def test_length_alone_is_not_toxic(spark, fitted):
    docs, labels, _, model = fitted
    clean = [t for (_, t), (_, _, y) in zip(docs, labels) if not y]
    rng, texts = random.Random(4), []
    for n in (20_000, 100_000, 500_000):
        parts, words = [], 0
        while words < n:
            parts.append(rng.choice(clean))
            words += len(parts[-1].split())
        at = len(parts) // 3
        texts += [" ".join(parts), " ".join([*parts[:at], "You zorgface.", *parts[at:]])]
    df = fixtures.documents(spark, list(enumerate(texts)))
    rows = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert [rows[i].predicted for i in range(6)] == [0, 1] * 3
    assert all("zorgface" in texts[i][rows[i].worst_start:rows[i].worst_end] for i in (1, 3, 5))
    assert {r.doc_id for r in toxicity.drop_toxic(df, model).collect()} == {0, 2, 4}
    unweighted = toxicity.Model(toxicity.BIAS, {})
    assert all(r.predicted == 0 for r in toxicity.score(df, unweighted).collect())


def test_neighbouring_sentences_add_up():
    model = toxicity.Model(-7.0, {"bad": 6.0})

    def score(text):
        return model.document_score(np.array(model.logits(text)[1]))

    one, near = score("bad"), score("bad. " + "tree. " * 5 + "bad. bad")
    assert one == pytest.approx(1 / (1 + math.e)) and near > 0.5
    for filler in (0, 1, 30, 3000):
        assert score("tree. " * filler + "bad. bad. bad" + ". tree" * filler) == pytest.approx(1 - (1 - one) ** 3, abs=0.01)
    assert score("tree. " * 10_000) == score("")


def test_sentence_spans():
    text = "One two.. Three!\nfour"
    parts = toxicity.sentences(text)
    for i, words in enumerate(parts):
        a, b = toxicity.sentence_span(text, i)
        assert text[a:b].lower().split() == [w.decode() for w in words]


def test_query_accuracy_on_held_out_labels(spark):
    rows = queries.op9_toxicity(spark, SF_MID)
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet").filter(F.col("toxic").isNotNull())
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.toxic for r in held) >= 0.9 * len(held)


# -- licenses -------------------------------------------------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh"), max_size=25), st.lists(st.sampled_from("abcdefgh"), max_size=12))
def test_alignment_is_increasing_and_equal(a, b):
    pairs = licenses.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:]))
    if a == b:
        assert len(pairs) == len(a)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), unique=True, max_size=12))
def test_longest_increasing_subsequence(places):
    got = [places[i] for i in licenses._increasing(places)]
    best = [1] * len(places)
    for i in range(len(places)):
        best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
    assert got == sorted(got) and len(got) == max(best, default=0)


def test_planted_notices(spark):
    rng = random.Random(9)
    docs, expected = [], []
    for d in range(120):
        words = [rng.choice(["the", "of", "under", "license", "version", "for", "use", "lorem", "ipsum", "é"]) for _ in range(80)]
        at = rng.randrange(81)
        if d % 3:
            k = rng.randrange(len(licenses.TEMPLATES))
            name, body = licenses.TEMPLATES[k]
            notice = body.split()
            if d % 2 and len(notice) > 8:
                # the words that name a licence have to be matched
                naming = set(licenses.NAMING.get(name, ()))
                notice[rng.choice([i for i, w in enumerate(notice) if not naming & set(licenses.words_of(w))])] = "changed"
            words = [*words[:at], "é.", *notice, ".é", *words[at:]]
            expected.append((d, name))
        docs.append((d, "\n".join(words)))
    got = licenses.scan_licenses(fixtures.documents(spark, docs)).collect()
    assert {(r.doc_id, r.license) for r in got} >= set(expected)
    texts = dict(docs)
    for r in got:
        words = licenses.words_of(texts[r.doc_id][r.start:r.end])
        best = max(len(licenses.align(words, licenses.words_of(t))) / len(licenses.words_of(t))
                   for n, t in licenses.TEMPLATES if n == r.license)
        assert 0.8 <= r.coverage <= best + 1e-6
    assert len(got) <= 1.1 * len(expected)


def test_repeated_notices_awkward_rows(spark):
    line = "Released under the MIT License. "
    docs = [*fixtures.TEXTS, (50, line * 3), (51, line + "\nLicensed under CC BY-NC 4.0."), (None, line)]
    got = Counter((r.doc_id, r.license) for r in licenses.scan_licenses(fixtures.documents(spark, docs)).collect())
    assert got == {(50, "MIT"): 3, (51, "MIT"): 1, (51, "CC-BY-NC-4.0"): 1, (None, "MIT"): 1}
    assert licenses.scan_licenses(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("notice, name", [
    ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Licensed under the Eclipse Public License, Version 2.0", "EPL-2.0"),
    ("Licensed under the Apache License, Version 1.0.", None),
    ("Licensed under the Example Public License, Version 2.0", None),
    ("Released under the ISC License.", None),
    ("Licensed under CC BY 4.0", "CC-BY-4.0"),
    ("Licensed under CC BY 2.5", "CC-BY-2.5"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0"),
    ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
    *((text, name) for name, text in licenses.TEMPLATES + licenses.NEIGHBOURS),
])
def test_neighbouring_licenses_are_told_apart(notice, name):
    found = licenses.Scanner(licenses.TEMPLATES + licenses.NEIGHBOURS, licenses.MIN_COVERAGE).scan(f"The first part. {notice}\nMore of the text.")
    assert [x[0] for x in found] == ([name] if name else [])


def scanner():
    return licenses.Scanner(licenses.TEMPLATES + licenses.NEIGHBOURS, licenses.MIN_COVERAGE)


@pytest.mark.parametrize("name, body", [t for t in licenses.TEMPLATES if len(licenses.words_of(t[1])) > 12])
def test_changed_notices_side_by_side_are_one_row_each(name, body):
    rng = random.Random(name)
    naming = licenses.NAMING.get(name, ())
    for n in (1, 2, 3, 9):
        copies = []
        for _ in range(n):
            words = body.split()
            free = [i for i, w in enumerate(words) if not set(licenses.words_of(w)) & set(naming)]
            for i in rng.sample(free, 1 + len(words) // 30):
                words[i] = rng.choice(["changed", "other words", "of"])
            copies.append(" ".join(words))
        text = "\n".join(copies)
        found = scanner().scan(text)
        assert [x[0] for x in found] == [name] * n
        at = 0
        for copy, (_, start, end, _, _) in zip(copies, found):
            shared = min(end, at + len(copy)) - max(start, at)
            assert shared >= 0.7 * len(copy) and end - start <= 1.1 * len(copy)
            at += len(copy) + 1


def test_short_notices_with_a_changed_first_word():
    for line, name in (("Distributed under the Apache License, Version 2.0. ", "Apache-2.0"), ("Provided under the MIT License. ", "MIT")):
        for n in (1, 2, 3, 20):
            assert [x[0] for x in scanner().scan(line * n)] == [name] * n


def test_bodies_tell_licences_apart():
    for name in ("MIT", "MIT-0", "BSD-2-Clause", "BSD-3-Clause"):
        body = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
        assert [x[0] for x in scanner().scan(f"Copyright 2020 A. Person\n\n{body}\n\nMore text.")] == [name]


WORDS = ["w", "x", "y", "z"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=30), st.lists(st.sampled_from(WORDS), min_size=1, max_size=8))
def test_common_lengths_equal_brute_force(words, template):
    masks = {w: sum(1 << i for i, x in enumerate(template) if x == w) for w in template}
    got = licenses.common_lengths(words, masks, len(template))
    assert got == [brute.common_subsequence(words[:i + 1], template) for i in range(len(words))]
    assert len(licenses._subsequence(words, template)) == brute.common_subsequence(words, template)


def test_against_the_coverage_of_every_stretch():
    rng, body = random.Random(3), "the work is under the licence of the maker and the work stays under it".split()
    one = licenses.Scanner((("L", " ".join(body)),), 0.8, {})
    hits = 0
    for _ in range(300):
        words = [rng.choice(["the", "of", "lorem", "ipsum", "work"]) for _ in range(20)]
        notice = [w for w in body if rng.random() > 0.1]
        if rng.random() < 0.7:
            words[7:7] = [rng.choice(["lorem", w]) if rng.random() < 0.2 else w for w in notice]
        expected = brute.noticed(words, body, 0.8)
        found = one.scan(" ".join(words))
        assert all(coverage >= 0.8 for *_, coverage in found) and (expected or not found)
        hits += expected
        # an alignment by anchors can fall a word short of the longest common subsequence
        assert found or not expected or not brute.noticed(words, body, 0.8 + 1 / len(body))
    assert hits > 50


def test_query_finds_every_notice_of_the_table(spark):
    found = {r.doc_id for r in queries.op10_license_scan(spark, SF_MID).collect()}
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    plain = docs.filter(F.lower("text").rlike(r"licensed under|under the mit license")).select("doc_id").collect()
    assert found == {r.doc_id for r in plain} and found
