"""SimHash near-duplicates against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm import brute, fixtures
from wavepanel.llm import components, queries, simhash


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB é\t\n\x1c\x85"))
def test_fingerprint_equals_the_plain_form(text):
    assert simhash.fingerprint(text) == brute.fingerprint(text)


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_signed_values():
    assert simhash._signed(1 << 63) == -(1 << 63) and simhash._signed(5) == 5


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_connect_exactly_the_near_fingerprints(spark, radius):
    rng = random.Random(radius)
    values = [0, (1 << 64) - 1]
    for _ in range(60):                                        # clusters of several shapes around centres
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 12])):
            v = centre
            for b in rng.sample(range(64), rng.randrange(0, 5)):
                v ^= 1 << b
            values.append(v)
    chain = rng.getrandbits(64)                                # a long chain of steps
    for b in range(0, 60, 3):
        values.append(chain)
        chain ^= 7 << b
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    edges = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df, radius).collect()]
    assert all((a ^ b).bit_count() <= radius for a, b in edges)
    number = {v: i for i, v in enumerate(values)}
    root = brute.linked(values, radius)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(
        [(number[a], number[b]) for a, b in edges], "a long, b long")).collect()}
    assert [got.get(i, i) for i in range(len(values))] == root


def test_components_of_chains_stars_and_nothing(spark):
    rng = random.Random(2)
    nodes = list(range(400))
    edges = [(i, i + 1) for i in range(150)] + [(200, i) for i in range(201, 260)] + [(300, 300)]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert [got.get(i, i) for i in nodes] == [0 if i <= 150 else 200 if 200 <= i < 260 else i for i in nodes]
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def expected(texts):
    prints = [brute.fingerprint(t or "") for _, t in texts]
    root = brute.linked(prints, 3)
    first = defaultdict(list)
    for (i, _), r in zip(texts, root):
        first[r].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in first.items()}
    return Counter((i, f"{p:016x}", least[r]) for (i, _), p, r in zip(texts, prints, root))


def test_operator_on_awkward_rows(spark):
    got = simhash.near_duplicates(fixtures.documents(spark)).collect()
    assert Counter(tuple(r) for r in got) == expected(fixtures.TEXTS)
    assert simhash.near_duplicates(fixtures.empty(spark)).count() == 0


def test_query_on_the_table(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in queries.op5_simhash(spark, SF_SMALL).collect()) == expected(texts)


def test_keep_one(spark):
    docs = fixtures.documents(spark)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = brute.linked([brute.fingerprint(t or "") for _, t in fixtures.TEXTS], 3)
    assert kept.count() == len(set(groups))
    firsts = {c for (_, _, c) in expected(fixtures.TEXTS) if c is not None}
    assert {r.doc_id for r in kept.select("doc_id").collect()} - {None} == firsts
    assert simhash.keep_one(fixtures.empty(spark)).count() == 0
    assert kept.filter(F.col("shard") == "d").count() == kept.count()
