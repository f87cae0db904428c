"""Bit-sliced top-k search and sharding against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF_SMALL
from tests.llm import brute, fixtures
from wavepanel.llm import queries, sharding, topk

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("score", T.StringType()), T.StructField("rank", T.StringType())])


def check(spark, vectors, k):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in vectors], VECTORS).repartition(3)
    got = topk.top_k(df, F.col("id") % 20 == 0, k=k, scale=64).collect()
    assert sorted(tuple(r) for r in got) == brute.top_k(vectors, k, 64)


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    f32 = lambda x: float(np.float32(x))
    vectors = [(i, [f32(rng.gauss(0, 0.2)) for _ in range(9)]) for i in range(300)]
    vectors += [(1000 + i, vectors[5][1]) for i in range(90)]                  # many level rows
    vectors += [(2000, [0.0] * 9), (2020, None), (2040, [None] * 9), (2060, [float("nan")] * 9), (2080, [float("inf")] * 9),
                (None, [0.5] * 9), (40, vectors[7][1]), (41, vectors[41][1]), (2100, [0.25, -0.25]), (2120, []),
                (-20, [f32(-0.3)] * 9)]
    check(spark, vectors, 20)


def test_columns_named_like_the_operators_own(spark):
    rng = random.Random(2)
    vectors = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(4)]) for i in range(70)]
    df = spark.createDataFrame([(i, v, -i, "x", [1], 3) for i, v in vectors],
                               "vec_id long, embedding array<float>, id long, block string, comps array<int>, task int")
    got = topk.top_k(df, F.col("id") % 20 == 0, k=5, scale=64).collect()
    assert sorted(tuple(r) for r in got) == brute.top_k(vectors, 5, 64)


def test_index_holds_slices():
    comps = np.random.default_rng(3).integers(-70, 70, (130, 5))
    low, maps, bits = topk.slices_of(comps)
    assert maps.shape == (5, bits, 3) and bits == 8
    both = topk._with_complements(maps.astype("<u8").tobytes(), 5, bits)
    back = sum((np.unpackbits(both[:, 0, b].copy().view(np.uint8), axis=1, bitorder="little")[:, :130].astype(int) << b for b in range(bits)))
    assert (back.T + low == comps).all() and (both[:, 1] == ~both[:, 0]).all()


def test_top_k_of_few_and_of_no_rows(spark):
    check(spark, [(0, [0.5]), (1, [0.25]), (20, [0.25])], 20)
    check(spark, [(0, [0.5])], 20)
    check(spark, [], 20)


def test_blocks_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk, "BATCH_ROWS", 3)
    monkeypatch.setattr(topk, "TASK_BATCHES", 2)
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    vectors = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = queries.op1_bitsliced_topk(spark, SF_SMALL).collect()
    assert sorted(tuple(r) for r in got) == brute.top_k(vectors, 20, 64)


def test_sql_gives_the_same_rows():
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF_SMALL}/embeddings.parquet')")
    vectors = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert sorted(con.execute(queries.oracle_sql()["op1_bitsliced_topk"]).fetchall()) == brute.top_k(vectors, 20, 64)


def test_jump_hash_equals_the_plain_form():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 3000)
    for shards in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, shards).tolist() == [brute.jump(int(k) % 2**64, shards) for k in keys]


def check_shards(rows):
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 4)
    rows = sharding.shard_documents(fixtures.documents(spark)).collect()
    check_shards(rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 1, brute.crc((t or "").encode())) for i, t in fixtures.TEXTS)
    by_id = defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.shard, r.grown_shard))
    assert all(len(v) == 1 for v in by_id.values())
    assert sharding.shard_documents(fixtures.empty(spark)).count() == 0


def test_rows_equal_in_everything_are_no_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 64)
    texts = [(5, "the same")] * 1000 + [(None, None)] * 300 + [(i, f"text {i}") for i in range(200)]
    rows = sharding.shard_documents(fixtures.documents(spark, texts)).collect()
    check_shards(rows)
    assert len(rows) == 1500
    hot = sorted(r.slot for r in rows if r["size"] == 9 and r.doc_id == 5)
    assert len(hot) == 1000 and hot[-1] - hot[0] == 999
    again = sharding.shard_documents(fixtures.documents(spark, texts).repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_shards_of_the_table(spark):
    import xxhash
    rows = queries.op6_jump_shards(spark, SF_SMALL).collect()
    check_shards(rows)
    for r in rows:
        key = xxhash.xxh64_intdigest(r.doc_id.to_bytes(8, "little"), 42)
        assert (r.shard, r.grown_shard) == (brute.jump(key, 16), brute.jump(key, 17))
    assert len(rows) == spark.read.parquet(f"{SF_SMALL}/documents.parquet").count()
