"""Chunked per-key windows equal the single-window forms, including a hot
key and long runs of missing values (halos carried across empty chunks)."""

import random

from tests.conftest import rows
from wavepanel.operators.change import DOWN, UP, visit_changes
from wavepanel.operators.impute import knn_impute
from wavepanel.operators.segments import chunked_row_number


def _panel(spark):
    rnd = random.Random(5)
    data = []
    for e in range(30):
        n = 1500 if e == 0 else rnd.randint(1, 15)           # entity 0 is hot
        for v in range(n):
            gap = e == 0 and 200 <= v < 420                   # long missing run in the hot entity
            x = None if gap or rnd.random() < 0.35 else float(rnd.randint(0, 12))
            y = None if rnd.random() < 0.2 else float(rnd.randint(1, 5))
            data.append((e, v * 2 + (v % 3 == 0), v, rnd.choice("ABC"), x, y))
    return spark.createDataFrame(data, "e long, t long, k long, s string, x double, y double")


def test_chunked_knn_equals_single_window(spark):
    df = _panel(spark)
    plain = knn_impute(df, "e", ["t", "k"], ["x", "y"], k=4)
    for width in (3, 50):
        chunked = knn_impute(df, "e", ["t", "k"], ["x", "y"], k=4, chunk_width=width)
        cols = ["e", "t", "k", "x_imputed", "y_imputed", "x_filled", "y_filled"]
        assert rows(chunked, *cols) == rows(plain, *cols)


def test_chunked_changes_equal_single_window(spark):
    df = _panel(spark)
    m = {"x": ("down", DOWN), "y": ("up", UP)}
    plain = visit_changes(df, "e", ["t", "k"], "s", m)
    chunked = visit_changes(df, "e", ["t", "k"], "s", m, chunk_width=7)
    cols = ["e", "t", "k", "last_stage", "measure", "change", "flagged"]
    assert rows(chunked, *cols) == rows(plain, *cols)


def test_chunked_row_number(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    df = _panel(spark)
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy("t", "k")))
    chunked = chunked_row_number(df, "e", ["t", "k"], 16, name="rn")
    assert rows(chunked, "e", "t", "k", "rn") == rows(plain, "e", "t", "k", "rn")


def test_chunked_series_tests_equal_single_window(spark):
    import math
    from pyspark.sql import functions as F
    from tests.conftest import SF_SMALL
    from wavepanel.operators.series import series_tests
    from wavepanel.sources.testdata import event_series
    ev = event_series(spark, SF_SMALL).withColumn("t_us", F.unix_micros(F.col("t").cast("timestamp")))
    plain = {r.series: r for r in series_tests(ev, "series_id", ["t_us", "event_id"], "value").collect()}
    chunked = {r.series: r for r in series_tests(ev, "series_id", ["t_us", "event_id"], "value",
                                                 block_rows=3).collect()}
    assert plain.keys() == chunked.keys()
    for sid, a in plain.items():
        b = chunked[sid]
        for f in a.__fields__:
            x, y = a[f], b[f]
            if x is None or y is None:
                assert x is None and y is None, (sid, f)
            else:
                assert math.isclose(x, y, rel_tol=1e-8, abs_tol=1e-10), (sid, f, x, y)


def test_only_hot_keys_are_chunked(spark):
    from wavepanel.operators.segments import Rows, auto_rows, resolve_width
    df = _panel(spark)
    assert auto_rows(df, "e") is None                               # no key above the default budget
    assert auto_rows(df.limit(0), "e") is None
    assert auto_rows(df, "e", target_rows=300) == Rows(300) == auto_rows(df.withColumn("e", df.e.cast("string")), "e", 300)
    assert resolve_width(df, "e", "auto") is None and resolve_width(df, "e", 7.0) == 7.0


def _one_place(spark):
    """Keys all of whose rows share one place, one key without a place, rows without a key."""
    rnd = random.Random(8)
    data = [(e, t, k, rnd.choice("ABC"), None if rnd.random() < 0.3 else float(rnd.randint(0, 12)), None if rnd.random() < 0.9 else 2.0)
            for e, t in ((1, 5), (2, 9), (3, None), (None, 4)) for k in range(400 if e != 2 else 11)]
    rnd.shuffle(data)
    return spark.createDataFrame(data, "e long, t long, k long, s string, x double, y double")


def test_rows_that_share_a_place_are_split(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from wavepanel.operators.segments import CHUNK, Rows, row_chunks
    for df in (_one_place(spark), _panel(spark)):
        order = ["t", "k"]
        sizes = row_chunks(df, "e", order, 50).groupBy("e", CHUNK).count()
        assert sizes.agg(F.max("count")).first()[0] <= 150                     # ranges come from a sample
        plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy(*order)))
        assert rows(chunked_row_number(df, "e", order, Rows(50), name="rn"), "e", "t", "k", "rn") == rows(plain, "e", "t", "k", "rn")
        m = {"x": ("down", DOWN), "y": ("up", UP)}
        cols = ["e", "t", "k", "last_stage", "measure", "change", "flagged"]
        assert rows(visit_changes(df, "e", order, "s", m, chunk_width=Rows(50)), *cols) == \
            rows(visit_changes(df, "e", order, "s", m, chunk_width=None), *cols)
        cols = ["e", "t", "k", "x_imputed", "y_imputed", "x_filled", "y_filled"]
        placed = df.filter("t IS NOT NULL")
        assert rows(knn_impute(placed, "e", order, ["x", "y"], k=4, chunk_width=Rows(50)), *cols) == \
            rows(knn_impute(placed, "e", order, ["x", "y"], k=4, chunk_width=None), *cols)
    text = _one_place(spark).withColumn("t", F.lit("one day"))                  # an order that is no number
    assert rows(chunked_row_number(text, "e", ["t", "k"], Rows(50), name="rn"), "e", "k", "rn") == \
        rows(text.withColumn("rn", F.row_number().over(Window.partitionBy("e").orderBy("t", "k"))), "e", "k", "rn")


def test_chunks_are_cut_inside_a_few_ranges(spark):
    """The sample that finds the ranges goes through the driver, so their number must not be that of the chunks."""
    from pyspark.sql import functions as F

    from wavepanel.operators.segments import CHUNK, row_chunks
    # one key in four, rows in pairs of one place, the last 300 all at one place
    df = spark.range(9_000, numPartitions=5).select(
        (F.col("id") % 4 == 0).cast("int").alias("e"), F.least(F.floor(F.col("id") / 8), F.lit(1087)).alias("t"), "id")
    cut = row_chunks(df, "e", ["t"], 20)
    assert len(cut.inputFiles()) <= 4
    sizes = cut.groupBy("e", CHUNK).agg(F.count("t").alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).orderBy("e", CHUNK).collect()
    assert len(sizes) >= 400 and sum(r.n for r in sizes) == 9_000
    assert max(r.n for r in sizes if r.b < 1087) <= 28                           # rows of one place share a chunk
    for r, after in zip(sizes, sizes[1:]):
        assert r.e < after.e or r.b < after.a


def test_times_without_zone_and_dates_are_split(spark):
    from pyspark.sql import functions as F

    from wavepanel.operators.segments import CHUNK, place, with_chunk
    from wavepanel.operators.series import autocorrelation
    df = spark.range(600).select(
        (F.col("id") % 4 == 0).cast("int").alias("e"), F.col("id").alias("k"), ((F.col("id") * 37) % 11).cast("double").alias("x"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1_234_567_890).alias("ts"))
    for kind in ("timestamp_ntz", "date"):
        d = df.withColumn("t", F.col("ts").cast(kind))
        ends = d.agg(F.max(place(d, "t")) - F.min(place(d, "t"))).first()[0]
        assert with_chunk(d, "t", ends / 6).filter("e = 0").select(CHUNK).distinct().count() >= 4
        got, plain = (autocorrelation(d, "e", ["t", "k"], "x", 3, block_rows=w) for w in (40, 10_000))
        assert rows(got.select("e", "lag", F.round("acf", 9))) == rows(plain.select("e", "lag", F.round("acf", 9)))
    zoned = df.agg(F.max(place(df, "ts")) - F.min(place(df, "ts"))).first()[0]
    ntz = df.withColumn("t", F.col("ts").cast("timestamp_ntz"))
    assert abs(ntz.agg(F.max(place(ntz, "t")) - F.min(place(ntz, "t"))).first()[0] - zoned) < 1e-3
