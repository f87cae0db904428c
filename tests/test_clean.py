"""Cleaning, sources and derived columns: hand-made edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import none_safe, rows
from wavepanel.operators import clean as C
from wavepanel.operators import derive as D
from wavepanel.sources.io import read_panel, read_table, strip_visit_suffix, visit_files


def test_null_codes_text_and_numbers(spark):
    df = spark.createDataFrame(
        [("-9", -9.0), ("' -9 '", 1.0), (" -9 ", -1.0), (" ", 2.0), ("abc", None), ("-1.0", -8.0),
         (None, -7.0), ("5", float("nan")), ("-2", 3.0)], "t string, x double")
    out = C.null_codes(df)
    got = rows(out, "t", "x")
    expect = sorted([(None, None), ("' -9 '", 1.0), (None, None), (None, 2.0), ("abc", None), (None, None),
                     (None, None), ("5", None), ("-2", 3.0)], key=none_safe)
    assert got == expect
    # idempotent
    assert rows(C.null_codes(out), "t", "x") == got


def test_infer_numeric_keeps_text_columns(spark):
    df = spark.createDataFrame([("1", "a"), (" 2.5 ", "3"), (None, None)], "a string, b string")
    out = C.infer_numeric(df)
    assert dict(out.dtypes) == {"a": "double", "b": "string"}
    assert rows(out, "a") == sorted([(1.0,), (2.5,), (None,)], key=none_safe)


def test_infer_numeric_treats_nan_words_as_text(spark):
    df = spark.createDataFrame([("NaN",), ("1",)], "a string")
    assert dict(C.infer_numeric(df).dtypes)["a"] == "string"


def test_clip_keeps_zero_and_nulls(spark):
    df = spark.createDataFrame([(0.0,), (-3.0,), (99.0,), (None,), (3.0,)], "x double")
    out = C.clip_ranges(df, {"x": (1, 5)})
    assert sorted(r.x for r in out.collect() if r.x is not None) == [0.0, 1.0, 3.0, 5.0]
    assert out.filter(F.col("x").isNull()).count() == 1
    # idempotent
    assert rows(C.clip_ranges(out, {"x": (1, 5)})) == rows(out)


def test_clip_audit_lists_few_originals(spark):
    df = spark.createDataFrame([(0.0,), (-3.0,), (99.0,), (2.0,)], "x double")
    a = C.clip_audit(df, {"x": (1, 5)}).collect()[0]
    assert (a.n_zero, a.n_below, a.n_above, a.originals) == (1, 1, 1, "-3.0,99.0")


def test_reverse_code_is_an_involution(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (5.0,), (7.0,), (None,)], "s double")
    once = C.reverse_code(df, "s")
    assert sorted([r.s for r in once.collect() if r.s is not None]) == [1.0, 3.0, 4.0, 5.0, 7.0]
    assert rows(C.reverse_code(once, "s")) == rows(df)


def test_residual_codes_top_columns(spark):
    df = spark.createDataFrame([("-9", "-1", "x", "1"), ("-9", "2", "y", "-8"), ("-8", "3", "z", "4")],
                               "a string, b string, c string, d string")
    out = C.residual_codes(df, top=2).collect()
    cols = {r.column for r in out}
    assert cols == {"a", "b"} or cols == {"a", "d"}
    assert {(r.column, r.code, r.n) for r in out if r.column == "a"} == {("a", -9.0, 2), ("a", -8.0, 1)}


@pytest.mark.parametrize("visit,names,expect", [
    (1, ["TOTIDE11", "PID"], ["TOTIDE1", "PID"]),
    (1, ["TOTIDE1", "VISIT"], ["TOTIDE", "VISIT"]),
    (10, ["X10", "AGE10"], ["X", "AGE"]),
    (0, ["X10", "Y"], ["X1", "Y"]),
])
def test_strip_visit_suffix(visit, names, expect):
    assert strip_visit_suffix(names, visit) == expect


def test_strip_visit_suffix_collision():
    with pytest.raises(ValueError):
        strip_visit_suffix(["A1", "A"], 1)


def test_visit_files_filters():
    names = ["demo_timestamp_0.tsv", "demo_timestamp_10.tsv", "notes.tsv", "cohort_cross_sectional.tsv",
             "demo_timestamp_3.csv"]
    assert visit_files(names) == [("demo_timestamp_0.tsv", 0), ("demo_timestamp_10.tsv", 10)]


def test_read_panel_multi_file(spark, tmp_path):
    (tmp_path / "demo_timestamp_0.tsv").write_text("PID\tVISIT\tTOTIDE10\tSTATUS0\n1\t0\t5\t2\n2\t0\t-9\t \n")
    (tmp_path / "demo_timestamp_1.tsv").write_text("PID\tVISIT\tTOTIDE11\tSTATUS1\tNEW1\n1\t1\t7\t3\tabc\n")
    (tmp_path / "demo_timestamp_10.tsv").write_text("PID\tVISIT\tTOTIDE110\tSTATUS10\n1\t10\t-1\t4\n")
    (tmp_path / "cohort_cross_sectional.tsv").write_text("PID\tDEGREE\n1\t3\n2\t-8\n")
    (tmp_path / "readme.txt").write_text("x")
    df = read_panel(spark, str(tmp_path))
    assert set(df.columns) == {"PID", "VISIT", "TOTIDE1", "STATUS", "NEW", "source_visit"}
    got = {(r.PID, r.VISIT): (r.TOTIDE1, r.STATUS) for r in df.collect()}
    assert got == {(1.0, 0.0): (5.0, 2.0), (2.0, 0.0): (None, None), (1.0, 1.0): (7.0, 3.0), (1.0, 10.0): (None, 4.0)}
    assert dict(df.dtypes)["NEW"] == "string"
    dim = read_table(spark, str(tmp_path / "cohort_cross_sectional.tsv"), sep="\t")
    assert rows(dim, "PID", "DEGREE") == [(1.0, 3.0), (2.0, None)]


def test_many_files_are_one_scan(spark, tmp_path):
    for v in range(1, 61):
        (tmp_path / f"w_timestamp_{v}.tsv").write_text(f"id{v}\tx y{v}\tnote{v}\n{v}\t{v / 2}\t\"a\tb\"\n\n{v}\t\tz\n")
    (tmp_path / "empty_timestamp_99.tsv").write_text("")
    df = read_panel(spark, str(tmp_path))
    assert df.columns == ["id", "x y", "note", "source_visit"] and df.count() == 120
    assert rows(df.filter("source_visit = 7")) == [(7.0, None, "z", 7), (7.0, 3.5, "a\tb", 7)] or \
        sorted(map(str, rows(df.filter("source_visit = 7")))) == sorted(map(str, [(7.0, 3.5, "a\tb", 7), (7.0, None, "z", 7)]))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") <= 2 and "Union" not in plan
    assert read_panel(spark, str(tmp_path), visits=[3, 5]).count() == 4
    with pytest.raises(ValueError, match="no visit files"):
        read_panel(spark, str(tmp_path), visits=[1000])
    (tmp_path / "w_timestamp_61.tsv").write_text("a\ta61\n1\t2\n")
    with pytest.raises(ValueError, match="both map"):
        read_panel(spark, str(tmp_path))


def test_written_rows_are_counted_and_none_raises(spark, tmp_path):
    from wavepanel.sources.io import write_rows
    df = spark.range(10).selectExpr("id", "id % 2 AS g")
    assert write_rows(df, str(tmp_path / "t"), partition_by=["g"]) == 10
    assert spark.read.parquet(str(tmp_path / "t")).count() == 10
    with pytest.raises(ValueError, match="no rows"):
        write_rows(df.filter("id < 0"), str(tmp_path / "none"))


def test_row_mean_and_pair_mean(spark):
    df = spark.createDataFrame([(None, None, None), (2.0, None, None), (1.0, 2.0, 4.0)], "a double, b double, c double")
    out = df.select(D.row_mean(["a", "b", "c"]).alias("m"), D.pair_mean("a", "b").alias("p")).collect()
    assert [r.m for r in out] == [None, 2.0, 7.0 / 3]
    assert [r.p for r in out] == [None, None, 1.5]


def test_zscore_constant_column(spark):
    df = spark.createDataFrame([(1.0, "g"), (1.0, "g"), (2.0, "h"), (4.0, "h")], "x double, g string")
    z = D.zscore(df, ["x"]).collect()
    assert all(r.x_z is not None for r in z)
    zg = D.zscore(df, ["x"], by="g", zero_sd="zero").collect()
    assert sorted(r.x_z for r in zg if r.g == "g") == [0.0, 0.0]
    zn = D.zscore(df.filter("g = 'g'"), ["x"]).collect()
    assert [r.x_z for r in zn] == [None, None]


def test_transform_domains(spark):
    df = spark.createDataFrame([(-1.0,), (-2.0,), (3.0,)], "x double")
    out = df.select(D.log1p("x").alias("l"), D.sqrt("x").alias("s")).collect()
    assert [r.l for r in out][:2] == [None, None] and [r.s for r in out][:2] == [None, None]
    assert math.isclose(out[2].l, math.log(4.0))


def test_finite_and_stars(spark):
    df = spark.createDataFrame([(float("nan"), 0.0005), (float("inf"), 0.02), (1.0, 0.3)], "x double, p double")
    out = df.select(D.finite("x").alias("f"), D.stars("p").alias("s")).collect()
    assert [r.f for r in out] == [None, None, 1.0]
    assert [r.s for r in out] == ["***", "*", ""]
