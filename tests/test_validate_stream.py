"""Check registry and streaming ingestion."""



from tests.conftest import SF_SMALL, none_safe, rows
from wavepanel.operators.reshape import observation_order
from wavepanel.plans.validate import validate
from wavepanel.sources.testdata import event_series, orders_panel
from wavepanel.streaming.ingest import ingest


def test_validate_runs_named_checks_and_reports_unknown(spark):
    p = orders_panel(spark, SF_SMALL)
    res = validate(p, ["m1", "e1", "stage"], ["distributions", "group_sizes", "no_such_check"],
                   key=["entity_id", "visit"], groups=["stage", "status"])
    assert res["skipped"] == ["no_such_check"]
    assert {r.variable for r in res["distributions.numeric"].collect()} == {"m1", "e1"}
    assert {r.variable for r in res["distributions.categorical"].collect()} == {"stage"}
    assert {r.variable for r in res["group_sizes.group_sizes"].collect()} == {"stage", "status"}
    ev = event_series(spark, SF_SMALL)
    st = validate(ev, ["value"], ["stationarity"], series="series_id", order=["t", "event_id"])
    assert st["stationarity.value"].count() == ev.select("series_id").distinct().count()
    assert not [c for c in st["stationarity.value"].columns if c.startswith("arch_")]


def test_validate_reads_text_as_numbers(spark):
    df = spark.createDataFrame([(str(float(i)), float(i * i % 7), "x") for i in range(30)] + [("junk", 3.0, " ")], "a string, b double, c string")
    res = validate(df, ["a", "b"], ["multicollinearity"])
    r = res["multicollinearity.correlation"].first()
    assert r.n == 30 and r.r is not None
    vif = [v.vif for v in res["multicollinearity.vif"].collect()]
    assert len(vif) == 2 and vif == sorted(vif, reverse=True)
    levels = validate(df, ["c"], ["distributions"])["distributions.categorical"].collect()
    assert [(v.value, v.n) for v in levels] == [("x", 30)]


def test_observation_order_of_one_large_entity(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 7, id % 11) AS e", "id AS t").repartition(6)
    got = [(r.e, r.t) for r in observation_order(df, ["e", "t"]).orderBy("obs").collect()]
    assert got == sorted(got) and len(got) == 5000
    places = observation_order(df, ["e", "t"])
    assert places.selectExpr("min(obs)", "max(obs)", "count(DISTINCT obs)").first() == (0, 4999, 5000)
    assert observation_order(df.limit(0), ["e", "t"]).count() == 0


def test_streaming_ingest_cleans_and_resumes(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "demo_timestamp_0.tsv").write_text("ID\tX\tY\n1\t-9\t3\n2\t99\t \n")
    (src / "notes.txt").write_text("ignored")
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    kw = dict(columns=["ID", "X", "Y"], numeric=["ID", "X", "Y"], ranges={"X": (1, 50)})
    ingest(spark, str(src), out, ck, **kw).awaitTermination()
    got = rows(spark.read.parquet(out), "ID", "X", "Y", "visit_from_file")
    assert got == sorted([(1.0, None, 3.0, 0), (2.0, 50.0, None, 0)], key=none_safe)
    (src / "demo_timestamp_1.tsv").write_text("ID\tX\tY\n1\t0\t-1\n")
    ingest(spark, str(src), out, ck, **kw).awaitTermination()        # resumes: only the new file is read
    got = rows(spark.read.parquet(out), "ID", "X", "Y", "visit_from_file")
    assert got == sorted([(1.0, None, 3.0, 0), (1.0, 0.0, None, 1), (2.0, 50.0, None, 0)], key=none_safe)


def test_series_checks_share_their_tests(spark, monkeypatch):
    from wavepanel.operators import series
    calls = []
    tests = series.series_tests
    monkeypatch.setattr(series, "series_tests", lambda *a, **kw: calls.append(a[3]) or tests(*a, **kw))
    res = validate(event_series(spark, SF_SMALL), ["value"], ["stationarity", "heteroscedasticity"], series="series_id", order=["t", "event_id"])
    assert calls == ["value"]
    assert {r.series for r in res["stationarity.value"].collect()} == {r.series for r in res["heteroscedasticity.value"].collect()}
