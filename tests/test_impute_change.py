"""kNN imputation, change events, entity selection: hand-made cases."""


from tests.conftest import rows
from wavepanel.operators.change import DOWN, UP, decline_rates, last_stage, visit_changes
from wavepanel.operators.describe import mode_value, quantile_shift
from wavepanel.operators.impute import k_sweep, knn_impute
from wavepanel.operators.select import attach_dimension, keep_entities

SCHEMA = "e long, v long, k long, x double"


def imputed(spark, data, k=4):
    df = spark.createDataFrame(data, SCHEMA)
    out = knn_impute(df, "e", ["v", "k"], ["x"], k=k)
    return {(r.e, r.v, r.k): (r.x_imputed, r.x_filled) for r in out.collect()}


def test_knn_untouched_cases(spark):
    got = imputed(spark, [
        (1, 0, 0, None),                                  # single-row entity: untouched
        (2, 0, 0, None), (2, 1, 1, None),                 # nothing observed: untouched
        (3, 0, 0, 1.4), (3, 1, 1, 2.6)])                  # nothing missing: untouched, not rounded
    assert got[(1, 0, 0)] == (None, None)
    assert got[(2, 0, 0)] == (None, None) and got[(2, 1, 1)] == (None, None)
    assert got[(3, 0, 0)] == (1.4, 1.4) and got[(3, 1, 1)] == (2.6, 2.6)


def test_knn_one_observed_and_rounding_of_observed(spark):
    got = imputed(spark, [(1, 0, 0, 2.6), (1, 3, 1, None)])
    assert got[(1, 3, 1)] == (3.0, 3.0)
    assert got[(1, 0, 0)] == (3.0, 2.6)                  # *_imputed holds the rounded observed value


def test_knn_half_even_rounding(spark):
    got = imputed(spark, [(1, 0, 0, 2.0), (1, 1, 1, None), (1, 2, 2, 3.0),
                          (2, 0, 0, 3.0), (2, 1, 1, None), (2, 2, 2, 4.0)])
    assert got[(1, 1, 1)][0] == 2.0                      # 2.5 -> 2
    assert got[(2, 1, 1)][0] == 4.0                      # 3.5 -> 4


def test_knn_distance_weights_and_k_boundary_tie(spark):
    # missing at visit 2; observed at 0 (d=2), 1 (d=1), 4 (d=2), 5 (d=3); k=2 keeps d=1 and the
    # d=2 donor with the smaller visit (visit 0): (1*10 + 0.5*4) / 1.5 = 8
    got = imputed(spark, [(1, 0, 0, 4.0), (1, 1, 1, 10.0), (1, 2, 2, None), (1, 4, 3, 100.0),
                          (1, 5, 4, 7.0)], k=2)
    assert got[(1, 2, 2)][0] == 8.0


def test_knn_duplicate_visit_distance_zero(spark):
    # donor at the same visit (d = 0) wins outright
    got = imputed(spark, [(1, 3, 0, 9.0), (1, 3, 1, None), (1, 4, 2, 1.0), (1, 2, 3, 1.0)])
    assert got[(1, 3, 1)][0] == 9.0


def test_knn_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    data = []
    for e in range(40):
        for v in range(rnd.randint(1, 12)):
            data.append((e, v, v, None if rnd.random() < 0.4 else float(rnd.randint(0, 12))))
    got = imputed(spark, data, k=3)
    by_e = {}
    for e, v, k, x in data:
        by_e.setdefault(e, []).append((v, k, x))
    for e, recs in by_e.items():
        obs = [(v, k, x) for v, k, x in recs if x is not None]
        for v, k, x in recs:
            if x is not None or len(recs) < 2 or not obs:
                continue
            cand = sorted(obs, key=lambda o: (abs(o[0] - v), o[0], o[1]))[:min(3, len(obs))]
            zero = [o for o in cand if o[0] == v]
            if zero:
                val = sum(o[2] for o in zero) / len(zero)
            else:
                val = sum(o[2] / abs(o[0] - v) for o in cand) / sum(1 / abs(o[0] - v) for o in cand)
            assert got[(e, v, k)][0] == round(val), (e, v, val)
            # imputed value lies within the entity's observed range
            assert min(o[2] for o in obs) <= got[(e, v, k)][0] <= max(o[2] for o in obs) or \
                abs(got[(e, v, k)][0] - val) <= 0.5


def test_k_sweep_counts(spark):
    df = spark.createDataFrame([(1, 0, 0, 2.0), (1, 1, 1, None), (1, 2, 2, 4.0), (1, 3, 3, None)], SCHEMA)
    out = {(r.variable, r.k): r.n_imputed for r in k_sweep(df, "e", ["v", "k"], ["x"], (1, 2)).collect()}
    assert out == {("x", 1): 2, ("x", 2): 2}


def test_changes_gap_null_and_last_stage(spark):
    df = spark.createDataFrame([
        (1, 0, "A", 5.0), (1, 3, "A", 4.0),        # gap in visits still adjacent: change -1
        (1, 4, "B", None), (1, 5, "C", 6.0),       # null in the middle drops both neighbouring changes
        (1, 6, "C", 8.0)], "e long, v long, s string, y double")
    ch = visit_changes(df, "e", ["v"], "s", {"y": ("down", DOWN)})
    got = rows(ch, "v", "last_stage", "change", "flagged")
    assert got == [(3, "C", -1.0, 1), (6, "C", 2.0, 0)]
    up = visit_changes(df, "e", ["v"], "s", {"y": ("up", UP)})
    assert rows(up, "v", "flagged") == [(3, 0), (6, 1)]
    rates = {(r.stage, r.measure): r.flagged_pct for r in decline_rates(ch).collect()}
    assert rates == {("C", "y"): 50.0, ("C", None): 50.0}
    assert rows(last_stage(df, "e", "v", "s")) == [(1, "C")]


def test_keep_entities(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 2.0), (2, 1.0, 1.0), (2, 2.0, None),
                                (3, 1.0, None), (3, 2.0, None), (3, 3.0, None), (3, 4.0, None), (3, 5.0, None)],
                               "e long, a double, b double")
    for method in ("join", "window"):
        kept = keep_entities(df, "e", ["a", "b"], min_obs=2, method=method)
        assert {r.e for r in kept.collect()} == {1}


def test_attach_dimension_rejects_duplicate_keys(spark):
    import pytest
    panel = spark.createDataFrame([(1,), (2,)], "e long")
    dim = spark.createDataFrame([(1, "x"), (1, "y")], "e long, d string")
    with pytest.raises(ValueError):
        attach_dimension(panel, dim, "e")


def test_mode_tie_and_pct_change_from_zero(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (1.0,), (2.0,)], "x double")
    assert mode_value(df, "x").collect()[0]["mode"] == 1.0
    a = spark.createDataFrame([(0.0,), (0.0,)], "x double")
    b = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    shift = {r.statistic: r.pct_change for r in quantile_shift(a, b, ["x"], [0.5]).collect()}
    assert shift["mean"] is None
