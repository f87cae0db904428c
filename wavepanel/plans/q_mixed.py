"""Mixed-model queries (MOD1-MOD10) on the orders panel.

Random-intercept models are held against SQL that finds the REML optimum itself
(``lmm_sql``); models with a slope at a given covariance, and their searched
optimum against a dense GLS in tests.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wavepanel.operators import mixed as M
from wavepanel.operators.derive import pair_mean, row_mean, zscore
from wavepanel.operators.describe import long_values
from wavepanel.plans import lmm_sql as Q
from wavepanel.plans.registry import register
from wavepanel.sources.testdata import ORDERS_PANEL_SQL, orders_panel, with_cte


def _stage_panel(spark, sf):
    p = orders_panel(spark, sf)
    return p.withColumn("m_avg", pair_mean("m1", "m2")).withColumn("composite", row_mean(["e1", "e2", "e3"]))


def _slope_fit(spark, sf):
    return M.fit_lmm(
        _stage_panel(spark, sf), "m_avg", "entity_id", fixed=["visit", "age"],
        factors={"stage": "5-LOW", "status": "mode"}, slope="visit")


def _intercept_fit(spark, sf):
    return M.fit_lmm(
        _stage_panel(spark, sf), "composite", "entity_id", fixed=["visit", "x1"], factors={"stage": "first"})


@register("lmm_slope_coefficients")
def q_lmm_slope(spark, sf):
    """MOD1, MOD2, MOD5: random intercept + visit slope, REML."""
    return _slope_fit(spark, sf).coefficients


@register("lmm_slope_variance")
def q_lmm_slope_var(spark, sf):
    return _slope_fit(spark, sf).variance


@register("lmm_slope_fit")
def q_lmm_slope_fit(spark, sf):
    """MOD6, MOD10: counts, scale, REML log-likelihood, convergence, R^2."""
    return _slope_fit(spark, sf).fit_stats


STAGES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _stage_terms(reference: str) -> dict[str, str]:
    return {f"stage[T.{v}]": f"CASE WHEN stage = '{v}' THEN 1 ELSE 0 END" for v in STAGES if v != reference}


COMPOSITE = f"SELECT *, (coalesce(e1, 0) + coalesce(e2, 0) + coalesce(e3, 0)) / nullif((e1 IS NOT NULL)::INT + (e2 IS NOT NULL)::INT " \
            f"+ (e3 IS NOT NULL)::INT, 0) AS composite, (m1 + m2) / 2 AS m_avg FROM ({ORDERS_PANEL_SQL})"
INTERCEPT_TERMS = {"Intercept": "1", **_stage_terms("1-URGENT"), "visit": "visit", "x1": "x1"}


def _intercept_sql(outcome: str, body: str) -> str:
    return Q.query([*Q.intercept_model(COMPOSITE, outcome, INTERCEPT_TERMS, f"{outcome} IS NOT NULL AND x1 IS NOT NULL"), Q.INTERCEPT_EFFECTS],
                   body)


def _rounded_coefficients(df):
    return df.select("term", *[(F.round(c, 3 if c == "z" else 4) + 0.0).alias(c) for c in ("coef", "se", "z", "p", "ci_lo", "ci_hi")], "stars")


@register("lmm_intercept_coefficients", _intercept_sql("composite", Q.coefficients(INTERCEPT_TERMS)))
def q_lmm_intercept(spark, sf):
    """MOD4: random intercept only on a composite outcome."""
    return _rounded_coefficients(_intercept_fit(spark, sf).coefficients)


@register("lmm_intercept_variance", _intercept_sql("composite", """
SELECT unnest(['Group Var', 'Scale']) AS component, round(unnest([g00 * s2, s2]), 4) + 0.0 AS value FROM fit"""))
def q_lmm_intercept_variance(spark, sf):
    """MOD4: the variance components at the REML optimum."""
    return _intercept_fit(spark, sf).variance.select("component", (F.round("value", 4) + 0.0).alias("value"))


def _fit_stats(df):
    return df.select("n_obs", "n_groups", F.round("scale", 4).alias("scale"), F.round("reml_llf", 3).alias("reml_llf"),
                     F.round("r2_marginal", 5).alias("r2_marginal"), F.round("r2_conditional", 5).alias("r2_conditional"))


@register("lmm_intercept_fit", _intercept_sql("composite", Q.FIT_STATS))
def q_lmm_intercept_fit(spark, sf):
    """MOD6, MOD10: counts, scale, log-likelihood and R2 of the random-intercept model."""
    return _fit_stats(_intercept_fit(spark, sf).fit_stats)


@register("lmm_intercept_blups", _intercept_sql("m_avg", """
SELECT count(*) AS n, round(stddev_pop(u0), 4) AS sd, round(avg(abs(u0)), 4) AS mean_size, round(min(u0), 3) AS least, round(max(u0), 3) AS most
FROM effects"""))
def q_lmm_intercept_blups(spark, sf):
    """MOD1: predicted random intercepts at the REML optimum, summarised (one by one in ``lmm_given_blups``)."""
    res = M.fit_lmm(_stage_panel(spark, sf), "m_avg", "entity_id", fixed=["visit", "x1"], factors={"stage": "first"})
    return res.blup().agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("u0"), 4).alias("sd"), F.round(F.avg(F.abs("u0")), 4).alias("mean_size"),
                          F.round(F.min("u0"), 3).alias("least"), F.round(F.max("u0"), 3).alias("most"))


#: A covariance of random intercept and slope over the residual variance, for checks at a given G.
GIVEN = [[0.3, -0.02], [-0.02, 0.01]]
SLOPE_TERMS = {"Intercept": "1", **_stage_terms("5-LOW"), "visit": "visit", "age": "age", "x1": "x1"}


def _given_fit(spark, sf):
    return M.fit_lmm(_stage_panel(spark, sf), "m_avg", "entity_id", fixed=["visit", "age", "x1"], factors={"stage": "5-LOW"}, slope="visit",
                     covariance=GIVEN)


def _given_sql(body: str) -> str:
    return Q.query([*Q.slope_model(COMPOSITE, "m_avg", SLOPE_TERMS, "visit", "m_avg IS NOT NULL AND x1 IS NOT NULL", GIVEN), Q.SLOPE_EFFECTS],
                   body)


@register("lmm_given_coefficients", _given_sql(Q.coefficients(SLOPE_TERMS)))
def q_lmm_given(spark, sf):
    """MOD1, MOD2, MOD5 at a given covariance of intercept and slope."""
    return _rounded_coefficients(_given_fit(spark, sf).coefficients)


@register("lmm_given_fit", _given_sql(Q.FIT_STATS))
def q_lmm_given_fit(spark, sf):
    """MOD6, MOD10 at a given covariance."""
    return _fit_stats(_given_fit(spark, sf).fit_stats)


@register("lmm_given_blups", _given_sql("SELECT entity_id AS entity, round(u0, 4) + 0.0 AS u0, round(u1, 4) + 0.0 AS u1 FROM effects"))
def q_lmm_given_blups(spark, sf):
    """Random intercepts and slopes at a given covariance."""
    return _given_fit(spark, sf).blup().select("entity", (F.round("u0", 4) + 0.0).alias("u0"), (F.round("u1", 4) + 0.0).alias("u1"))


@register("lmm_given_errors", _given_sql(Q.ERRORS))
def q_lmm_given_errors(spark, sf):
    """MOD8 at a given covariance."""
    return _errors(M.fit_errors(_stage_panel(spark, sf), _given_fit(spark, sf), "model", "m_avg", "entity_id", "visit"))


def _errors(df):
    return df.select("model", F.round("rmse", 5).alias("rmse"), F.round("mae", 5).alias("mae"), "n")


@register("lmm_given_residuals", _given_sql(f"""
SELECT count(*) AS n, round(avg(y - f), 4) + 0.0 AS mean_residual, round(stddev_samp(y - f), 4) AS sd_residual, round(avg(f), 4) AS mean_fitted
FROM (SELECT y, {Q.FITTED} AS f FROM base, fit)"""))
def q_lmm_given_residuals(spark, sf):
    """MOD7 at a given covariance."""
    panel = _stage_panel(spark, sf).dropna(subset=["m_avg", "visit", "age", "x1", "stage"])
    r = M.marginal_residuals(panel, _given_fit(spark, sf), "model", "m_avg")
    return r.agg(F.count(F.lit(1)).alias("n"), (F.round(F.avg("residual"), 4) + 0.0).alias("mean_residual"),
                 F.round(F.stddev_samp("residual"), 4).alias("sd_residual"), F.round(F.avg("fitted"), 4).alias("mean_fitted"))


SYMPTOMS = ["e1", "e2", "e3", "x1"]


@register("lmm_symptom_batch")
def q_lmm_batch(spark, sf):
    """MOD3: one model per z-scored symptom, all fitted from one pass."""
    p = _stage_panel(spark, sf)
    long = long_values(p, SYMPTOMS, ids=["entity_id", "visit", "age", "stage", "m_avg"], name="symptom",
                       value="level")
    long = zscore(long, ["level"], by="symptom")
    res = M.fit_lmm(long, "m_avg", "entity_id", fixed=["visit", "age", "level_z"],
                    factors={"stage": "5-LOW"}, slope="visit", model="symptom")
    return res.coefficients.filter(F.col("term") == "level_z")


@register("lmm_path_coefficients", _intercept_sql("composite", f"""
SELECT term AS predictor, 'composite' AS outcome, coef, p, stars FROM ({Q.coefficients(INTERCEPT_TERMS)}) WHERE term IN ('visit', 'x1')"""))
def q_lmm_paths(spark, sf):
    """MOD9: named predictor -> outcome paths with p-values and stars."""
    c = _rounded_coefficients(_intercept_fit(spark, sf).coefficients)
    return c.filter(F.col("term").isin("visit", "x1")).select(
        F.col("term").alias("predictor"), F.lit("composite").alias("outcome"), "coef", "p", "stars")


OUTCOMES = ["m1", "m2", "e1", "e2"]


def _outcome_sql(outcome: str) -> str:
    fit = _intercept_sql(outcome, Q.coefficients(INTERCEPT_TERMS))
    return f"SELECT term, '{outcome}' AS outcome, coef FROM ({fit})"


@register("lmm_predictor_outcomes", "SELECT term, " + ", ".join(f"max(coef) FILTER (outcome = '{o}') AS {o}" for o in OUTCOMES)
          + " FROM (" + " UNION ALL ".join(_outcome_sql(o) for o in OUTCOMES) + ") WHERE term <> 'Intercept' GROUP BY term")
def q_lmm_predictor_outcomes(spark, sf):
    """RSH3: predictor x outcome table of coefficients, four outcomes fitted in one call."""
    from wavepanel.operators.reshape import pivot_first
    long = long_values(_stage_panel(spark, sf), OUTCOMES, ids=["entity_id", "visit", "x1", "stage"], name="outcome", value="score")
    res = M.fit_lmm(long, "score", "entity_id", fixed=["visit", "x1"], factors={"stage": "first"}, model="outcome")
    wide = pivot_first(res.coefficients.filter(F.col("term") != "Intercept"), "term", "model", "coef", OUTCOMES)
    return wide.select("term", *[(F.round(o, 4) + 0.0).alias(o) for o in OUTCOMES])


@register("lmm_residual_order")
def q_lmm_residual_order(spark, sf):
    """WIN8: marginal residuals of the model against observation order."""
    from wavepanel.operators.reshape import residual_by_order
    return residual_by_order(_residuals(spark, sf), ["entity_id", "visit"])


@register("lmm_fit_errors", _intercept_sql("composite", Q.ERRORS))
def q_lmm_errors(spark, sf):
    """MOD8: RMSE / MAE of fitted values including random effects."""
    p = _stage_panel(spark, sf)
    return _errors(M.fit_errors(p, _intercept_fit(spark, sf), "model", "composite", "entity_id", None))


@register("lmm_blups")
def q_lmm_blups(spark, sf):
    return _slope_fit(spark, sf).blup()


@register("lmm_residual_summary")
def q_lmm_residuals(spark, sf):
    """MOD7: fixed-effects predictions and marginal residuals, summarised."""
    p = _stage_panel(spark, sf).dropna(subset=["m_avg", "visit", "age", "stage", "status"])
    res = _slope_fit(spark, sf)
    r = M.marginal_residuals(p, res, "model", "m_avg")
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg("residual").alias("mean_residual"),
                 F.stddev_samp("residual").alias("sd_residual"), F.avg("fitted").alias("mean_fitted"))


@register("lmm_group_counts", with_cte("""
SELECT count(*) AS n_obs, count(DISTINCT entity_id) AS n_groups,
       min(c) AS min_group, max(c) AS max_group, round(avg(c), 6) AS mean_group
FROM (SELECT entity_id, count(*) OVER (PARTITION BY entity_id) AS c FROM panel
      WHERE m1 IS NOT NULL AND m2 IS NOT NULL) t""", panel=ORDERS_PANEL_SQL))
def q_lmm_counts(spark, sf):
    """MOD10 counts, from the fit's per-entity table: rows, groups, group sizes
    (the oracle averages per row, so weight group sizes by rows)."""
    res = _slope_fit(spark, sf)
    e = res.entity_table
    return e.agg(F.sum("n_i").alias("n_obs"), F.count(F.lit(1)).alias("n_groups"),
                 F.min("n_i").alias("min_group"), F.max("n_i").alias("max_group"),
                 F.round(F.sum(F.col("n_i") * F.col("n_i")) / F.sum("n_i"), 6).alias("mean_group"))


@register("lmm_slope_distributed")
def q_lmm_distributed(spark, sf):
    """MOD1 through the distributed-likelihood path (forced with
    max_patterns=0): the plan used when visit patterns are unbounded."""
    res = M.fit_lmm(_stage_panel(spark, sf), "m_avg", "entity_id", fixed=["visit", "age"],
                    factors={"stage": "5-LOW", "status": "mode"}, slope="visit", max_patterns=0)
    return res.coefficients


def _residuals(spark, sf):
    p = _stage_panel(spark, sf).dropna(subset=["m_avg", "visit", "age", "stage", "status"])
    return M.marginal_residuals(p, _slope_fit(spark, sf), "model", "m_avg")


@register("lmm_residual_normality")
def q_lmm_residual_normality(spark, sf):
    """Model diagnostics (TST3, TST4, PRJ27): Shapiro-Wilk and Anderson-Darling
    of all marginal residuals, and the decision."""
    from wavepanel.operators.hypothesis import normality_verdict
    return normality_verdict(long_values(_residuals(spark, sf), ["residual"]))


@register("lmm_residual_bins")
def q_lmm_residual_bins(spark, sf):
    """PLT6: residual vs fitted as a 2-D binned density."""
    from wavepanel.operators.plotdata import binned_2d
    return binned_2d(_residuals(spark, sf), "fitted", "residual", 0.25, 0.5)
