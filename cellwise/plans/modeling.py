"""Expected-rate models, classifiers and holdout evaluation on the stored panel."""

from pyspark.sql import functions as F

from cellwise.operators import absorb
from cellwise.operators import calendar as cal
from cellwise.operators import evaluation as E
from cellwise.operators import labels, ranking, sampling
from cellwise.operators import modeling as H
from cellwise.plans import base as B
from cellwise.plans import labels as L
from cellwise.plans.registry import query
from cellwise.session import freeze

OUTCOME = "start_rate"
BASIC = H.Spec(("start_rate_lag1", "employment_growth", "income"), ("ind",), "yr", name="basic")
LINEAR = H.Spec(("employment_growth",), (), None, name="linear")
WITHIN = H.Spec(("employment_growth",), ("ind",), None, name="within")
SCORE = H.Spec(("start_rate", "start_rate_lag1", "employment_growth"), ("ind",), "predictor_year", name="simple")
WIDE = H.Spec(("start_rate", "start_rate_lag1", "employment_growth", "income", "open_pct", "pending_pct"), ("ind",), "predictor_year", name="extended")


def model_rows(spark, folder):
    """The columns models use, cut from the stored panel once."""
    return B.panel_table(spark, folder).select(
        *B.KEY, OUTCOME, "start_rate_lag1", "start_rate_lag2", "start_rate_lag3", "employment_growth", "establishment_growth",
        "payroll_growth", "pay_growth", "income", "open_pct", "pending_pct", "population",
    )


_FITTED = ", d AS (SELECT geo, ind, yr, start_rate, employment_growth FROM analytic_panel WHERE start_rate IS NOT NULL AND employment_growth IS NOT NULL)"


@query(
    "expected_rate_linear",
    B.with_sql(B.PANEL_SQL)
    + _FITTED
    + """, f AS (SELECT regr_slope(start_rate, employment_growth) AS b, regr_intercept(start_rate, employment_growth) AS a FROM d WHERE yr <= 2000)
         SELECT geo, ind, yr, round(a + b * employment_growth, 6) AS expected_rate, round(start_rate - (a + b * employment_growth), 6) AS residual FROM d, f""",
)
def expected_rate_linear(spark, folder):
    """OLS fitted through the cutoff year and applied to all years."""
    rows = model_rows(spark, folder)
    model = H.fit_expected(rows.filter("yr <= 2000"), OUTCOME, LINEAR, 2000, "yr")
    return B.rounded(H.predict_expected(model, rows).select(*B.KEY, "expected_rate", "residual"))


@query(
    "expected_rate_category_effects",
    B.with_sql(B.PANEL_SQL)
    + _FITTED
    + """, t AS (SELECT * FROM d WHERE yr <= 2000), m AS (SELECT ind, avg(start_rate) AS ym, avg(employment_growth) AS xm FROM t GROUP BY 1),
         b AS (SELECT sum((employment_growth - xm) * (start_rate - ym)) / sum((employment_growth - xm) ** 2) AS b FROM t JOIN m USING (ind))
         SELECT geo, ind, yr, round(ym + b * (employment_growth - xm), 5) AS expected_rate FROM d JOIN m USING (ind), b""",
)
def expected_rate_category_effects(spark, folder):
    """OLS with category effects: the same line inside every category."""
    rows = model_rows(spark, folder)
    model = H.fit_expected(rows.filter("yr <= 2000"), OUTCOME, WITHIN, 2000, "yr")
    return H.predict_expected(model, rows).select(*B.KEY, F.round("expected_rate", 5).alias("expected_rate"))


@query(
    "expected_rate_absorbed_categories",
    B.with_sql(B.PANEL_SQL)
    + _FITTED
    + """, t AS (SELECT * FROM d WHERE yr <= 2000), m AS (SELECT ind, avg(start_rate) AS ym, avg(employment_growth) AS xm FROM t GROUP BY 1),
         b AS (SELECT sum((employment_growth - xm) * (start_rate - ym)) / sum((employment_growth - xm) ** 2) AS b FROM t JOIN m USING (ind))
         SELECT geo, ind, yr, round(ym + b * (employment_growth - xm), 5) AS expected_rate FROM d JOIN m USING (ind), b""",
)
def expected_rate_absorbed_categories(spark, folder):
    """The line inside every category, with the category effects absorbed."""
    rows = model_rows(spark, folder).filter("start_rate IS NOT NULL")
    model = absorb.fit(rows.filter("yr <= 2000"), OUTCOME, ["employment_growth"], ["ind"])
    return absorb.predict(model, rows).select(*B.KEY, F.round("expected_rate", 5).alias("expected_rate"))


@query(
    "expected_rate_absorbed_places",
    B.with_sql(B.PANEL_SQL)
    + _FITTED
    + """, t AS (SELECT * FROM d WHERE yr <= 2000), m AS (SELECT geo, avg(start_rate) AS ym, avg(employment_growth) AS xm FROM t GROUP BY 1),
         b AS (SELECT sum((employment_growth - xm) * (start_rate - ym)) / sum((employment_growth - xm) ** 2) AS b FROM t JOIN m USING (geo))
         SELECT geo, count(*) AS n, round(avg(start_rate - ym - b * (employment_growth - xm)), 5) AS mean_residual FROM d JOIN m USING (geo), b WHERE yr > 2000 GROUP BY 1""",
)
def expected_rate_absorbed_places(spark, folder):
    """Place effects of any number of levels: the mean miss of every trained place after the cutoff."""
    rows = model_rows(spark, folder).filter("start_rate IS NOT NULL")
    model = absorb.fit(rows.filter("yr <= 2000"), OUTCOME, ["employment_growth"], ["geo"])
    scored = absorb.predict(model, rows.filter("yr > 2000"))
    return scored.groupBy("geo").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(OUTCOME) - F.col("expected_rate")), 5).alias("mean_residual"))


@query(
    "complete_case_sample",
    B.with_sql(B.PANEL_SQL)
    + """SELECT yr, count(*) AS n FROM analytic_panel WHERE start_rate IS NOT NULL AND start_rate_lag1 IS NOT NULL AND employment_growth IS NOT NULL AND income IS NOT NULL GROUP BY 1""",
)
def complete_case_sample(spark, folder):
    rows = H.complete_cases(model_rows(spark, folder), [OUTCOME, *BASIC.fields])
    return rows.groupBy("yr").agg(F.count(F.lit(1)).alias("n"))


@query("expected_rate_full_model")
def expected_rate_full_model(spark, folder):
    """Category and year effects; later years keep the effect of the last trained year."""
    rows = model_rows(spark, folder)
    training = rows.filter("yr <= 2000")
    model = H.fit_expected(training, OUTCOME, BASIC, 2000, "yr")
    return B.rounded(H.predict_expected(model, rows, training).select(*B.KEY, "expected_rate", "residual"))


@query("expected_rate_interaction_and_huber")
def expected_rate_interaction_and_huber(spark, folder):
    rows = model_rows(spark, folder)
    training = rows.filter("yr <= 2000")
    mixed = H.Spec(BASIC.numeric, BASIC.categorical, "yr", ("employment_growth", "ind"), "interaction")
    fits = {
        "interaction": H.fit_expected(training, OUTCOME, mixed, 2000, "yr"),
        "huber": H.fit_expected(training, OUTCOME, BASIC, 2000, "yr", "huber"),
    }
    result = None
    for name, model in fits.items():
        part = H.predict_expected(model, rows, training).select(F.lit(name).alias("model"), OUTCOME, "expected_rate")
        result = part if result is None else result.unionByName(part)
    return B.rounded(E.regression_metrics(freeze(result), ["model"], OUTCOME, "expected_rate"))


@query("expected_rate_specifications")
def expected_rate_specifications(spark, folder):
    """Specification variants over two expanding cutoffs, ranked by error and fold wins."""
    rows = freeze(model_rows(spark, folder))
    specs = [
        BASIC,
        BASIC.without("start_rate_lag1"),
        BASIC.replacing("start_rate_lag1", "start_rate_lag1", "start_rate_lag2"),
        BASIC.replacing("employment_growth", "payroll_growth"),
        H.Spec(BASIC.numeric, ("ind", "geo_text"), "yr", name="place_effects"),
    ]
    with_place = rows.withColumn("geo_text", F.col("geo").cast("string"))
    metrics = H.compare_specs(with_place, {"fold_1": 1999, "fold_2": 2000}, OUTCOME, specs, "yr")
    return B.rounded(H.winner(metrics))


@query("expected_rate_coefficients")
def expected_rate_coefficients(spark, folder):
    """Coefficients of three cutoffs and their stability."""
    rows = freeze(model_rows(spark, folder))
    coefficients = None
    for cutoff in (1998, 1999, 2000):
        model = H.fit_expected(rows.filter(F.col("yr") <= cutoff), OUTCOME, BASIC, cutoff, "yr")
        part = H.expected_coefficients(model, spark).withColumn("cutoff", F.lit(cutoff))
        coefficients = part if coefficients is None else coefficients.unionByName(part)
    return B.rounded(E.coefficient_stability(coefficients, ["term"]))


# --- classifiers


def fold_rows(spark, folder):
    """Labelled pairs with predictor-year features, frozen once for all fits."""
    pairs = L.labelled(spark, folder).select(
        "fold", "split_role", "geo", "ind", "predictor_year", "target_year", "start_rate", "start_rate_lag1",
        "employment_growth", "income", "population", "gap_p20", "gap_p25", "target_rate",
    )
    extra = model_rows(spark, folder).select(
        "geo", "ind", F.col("yr").alias("predictor_year"), "open_pct", "pending_pct", "payroll_growth"
    )
    joined = pairs.join(extra, ["geo", "ind", "predictor_year"], "left")
    return freeze(H.complete_cases(joined, ["start_rate", "employment_growth", "gap_p20"]))


def lagless(spec):
    """The 1995 pairs have no prior year, so the first fold learns without the lag."""
    return spec.without("start_rate_lag1")


DEV_FOLDS = ["fold_2"]


@query(
    "prevalence_by_fold",
    L.SQL + "SELECT fold, round(avg(gap_p20), 6) AS train_prevalence FROM labelled WHERE split_role = 'training' GROUP BY 1",
)
def prevalence_by_fold(spark, folder):
    rows = L.labelled(spark, folder).filter("split_role = 'training'")
    return B.rounded(rows.groupBy("fold").agg(F.avg("gap_p20").alias("train_prevalence")))


@query("logistic_out_of_fold")
def logistic_out_of_fold(spark, folder):
    rows = fold_rows(spark, folder)
    scored = H.out_of_fold(rows, [*DEV_FOLDS, "final_holdout"], "gap_p20", SCORE)
    return B.rounded(ranking.performance(scored, ["fold"], "gap_p20", "probability"))


@query("logistic_odds_ratios")
def logistic_odds_ratios(spark, folder):
    rows = fold_rows(spark, folder).filter("fold = 'final_holdout' AND split_role = 'training'")
    return B.rounded(H.logistic_coefficients(H.fit_classifier(rows, "gap_p20", SCORE), spark))


@query("tree_models_out_of_fold")
def tree_models_out_of_fold(spark, folder):
    """Forest and boosted trees beside the logistic model on the holdout."""
    rows = fold_rows(spark, folder)
    result = None
    for model, params in (("logistic", {}), ("random_forest", {}), ("boosted", {"rounds": 10, "leaves": 15})):
        scored = H.out_of_fold(rows, ["final_holdout"], "gap_p20", SCORE, model, params)
        part = ranking.performance(scored.withColumn("model", F.lit(model)), ["model"], "gap_p20", "probability")
        result = part if result is None else result.unionByName(part)
    return B.rounded(result)


@query("inner_temporal_tuning")
def inner_temporal_tuning(spark, folder):
    """Grid choice on the latest training year only."""
    rows = fold_rows(spark, folder).filter("fold = 'final_holdout' AND split_role = 'training'")
    grid = [{"numTrees": 20, "maxDepth": d, "minInstancesPerNode": m} for d in (3, 6) for m in (5, 15)]
    _, table = H.tune(rows, "gap_p20", lagless(SCORE), "random_forest", grid, "predictor_year")
    return B.rounded(table)


@query("permutation_importance")
def permutation_importance(spark, folder):
    rows = fold_rows(spark, folder).filter("fold = 'final_holdout'")
    fitted = H.fit_classifier(rows.filter("split_role = 'training'"), "gap_p20", H.Spec(("start_rate", "employment_growth"), name="two"))
    result = H.permutation_importance(
        fitted, rows.filter("split_role = 'validation'"), ["geo", "ind", "target_year"], repeats=2
    )
    return B.rounded(result)


@query("feature_ablation")
def feature_ablation(spark, folder):
    rows = fold_rows(spark, folder)
    result = None
    for spec in (SCORE, SCORE.without("employment_growth"), SCORE.without("ind"), SCORE.without("start_rate_lag1")):
        scored = H.out_of_fold(rows, ["final_holdout"], "gap_p20", spec)
        part = ranking.performance(scored.withColumn("spec", F.lit(spec.name)), ["spec"], "gap_p20", "probability", {"top10": 0.1})
        result = part if result is None else result.unionByName(part)
    return B.rounded(result)


@query("leave_one_category_out")
def leave_one_category_out(spark, folder):
    rows = fold_rows(spark, folder)
    return B.rounded(H.leave_one_out(rows, "ind", ["final_holdout"], "gap_p20", lagless(SCORE)))


@query("partial_dependence")
def partial_dependence(spark, folder):
    rows = fold_rows(spark, folder).filter("fold = 'final_holdout' AND split_role = 'training'")
    fitted = H.fit_classifier(rows, "gap_p20", SCORE)
    return B.rounded(
        H.partial_dependence(fitted, rows, ["start_rate", "employment_growth"], ["geo", "ind", "predictor_year"], grid_size=6)
    )


@query("unseen_place_model")
def unseen_place_model(spark, folder):
    """Train on one hash share of places and score the others."""
    rows = sampling.with_group_role(fold_rows(spark, folder).filter("fold = 'final_holdout'"), "geo", 0.3)
    training = rows.filter("role = 'train' AND split_role = 'training'")
    tested = rows.filter("role = 'test' AND split_role = 'validation'")
    scored = freeze(H.predict_probability(H.fit_classifier(training, "gap_p20", lagless(SCORE)), tested))
    return B.rounded(ranking.performance(scored, ["role"], "gap_p20", "probability"))


@query("robustness_suite")
def robustness_suite(spark, folder):
    """Alternative label, growth measure, tail clipping, year exclusion, size slices and core features."""
    rows = fold_rows(spark, folder)
    holdout = ["final_holdout"]
    base = lagless(SCORE)

    def clip(training, validation):
        name = "employment_growth"
        return (
            H.winsorize(training, training, name, "_clipped").drop(name).withColumnRenamed("_clipped", name),
            H.winsorize(training, validation, name, "_clipped").drop(name).withColumnRenamed("_clipped", name),
        )

    def check(variant, scored, label="gap_p20"):
        result = ranking.performance(scored.withColumn("variant", F.lit(variant)), ["variant"], label, "probability")
        return result.select("variant", "n", "prevalence", "average_precision", "roc_auc", "top10_lift")

    primary = H.out_of_fold(rows, holdout, "gap_p20", base)
    training = rows.filter("fold = 'final_holdout' AND split_role = 'training'").select("geo", "population")
    sized = E.size_groups(training, primary, "geo", "population")
    by_size = ranking.performance(sized, ["size_group"], "gap_p20", "probability").select(
        F.col("size_group").alias("variant"), "n", "prevalence", "average_precision", "roc_auc", "top10_lift"
    )
    return B.rounded(
        E.scorecard(
            {
                "primary": check("primary", primary),
                "alternative_label": check("gap_p25", H.out_of_fold(rows, holdout, "gap_p25", base), "gap_p25"),
                "growth_measure": check(
                    "payroll_growth", H.out_of_fold(rows, holdout, "gap_p20", base.replacing("employment_growth", "payroll_growth"))
                ),
                "tail_clipping": check("p01_p99", H.out_of_fold(rows, holdout, "gap_p20", base, prepare=clip)),
                "year_exclusion": check(
                    "without_1999", H.out_of_fold(rows.filter("target_year <> 1999"), holdout, "gap_p20", base)
                ),
                "core_only": check("core", H.out_of_fold(rows, holdout, "gap_p20", H.Spec(("start_rate",), name="core"))),
                "size": by_size,
            }
        )
    )


@query("holdout_evaluation")
def holdout_evaluation(spark, folder):
    """Fit expectation, cutoff and classifier on development years; then score the holdout.

    The development frame is cut before any fit, and the holdout frame is first read
    after the classifier exists.
    """
    rows = model_rows(spark, folder)
    development = rows.filter(f"yr <= {B.DEV_LAST_YEAR}")
    expected = H.fit_expected(development, OUTCOME, LINEAR, B.DEV_LAST_YEAR, "yr")
    cutoff = labels.frozen_cutoff(freeze(H.predict_expected(expected, development)), "residual")

    def candidates(frame):
        scored = H.predict_expected(expected, frame).select(*B.KEY, "residual")
        return cal.exact_pairs(
            frame.join(scored, B.KEY, "left"), B.PANEL, "yr", B.HORIZON,
            ["start_rate", "start_rate_lag1", "employment_growth", "income"], {"residual": "target_residual"},
        ).withColumn("gap", (F.col("target_residual") <= cutoff).cast("int"))

    spec = lagless(SCORE)
    training = H.complete_cases(candidates(development), ["gap", *spec.fields])
    logistic = H.fit_classifier(training, "gap", spec)
    boosted = H.fit_classifier(training, "gap", spec, "boosted", {"rounds": 10, "leaves": 15})
    holdout = H.complete_cases(candidates(rows).filter(f"target_year > {B.DEV_LAST_YEAR}"), ["gap", *spec.fields])
    scored = freeze(H.predict_probability(boosted, H.predict_probability(logistic, holdout, "logistic"), "boosted"))
    long = scored.unpivot(["ind", "target_year", "gap"], ["logistic", "boosted"], "model", "score")
    whole = ranking.performance(long, ["model"], "gap", "score").withColumn("slice", F.lit("all"))
    by_year = ranking.performance(long, ["model", "target_year"], "gap", "score").withColumn(
        "slice", F.col("target_year").cast("string")
    )
    by_category = ranking.guarded_performance(long, ["model", "ind"], "gap", "score", 10).withColumnRenamed("ind", "slice")
    return B.rounded(
        E.scorecard({"overall": whole, "year": by_year.drop("target_year"), "category": by_category})
    )
