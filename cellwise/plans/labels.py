"""Exact-horizon pairs, folds, thresholds and labels on the stored panel.

The expected rate is a per-category regression of the rate on growth, fitted per
fold on years whose outcomes are known then. It is plain SQL, so the labels that
follow can be compared value by value.
"""

from pyspark.sql import functions as F

from cellwise.operators import calendar as cal
from cellwise.operators import checks as K
from cellwise.operators import evaluation as E
from cellwise.operators import joins, labels, profile
from cellwise.plans import base as B
from cellwise.plans.registry import query
from cellwise.session import freeze, scratch_path

FOLDS = labels.expanding_folds(1995, 1997, 1998, B.HORIZON, start=1)
FEATURES = ["start_rate", "start_rate_lag1", "employment_growth", "income", "population", "support_employment"]
OUTCOMES = {"start_rate": "target_rate", "employment_growth": "target_growth"}


def pairs(spark, folder):
    """Exact pairs; complete rows carry the target-year outcome."""
    return cal.exact_pairs(B.panel_table(spark, folder), B.PANEL, "yr", B.HORIZON, FEATURES, OUTCOMES)


def fit_rows(spark, folder):
    """Complete rows once per fold that may learn from them."""
    rows = B.panel_table(spark, folder).select(*B.KEY, "start_rate", "employment_growth").dropna()
    folds = F.array_compact(F.array(*[F.when(F.col("yr") <= f.fit_last, F.lit(f.name)) for f in FOLDS]))
    return rows.withColumn("fold", F.explode(folds))


def fold_fits(spark, folder):
    """Slope and intercept per fold and category; bounded by folds times categories."""
    return fit_rows(spark, folder).groupBy("fold", "ind").agg(
        F.regr_slope("start_rate", "employment_growth").alias("slope"),
        F.regr_intercept("start_rate", "employment_growth").alias("intercept"),
    )


def training_residuals(spark, folder):
    expected = F.col("intercept") + F.col("slope") * F.col("employment_growth")
    return (
        fit_rows(spark, folder)
        .join(fold_fits(spark, folder), ["fold", "ind"])
        .withColumn("expected_rate", expected)
        .withColumn("residual", F.col("start_rate") - expected)
    )


def cutoffs(spark, folder):
    return labels.thresholds(training_residuals(spark, folder), ["fold"])


def scored_pairs(spark, folder):
    """(pair x fold x role) with the fold's expectation at the target year."""
    roles = labels.assign_folds(pairs(spark, folder), FOLDS)
    expected = F.col("intercept") + F.col("slope") * F.col("target_growth")
    return (
        roles.join(fold_fits(spark, folder), ["fold", "ind"], "left")
        .withColumn("target_expected", expected)
        .withColumn("alignment_residual", F.col("target_rate") - expected)
        .drop("slope", "intercept")
    )


def build_labelled(spark, folder):
    return labels.with_labels(scored_pairs(spark, folder), cutoffs(spark, folder), ["fold"], "alignment_residual")


def labelled(spark, folder):
    """The labelled pairs as a stored table, which all later stages read."""
    return B.stored(spark, folder, "labelled-pairs", build_labelled)


_FOLD_VALUES = ", ".join(
    f"('{f.name}', {f.first}, {f.train_last}, {f.eval_first}, {f.eval_last}, {f.fit_last})" for f in FOLDS
)
LABEL_SQL = (
    B.PANEL_SQL
    + f""",
folds(fold, first, train_last, eval_first, eval_last, fit_last) AS (VALUES {_FOLD_VALUES}),
fit_rows AS (SELECT fold, geo, ind, yr, start_rate, employment_growth FROM analytic_panel JOIN folds ON yr <= fit_last WHERE start_rate IS NOT NULL AND employment_growth IS NOT NULL),
fits AS (SELECT fold, ind, regr_slope(start_rate, employment_growth) AS slope, regr_intercept(start_rate, employment_growth) AS intercept FROM fit_rows GROUP BY 1, 2),
residuals AS (SELECT r.*, intercept + slope * employment_growth AS expected_rate, start_rate - (intercept + slope * employment_growth) AS residual FROM fit_rows r JOIN fits USING (fold, ind)),
cuts AS (SELECT fold, count(*) AS train_n, avg(residual) AS residual_mean, stddev_samp(residual) AS residual_sd, quantile_cont(residual, 0.1) AS residual_p10,
         quantile_cont(residual, 0.2) AS residual_p20, quantile_cont(residual, 0.25) AS residual_p25, avg(residual) - stddev_samp(residual) AS residual_minus_1sd FROM residuals GROUP BY 1),
pairs AS (SELECT p.geo, p.ind, p.yr AS predictor_year, t.yr AS target_year, {", ".join("p." + c for c in FEATURES)}, t.start_rate AS target_rate, t.employment_growth AS target_growth
          FROM analytic_panel p JOIN analytic_panel t ON t.geo = p.geo AND t.ind = p.ind AND t.yr = p.yr + {B.HORIZON}),
roles AS (SELECT p.*, fold, CASE WHEN predictor_year BETWEEN first AND train_last THEN 'training' ELSE 'validation' END AS split_role FROM pairs p
          JOIN folds ON predictor_year BETWEEN first AND train_last OR predictor_year BETWEEN eval_first AND eval_last),
scored AS (SELECT r.*, intercept + slope * target_growth AS target_expected, target_rate - (intercept + slope * target_growth) AS alignment_residual FROM roles r LEFT JOIN fits USING (fold, ind)),
labelled AS (SELECT s.*, CAST(alignment_residual <= residual_p10 AS INT) AS gap_p10, CAST(alignment_residual <= residual_p20 AS INT) AS gap_p20,
             CAST(alignment_residual <= residual_p25 AS INT) AS gap_p25, CAST(alignment_residual <= residual_minus_1sd AS INT) AS gap_minus_1sd,
             residual_p20 AS primary_threshold, alignment_residual - residual_p20 AS gap_margin FROM scored s JOIN cuts USING (fold) WHERE alignment_residual IS NOT NULL)"""
)
SQL = B.with_sql(LABEL_SQL).rstrip() + "\n"


@query("exact_pairs", SQL + "SELECT geo, ind, predictor_year, target_year, round(start_rate, 6) AS start_rate, round(target_rate, 6) AS target_rate FROM pairs")
def exact_pairs(spark, folder):
    return B.rounded(
        pairs(spark, folder).select("geo", "ind", "predictor_year", "target_year", "start_rate", "target_rate")
    )


@query(
    "predictor_attach",
    SQL
    + """SELECT geo, ind, predictor_year, target_year, round(employment_growth, 6) AS employment_growth, round(income, 6) AS income FROM pairs WHERE target_year <= 2000""",
)
def predictor_attach(spark, folder):
    """Predictor fields joined many-to-one by predictor year, as a checked join."""
    rows = B.panel_table(spark, folder)
    keys = cal.exact_pairs(rows.filter(f"yr <= {B.DEV_LAST_YEAR}"), B.PANEL, "yr", B.HORIZON)
    predictors = rows.select(*B.PANEL, F.col("yr").alias("predictor_year"), "employment_growth", "income")
    return B.rounded(joins.checked_join(keys, predictors, [*B.PANEL, "predictor_year"], "left", "many_to_one"))


@query(
    "temporal_folds",
    f"""SELECT fold, first, train_last, eval_first, eval_last, fit_last, fold = 'final_holdout' AS holdout, train_pairs, validation_pairs FROM (
        {SQL} SELECT f.fold, CAST(first AS INT) AS first, CAST(train_last AS INT) AS train_last, CAST(eval_first AS INT) AS eval_first, CAST(eval_last AS INT) AS eval_last,
          CAST(fit_last AS INT) AS fit_last, count(*) FILTER (WHERE split_role = 'training') AS train_pairs, count(*) FILTER (WHERE split_role = 'validation') AS validation_pairs
        FROM roles r JOIN folds f USING (fold) GROUP BY ALL)""",
)
def temporal_folds(spark, folder):
    return labels.fold_table(spark, FOLDS).join(labels.fold_counts(pairs(spark, folder), FOLDS), "fold")


@query(
    "residual_thresholds",
    SQL
    + """SELECT fold, train_n, round(residual_mean, 6) + 0.0::DOUBLE AS residual_mean, round(residual_sd, 6) AS residual_sd, round(residual_p10, 6) AS residual_p10, round(residual_p20, 6) AS residual_p20,
         round(residual_p25, 6) AS residual_p25, round(residual_minus_1sd, 6) AS residual_minus_1sd, round(residual_p20, 6) AS primary_threshold FROM cuts""",
)
def residual_thresholds(spark, folder):
    return B.rounded(cutoffs(spark, folder)).withColumn("residual_mean", F.col("residual_mean") + 0.0)


@query(
    "gap_labels",
    SQL
    + """SELECT fold, split_role, geo, ind, predictor_year, target_year, round(alignment_residual, 6) AS alignment_residual, gap_p10, gap_p20, gap_p25, gap_minus_1sd,
         round(gap_margin, 6) AS gap_margin FROM labelled""",
)
def gap_labels(spark, folder):
    columns = ["fold", "split_role", "geo", "ind", "predictor_year", "target_year", "alignment_residual", *labels.LABELS.values(), "gap_margin"]
    return B.rounded(build_labelled(spark, folder).select(*columns))


@query(
    "threshold_changes",
    SQL
    + """, w AS (SELECT fold, residual_p20 AS t, lag(residual_p20) OVER (ORDER BY fold) AS p FROM cuts)
         SELECT fold, round(t, 6) AS primary_threshold, round(abs(t - p), 6) AS abs_change, round(abs(t - p) / abs(p), 6) AS relative_change, coalesce((t < 0) = (p < 0), TRUE) AS direction_stable FROM w""",
)
def threshold_changes(spark, folder):
    return B.rounded(labels.threshold_changes(cutoffs(spark, folder)))


def _prevalence_sql(keys):
    by = "".join(f"{k}, " for k in keys)
    group = "GROUP BY " + ", ".join(keys) if keys else ""
    return " UNION ALL ".join(
        f"""SELECT '{d}' AS threshold_definition, {by}count({c}) AS eligible_n, CAST(sum({c}) AS BIGINT) AS gap_n, count({c}) - CAST(sum({c}) AS BIGINT) AS non_gap_n,
            round(sum({c})::DOUBLE / count({c}), 6) AS gap_prevalence FROM labelled {group}"""
        for d, c in labels.LABELS.items()
    )


@query("label_prevalence", SQL + _prevalence_sql(["fold", "split_role", "target_year"]))
def label_prevalence(spark, folder):
    return B.rounded(labels.prevalence(labelled(spark, folder), ["fold", "split_role", "target_year"]))


@query(
    "label_summary",
    SQL
    + """SELECT ind, count(*) AS eligible_n, CAST(sum(gap_p20) AS BIGINT) AS gap_n, round(avg(primary_threshold), 6) AS mean_threshold, round(avg(gap_p20), 6) AS gap_prevalence,
         round(median(alignment_residual), 6) AS median_residual, round(median(primary_threshold), 6) AS median_threshold, count(*) - CAST(sum(gap_p20) AS BIGINT) AS non_gap_n,
         round(median(alignment_residual) - median(primary_threshold), 6) AS median_margin, count(*) >= 30 AS included FROM labelled WHERE split_role = 'validation' GROUP BY 1""",
)
def label_summary(spark, folder):
    rows = labelled(spark, folder).filter("split_role = 'validation'")
    return B.rounded(labels.label_summary(rows, "ind", "gap_p20", "alignment_residual", "primary_threshold"))


@query(
    "label_contingency",
    SQL
    + """, med AS (SELECT yr, ind, median(start_rate) AS sm, median(employment_growth) AS gm FROM analytic_panel GROUP BY 1, 2),
         m AS (SELECT gap_p20, CAST(target_growth >= gm AND target_rate < sm AS INT) AS mismatch FROM labelled l JOIN med ON med.yr = l.target_year AND med.ind = l.ind WHERE split_role = 'validation'),
         c AS (SELECT mismatch, gap_p20, count(*) AS n FROM m GROUP BY 1, 2)
         SELECT mismatch, gap_p20, n, CASE WHEN gap_p20 = 1 THEN round(n::DOUBLE / sum(CASE WHEN gap_p20 = 1 THEN n ELSE 0 END) OVER (), 6) END AS share_of_second,
           CASE WHEN mismatch = 1 THEN round(n::DOUBLE / sum(CASE WHEN mismatch = 1 THEN n ELSE 0 END) OVER (), 6) END AS share_of_first FROM c""",
)
def label_contingency(spark, folder):
    rows = labelled(spark, folder).filter("split_role = 'validation'")
    cuts = profile.medians(B.panel_table(spark, folder), ["yr", "ind"], {"start_rate": "sm", "employment_growth": "gm"})
    joined = rows.join(cuts.withColumnRenamed("yr", "target_year"), ["target_year", "ind"])
    mismatch = ((F.col("target_growth") >= F.col("gm")) & (F.col("target_rate") < F.col("sm"))).cast("int")
    return B.rounded(labels.contingency(joined.withColumn("mismatch", mismatch), "mismatch", "gap_p20"))


@query(
    "label_rate_by_thirds",
    SQL
    + """, v AS (SELECT *, (rank() OVER (ORDER BY target_expected) + (count(*) OVER (PARTITION BY target_expected) - 1) / 2.0::DOUBLE) / count(*) OVER () AS pr FROM labelled WHERE split_role = 'validation'),
         g AS (SELECT *, CASE WHEN pr <= 1 / 3.0::DOUBLE THEN 'low' WHEN pr <= 2 / 3.0::DOUBLE THEN 'middle' ELSE 'high' END AS expected_group FROM v)
         SELECT expected_group, count(*) AS eligible_n, CAST(sum(gap_p20) AS BIGINT) AS gap_n, round(min(target_expected), 6) AS value_min, round(max(target_expected), 6) AS value_max, round(avg(gap_p20), 6) AS gap_prevalence FROM g GROUP BY 1""",
)
def label_rate_by_thirds(spark, folder):
    rows = freeze(labelled(spark, folder).filter("split_role = 'validation'"))
    grouped = profile.percent_rank_thirds(rows, "target_expected", "expected_group")
    return B.rounded(labels.rate_by_group(grouped, "expected_group", "gap_p20", "target_expected"))


@query(
    "outcome_by_label",
    SQL
    + """, v AS (SELECT *, median(target_rate) OVER () AS m FROM labelled WHERE split_role = 'validation')
         SELECT gap_p20, count(*) AS eligible_n, round(avg(target_rate), 6) AS mean_value, round(avg(CASE WHEN target_rate > m THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_above_median,
           round(median(target_rate), 6) AS median_value, round(quantile_cont(target_rate, 0.75), 6) AS p75_value FROM v GROUP BY 1""",
)
def outcome_by_label(spark, folder):
    rows = freeze(labelled(spark, folder).filter("split_role = 'validation'").select("gap_p20", "target_rate"))
    return B.rounded(labels.outcome_by_label(rows, "gap_p20", "target_rate"))


def _audit_sql(kind, value, group):
    stats = ", ".join(
        f"count({v}) FILTER (WHERE {t}) AS {v}_{s}_n, round(avg({v}) FILTER (WHERE {t}), 6) AS {v}_{s}_mean"
        for v in ("start_rate", "population")
        for s, t in (("included", "done"), ("excluded", "NOT done"))
    )
    return f"""SELECT '{kind}' AS group_type, {value} AS group_value, count(*) AS exact_pairs, count(*) FILTER (WHERE done) AS complete_pairs, count(*) FILTER (WHERE NOT done) AS excluded_pairs,
        round(avg(CASE WHEN done THEN 1.0::DOUBLE ELSE 0 END), 6) AS inclusion_rate, {stats} FROM marked {group}"""


@query(
    "selection_audit",
    SQL
    + ", marked AS (SELECT *, alignment_residual IS NOT NULL AS done FROM scored WHERE split_role = 'validation') "
    + " UNION ALL ".join(
        [_audit_sql("all", "'all'", ""), _audit_sql("target_year", "CAST(target_year AS VARCHAR)", "GROUP BY target_year"), _audit_sql("category", "ind", "GROUP BY ind")]
    ),
)
def selection_audit(spark, folder):
    rows = scored_pairs(spark, folder).filter("split_role = 'validation'").withColumn(
        "done", F.col("alignment_residual").isNotNull()
    )
    return B.rounded(
        labels.selection_audit(rows, "done", {"target_year": "target_year", "category": "ind"}, ["start_rate", "population"])
    )


@query(
    "negative_expected",
    SQL
    + """, s AS (SELECT *, target_expected - 18 AS e FROM labelled)
         SELECT fold, split_role, count(*) AS n, count(*) FILTER (WHERE e < 0) AS negative_n, coalesce(CAST(sum(gap_p20) FILTER (WHERE e < 0) AS BIGINT), 0) AS negative_gap_n,
           round(avg(CASE WHEN e < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS negative_share FROM s GROUP BY 1, 2""",
)
def negative_expected(spark, folder):
    """Shifted expectation, so that negative values occur."""
    rows = labelled(spark, folder).withColumn("e", F.col("target_expected") - 18)
    return B.rounded(labels.negative_expected(rows, ["fold", "split_role"], "e", "gap_p20"))


@query(
    "label_flips",
    SQL
    + """, alt AS (SELECT fold, quantile_cont(residual, 0.2) AS a FROM residuals WHERE expected_rate >= 19 GROUP BY 1)
         SELECT fold, count(*) AS validation_n, count(*) FILTER (WHERE (alignment_residual <= residual_p20) <> (alignment_residual <= a)) AS label_flips, round(max(a - residual_p20), 6) AS threshold_change
         FROM labelled JOIN cuts USING (fold) JOIN alt USING (fold) WHERE split_role = 'validation' GROUP BY 1""",
)
def label_flips(spark, folder):
    residuals = training_residuals(spark, folder)
    alternative = labels.thresholds(residuals.filter("expected_rate >= 19"), ["fold"])
    rows = scored_pairs(spark, folder).filter("split_role = 'validation'")
    return B.rounded(labels.label_flips(rows, "alignment_residual", labels.thresholds(residuals, ["fold"]), alternative, ["fold"]))


@query(
    "extreme_residuals",
    SQL
    + " UNION ALL ".join(
        f"""SELECT * FROM (SELECT fold, geo, ind, target_year, round(alignment_residual, 6) AS alignment_residual, '{t}' AS extreme_tail FROM labelled WHERE split_role = 'validation'
            ORDER BY labelled.alignment_residual {w}, fold, geo, ind, target_year LIMIT 15)"""
        for t, w in (("most_negative", "ASC"), ("most_positive", "DESC"))
    ),
)
def extreme_residuals(spark, folder):
    rows = labelled(spark, folder).filter("split_role = 'validation'").select("fold", "geo", "ind", "target_year", "alignment_residual")
    return B.rounded(labels.extreme_rows(rows, "alignment_residual", ["fold", "geo", "ind", "target_year"]))


@query(
    "label_transitions",
    SQL
    + """, w AS (SELECT fold, split_role, target_year, gap_p20, lag(target_year) OVER k AS py, lag(gap_p20) OVER k AS pg FROM labelled WINDOW k AS (PARTITION BY fold, geo, ind ORDER BY target_year))
         SELECT fold, CASE WHEN pg = 1 THEN 'gap' ELSE 'non_gap' END || '_to_' || CASE WHEN gap_p20 = 1 THEN 'gap' ELSE 'non_gap' END AS transition, count(*) AS transition_n,
           min(py) AS prior_year_min, min(target_year) AS year_min, max(target_year) AS year_max FROM w WHERE split_role = 'validation' AND target_year - py = 1 GROUP BY 1, 2""",
)
def label_transitions(spark, folder):
    moves = cal.transitions(
        labelled(spark, folder), ["fold", "geo", "ind"], "target_year", "gap_p20", "split_role", "validation"
    )
    return moves.groupBy("fold", "transition").agg(
        F.count(F.lit(1)).alias("transition_n"), F.min("prior_year").alias("prior_year_min"),
        F.min("target_year").alias("year_min"), F.max("target_year").alias("year_max"),
    )


@query(
    "historical_label_attach",
    SQL
    + """SELECT l.geo, l.ind, l.target_year AS yr, gap_p20, round(alignment_residual, 6) AS alignment_residual,
         CASE WHEN alignment_residual >= 0 THEN 'at_or_above_expected' WHEN alignment_residual < 0 THEN 'below_expected' END AS direction, round(target_rate, 6) AS start_rate
         FROM labelled l WHERE split_role = 'validation' AND fold <> 'final_holdout'""",
)
def historical_label_attach(spark, folder):
    """Validation labels put back on the panel; observed values must agree to 1e-9."""
    from cellwise.functions.measures import residual_direction

    rows = labelled(spark, folder).filter("split_role = 'validation' AND fold <> 'final_holdout'").select(
        "geo", "ind", F.col("target_year").alias("yr"), "gap_p20", "alignment_residual", "target_rate"
    )
    attached = joins.attach_agreeing(rows, B.panel_table(spark, folder), B.KEY, {"target_rate": "start_rate"})
    return B.rounded(
        attached.select(*B.KEY, "gap_p20", "alignment_residual", residual_direction(F.col("alignment_residual")).alias("direction"), "start_rate")
    )


@query(
    "frozen_label_cutoff",
    SQL
    + """SELECT count(*) AS residual_n, round(quantile_cont(residual, 0.2), 6) AS cutoff, TRUE AS reproduced FROM residuals WHERE fold = 'final_holdout'""",
)
def frozen_label_cutoff(spark, folder):
    """Write the development cutoff before any holdout scan; a second run must reproduce it."""
    residuals = training_residuals(spark, folder).filter("fold = 'final_holdout'")
    path = scratch_path(spark, "cutoff")
    labels.thresholds(residuals, ["fold"]).select(
        F.col("train_n").alias("residual_n"), F.col("residual_p20").alias("cutoff")
    ).write.parquet(path)
    again = labels.frozen_cutoff(residuals, "residual")
    stored = spark.read.parquet(path)
    return stored.select("residual_n", F.round("cutoff", 6).alias("cutoff"), (F.abs(F.col("cutoff") - again) <= 1e-12).alias("reproduced"))


@query(
    "pair_contracts",
    SQL
    + """SELECT name, 'pairs' AS dataset, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (
         SELECT 'exact_horizon' AS name, count(*) FILTER (WHERE target_year <> predictor_year + 3) AS n FROM labelled
         UNION ALL SELECT 'development_boundary', count(*) FILTER (WHERE target_year > 2000) FROM labelled
         UNION ALL SELECT 'binary_label', count(*) FILTER (WHERE gap_p20 NOT IN (0, 1)) FROM labelled
         UNION ALL SELECT 'unique_key', CAST(0 AS BIGINT))""",
)
def pair_contracts(spark, folder):
    rows = labelled(spark, folder)
    keys = ["fold", "split_role", "geo", "ind", "predictor_year", "target_year"]
    return K.pair_checks(rows, keys, B.HORIZON, B.DEV_LAST_YEAR, "gap_p20", "pairs")


@query(
    "exclude_years",
    SQL + "SELECT target_year, count(*) AS n FROM labelled WHERE predictor_year NOT IN (1997) AND target_year NOT IN (1997, 1999) GROUP BY 1",
)
def exclude_years(spark, folder):
    """Pairs that touch none of the excluded calendar years on either side."""
    kept = labelled(spark, folder).filter(~F.col("predictor_year").isin(1997, 1999) & ~F.col("target_year").isin(1997, 1999))
    return kept.groupBy("target_year").agg(F.count(F.lit(1)).alias("n"))


# --- eligibility of the exact pairs

TARGET_FIELDS = ["target_rate", "target_growth"]
PREDICTOR_FIELDS = ["start_rate", "start_rate_lag1", "employment_growth", "income"]
_ELIGIBLE = """, c AS (SELECT *, target_rate IS NOT NULL AND target_growth IS NOT NULL AS te,
  start_rate IS NOT NULL AND start_rate_lag1 IS NOT NULL AND employment_growth IS NOT NULL AND income IS NOT NULL AS pc FROM pairs)"""


def classified(spark, folder):
    return E.eligibility(pairs(spark, folder), TARGET_FIELDS, PREDICTOR_FIELDS)


@query(
    "complete_case_flags",
    SQL + _ELIGIBLE + " SELECT te AS target_eligible, pc AS predictor_complete, te AND pc AS eligible, count(*) AS n FROM c GROUP BY 1, 2, 3",
)
def complete_case_flags(spark, folder):
    return classified(spark, folder).groupBy("target_eligible", "predictor_complete", "eligible").agg(F.count(F.lit(1)).alias("n"))


def _reason(scope, reason, test):
    return f"SELECT '{scope}' AS scope, '{reason}' AS reason, count(*) FILTER (WHERE {test}) AS n FROM c"


@query(
    "exclusion_reasons",
    SQL
    + _ELIGIBLE
    + ", r AS ("
    + " UNION ALL ".join(
        [
            _reason("broad", "target inputs incomplete", "NOT te"), _reason("broad", "predictor inputs incomplete", "NOT pc"),
            _reason("broad", "both incomplete", "NOT te AND NOT pc"),
            *[_reason("target_field", f"missing {f}", f"NOT (te AND pc) AND {f} IS NULL") for f in TARGET_FIELDS],
            *[_reason("predictor_field", f"missing {f}", f"NOT (te AND pc) AND {f} IS NULL") for f in PREDICTOR_FIELDS],
        ]
    )
    + """) SELECT scope, reason, n AS excluded_n, round(n::DOUBLE / (SELECT count(*) FROM c), 6) AS pct_all,
         round(n::DOUBLE / nullif((SELECT count(*) FROM c WHERE NOT (te AND pc)), 0), 6) AS pct_excluded FROM r""",
)
def exclusion_reasons(spark, folder):
    return B.rounded(E.exclusion_reasons(classified(spark, folder), TARGET_FIELDS, PREDICTOR_FIELDS))


@query(
    "exclusion_rates",
    SQL
    + _ELIGIBLE
    + """ SELECT ind, count(*) AS candidates_n, count(*) FILTER (WHERE NOT (te AND pc)) AS excluded_n, round(count(*) FILTER (WHERE NOT (te AND pc))::DOUBLE / count(*), 6) AS exclusion_rate,
          round(count(*) FILTER (WHERE NOT (te AND pc))::DOUBLE / nullif(sum(count(*) FILTER (WHERE NOT (te AND pc))) OVER (), 0), 6) AS share_of_excluded FROM c GROUP BY 1""",
)
def exclusion_rates(spark, folder):
    return B.rounded(E.exclusion_rate(classified(spark, folder), "ind"))


@query(
    "eligibility_summary",
    SQL
    + _ELIGIBLE
    + """ SELECT count(*) AS candidate_pairs, count(*) FILTER (WHERE te) AS label_eligible_pairs, count(*) FILTER (WHERE te AND pc) AS eligible_pairs, count(*) FILTER (WHERE NOT (te AND pc)) AS excluded_pairs,
          round(avg(CASE WHEN te AND pc THEN 0.0::DOUBLE ELSE 1 END), 6) AS exclusion_share, count(DISTINCT CASE WHEN te AND pc THEN geo END) AS place_n,
          count(DISTINCT CASE WHEN te AND pc THEN ind END) AS category_n, round(avg(CASE WHEN te AND pc THEN target_rate END), 6) AS prevalence FROM c""",
)
def eligibility_summary(spark, folder):
    return B.rounded(E.eligibility_summary(classified(spark, folder), "geo", "ind", "target_rate"))


@query(
    "mean_differences",
    SQL
    + _ELIGIBLE
    + """, l AS (SELECT te AND pc AS i, variable, v FROM (SELECT te, pc, population, income FROM c) UNPIVOT INCLUDE NULLS (v FOR variable IN (population, income))),
          s AS (SELECT variable, count(v) FILTER (WHERE i) AS included_n, count(v) FILTER (WHERE NOT i) AS excluded_n, avg(v) FILTER (WHERE i) AS a, avg(v) FILTER (WHERE NOT i) AS b,
                var_samp(v) FILTER (WHERE i) AS va, var_samp(v) FILTER (WHERE NOT i) AS vb FROM l GROUP BY 1)
          SELECT variable, included_n, excluded_n, round(a, 6) AS included_mean, round(b, 6) AS excluded_mean, CASE WHEN included_n >= 2 AND excluded_n >= 2 AND va + vb > 0 THEN round((a - b) / sqrt((va + vb) / 2), 6) END AS smd FROM s""",
)
def mean_differences(spark, folder):
    return B.rounded(E.mean_differences(classified(spark, folder), "eligible", ["population", "income"]))


@query(
    "holdout_candidates",
    SQL
    + """SELECT p.geo, p.ind, p.yr AS predictor_year, t.yr AS target_year, round(p.start_rate, 6) AS start_rate, round(t.start_rate, 6) AS target_start_rate, round(t.income, 6) AS target_income
         FROM analytic_panel p JOIN analytic_panel t ON t.geo = p.geo AND t.ind = p.ind AND t.yr = p.yr + 3 WHERE p.yr = 1998""",
)
def holdout_candidates(spark, folder):
    """Predictor rows with all wanted target-year fields under a prefix."""
    rows = B.panel_table(spark, folder).filter("yr IN (1998, 2001)")
    found = cal.exact_pairs(
        rows, B.PANEL, "yr", B.HORIZON, ["start_rate"], {"start_rate": "target_start_rate", "income": "target_income"}
    )
    return B.rounded(found)
