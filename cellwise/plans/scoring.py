"""Ranked-prediction evaluation over order lines, documents and labelled pairs."""

from pyspark.sql import functions as F

from cellwise.operators import bootstrap, checks, ordered, profile, ranking, sampling
from cellwise.operators import evaluation as E
from cellwise.plans import base as B
from cellwise.plans import labels as L
from cellwise.plans.registry import query
from cellwise.session import freeze, table

# --- inputs


def line_scores(spark, folder):
    """Every order line: returned or not, a continuous score and a heavily tied one."""
    return table(spark, folder, "lineitem").select(
        "l_linestatus", "l_orderkey", "l_linenumber",
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 200000).alias("score"),
        F.col("l_discount").alias("tied_score"),
    )


LINES = """lines AS (SELECT l_linestatus, l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
  l_extendedprice / 200000 AS score, l_discount AS tied_score FROM lineitem)"""


def document_scores(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    marks = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"), "toxic")
    return marks.join(docs, "doc_id").select(
        "doc_id", "lang", "source", "label", "toxic",
        (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("score"),
        (F.floor(F.col("n_chars") / 2000) / 20).alias("tied_score"),
    )


DOCS = """docs AS (SELECT d.doc_id, lang, source, quality AS label, toxic, n_chars::DOUBLE / (n_chars + 2000) AS score, floor(n_chars::DOUBLE / 2000) / 20 AS tied_score
  FROM labels JOIN documents d USING (doc_id))"""


def validation_scores(spark, folder):
    """Labelled validation pairs with two scores from predictor-year rates."""
    rows = L.labelled(spark, folder).filter("split_role = 'validation' AND start_rate IS NOT NULL")
    return rows.select(
        "fold", "geo", "ind", "predictor_year", "target_year", "population", "gap_p20", "gap_p25",
        (1 - F.col("start_rate") / 100).alias("rate_score"),
        (1 - F.floor(F.col("start_rate") / 5) * 5 / 100).alias("coarse_score"),
    )


VALID = """valid AS (SELECT fold, geo, ind, predictor_year, target_year, population, gap_p20, gap_p25, 1 - start_rate / 100 AS rate_score,
  1 - floor(start_rate / 5) * 5 / 100 AS coarse_score FROM labelled WHERE split_role = 'validation' AND start_rate IS NOT NULL)"""
VALID_SQL = L.SQL.rstrip() + ", " + VALID


def metrics_sql(source, keys, score, cuts=("top10", "top20", "top25")):
    """Metric CTEs of any keyed (label, score) source; the SQL twin of ``performance``."""
    by = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    using = f"USING ({', '.join(keys)})" if keys else "ON TRUE"
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    share = {"top10": 0.10, "top20": 0.20, "top25": 0.25}
    lifts = ""
    for c in cuts:
        k = f"greatest(1, CAST(ceil(tn * {share[c]}::DOUBLE) AS BIGINT))"
        hit = f"max(CASE WHEN cn - n < {k} AND {k} <= cn THEN (cp - pos + ({k} - (cn - n))::DOUBLE / n * pos) / {k} END)"
        lifts += f", max({k}) AS {c}_n, round({hit}, 6) AS {c}_prevalence, round({hit} / (max(tp)::DOUBLE / max(tn)), 6) AS {c}_lift"
    return f"""cells AS (SELECT {by}{score} AS s, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM {source} GROUP BY ALL),
      run AS (SELECT *, CAST(sum(n) OVER ({part}ORDER BY s DESC) AS BIGINT) AS cn, CAST(sum(pos) OVER ({part}ORDER BY s DESC) AS BIGINT) AS cp,
              CAST(sum(n) OVER ({part}) AS BIGINT) AS tn, CAST(sum(pos) OVER ({part}) AS BIGINT) AS tp FROM cells),
      result AS (SELECT {by}max(tn) AS n, max(tp) AS positives, round(max(tp)::DOUBLE / max(tn), 6) AS prevalence,
        round(sum(pos * cp::DOUBLE / cn) / max(tp), 6) AS average_precision,
        round(sum(pos * ((tn - tp) - (cn - cp) + (n - pos) / 2.0::DOUBLE)) / (max(tp) * (max(tn) - max(tp))), 6) AS roc_auc,
        round(sum(pos * (s - 1) ** 2 + (n - pos) * s ** 2) / sum(n), 6) AS brier{lifts} FROM run {group})"""


# --- ranking metrics


@query("ranking_metrics", f"WITH {LINES}, {metrics_sql('lines', ['l_linestatus'], 'score')} SELECT * FROM result")
def ranking_metrics(spark, folder):
    return B.rounded(ranking.performance(line_scores(spark, folder), ["l_linestatus"], "label", "score"))


@query("ranking_metrics_ties", f"WITH {LINES}, {metrics_sql('lines', [], 'tied_score')} SELECT * FROM result")
def ranking_metrics_ties(spark, folder):
    """Eleven distinct scores over all order lines."""
    return B.rounded(ranking.performance(line_scores(spark, folder), [], "label", "tied_score"))


@query(
    "ranking_metrics_constant",
    f"WITH {LINES}, fixed AS (SELECT label, 0.33::DOUBLE AS score FROM lines), {metrics_sql('fixed', [], 'score')} SELECT * FROM result",
)
def ranking_metrics_constant(spark, folder):
    """A constant score: precision equals prevalence and AUC is one half."""
    rows = line_scores(spark, folder).withColumn("score", F.lit(0.33))
    return B.rounded(ranking.performance(rows, [], "label", "score"))


@query(
    "model_performance_rows",
    f"""{VALID_SQL}, long AS (SELECT 'rate' AS model, fold, gap_p20 AS label, rate_score AS score FROM valid UNION ALL SELECT 'coarse', fold, gap_p20, coarse_score FROM valid),
        {metrics_sql('long', ['model', 'fold'], 'score')} SELECT * FROM result""",
)
def model_performance_rows(spark, folder):
    long = model_rows(spark, folder)
    return B.rounded(ranking.performance(long, ["model", "fold"], "label", "score"))


def model_rows(spark, folder):
    rows = freeze(validation_scores(spark, folder))
    cells = F.array(
        *[F.struct(F.lit(m).alias("model"), F.col(f"{m}_score").alias("score")) for m in ("rate", "coarse")]
    )
    return rows.select("fold", "geo", "ind", "predictor_year", "target_year", F.col("gap_p20").alias("label"), F.inline(cells))


@query(
    "ranking_curve",
    f"""WITH {LINES}, {metrics_sql('lines', ['l_linestatus'], 'tied_score')}
        SELECT l_linestatus, s AS score, round(cp::DOUBLE / tp, 6) AS recall, round(cp::DOUBLE / cn, 6) AS precision, round((cn - cp)::DOUBLE / (tn - tp), 6) AS false_positive_rate FROM run
        UNION ALL SELECT DISTINCT l_linestatus, NULL, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE FROM lines""",
)
def ranking_curve(spark, folder):
    return B.rounded(ranking.ranking_curve(line_scores(spark, folder), ["l_linestatus"], "label", "tied_score"))


def _confusion_sql(source, keys, score, threshold):
    by = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    return f"""k AS (SELECT {by}count(*) FILTER (WHERE {score} >= {threshold} AND label = 1) AS tp, count(*) FILTER (WHERE {score} >= {threshold} AND label = 0) AS fp,
        count(*) FILTER (WHERE {score} < {threshold} AND label = 0) AS tn, count(*) FILTER (WHERE {score} < {threshold} AND label = 1) AS fn FROM {source} {group}),
      k2 AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) ELSE 0 END AS sp FROM k)
      SELECT {by}tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, round(r, 6) AS recall, round(p, 6) AS precision,
        round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round((r + sp) / 2, 6) AS balanced_accuracy FROM k2"""


@query("threshold_metrics", f"WITH {LINES}, {_confusion_sql('lines', ['l_linestatus'], 'tied_score', '0.05::DOUBLE')}")
def threshold_metrics(spark, folder):
    return B.rounded(ranking.confusion(line_scores(spark, folder), ["l_linestatus"], "label", "tied_score", F.lit(0.05)))


@query(
    "fold_threshold_metrics",
    f"""{VALID_SQL}, prev AS (SELECT fold, 1 - avg(gap_p20) AS t FROM labelled WHERE split_role = 'training' GROUP BY 1),
        v AS (SELECT gap_p20 AS label, rate_score, t FROM valid JOIN prev USING (fold)), {_confusion_sql('v', [], 'rate_score', 't')}""",
)
def fold_threshold_metrics(spark, folder):
    """Pooled rows, each judged at the threshold of its own fold."""
    prevalence = L.labelled(spark, folder).filter("split_role = 'training'").groupBy("fold").agg(
        (1 - F.avg("gap_p20")).alias("fold_threshold")
    )
    rows = validation_scores(spark, folder).join(F.broadcast(prevalence), "fold").withColumn("label", F.col("gap_p20"))
    return B.rounded(ranking.confusion(rows, [], "label", "rate_score", F.col("fold_threshold")))


def _edges_sql(source, score, keys):
    by = "".join(f"{k}, " for k in keys)
    group = f"GROUP BY {', '.join(keys)}" if keys else ""
    using = f"JOIN e USING ({', '.join(keys)})" if keys else "CROSS JOIN e"
    return f"""e AS (SELECT {by}list_distinct(quantile_cont({score}, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edges FROM {source} {group}),
      m AS (SELECT {by}label, {score} AS s, greatest(1, len([x for x in edges if x < {score}])) AS bin FROM {source} {using})
      SELECT {by}CAST(bin AS INT) AS risk_bin, count(*) AS n, round(avg(s), 6) AS mean_score, round(avg(label), 6) AS observed_rate FROM m GROUP BY ALL"""


@query("calibration_bins", f"WITH {DOCS}, {_edges_sql('docs', 'score', [])}")
def calibration_bins(spark, folder):
    return B.rounded(ranking.calibration(document_scores(spark, folder), [], "label", "score"))


@query("calibration_bins_ties", f"WITH {LINES}, {_edges_sql('lines', 'tied_score', ['l_linestatus'])}")
def calibration_bins_ties(spark, folder):
    """Repeated edges merge: eleven discounts cannot fill ten even bins per group."""
    return B.rounded(ranking.calibration(line_scores(spark, folder), ["l_linestatus"], "label", "tied_score"))


@query(
    "equal_count_bins",
    f"""WITH {LINES}, r AS (SELECT *, row_number() OVER (ORDER BY tied_score, l_orderkey, l_linenumber) AS k, count(*) OVER () AS t FROM lines)
        SELECT CAST(least(10, floor((k - 1) * 10 / t::DOUBLE) + 1) AS INT) AS risk_bin, count(*) AS n, round(avg(tied_score), 6) AS mean_score, round(avg(label), 6) AS observed_rate FROM r GROUP BY 1""",
)
def equal_count_bins(spark, folder):
    rows = line_scores(spark, folder)
    return B.rounded(ranking.equal_count_bins(rows, [], "label", "tied_score", ["l_orderkey", "l_linenumber"]))


@query(
    "guarded_group_metrics",
    f"""WITH {DOCS}, {metrics_sql('docs', ['source'], 'score', ('top10',))}
        SELECT source, n, positives, prevalence, positives >= 18 AND positives < n AS sufficient, top10_n, top10_prevalence, top10_lift,
          {", ".join(f"CASE WHEN positives >= 18 AND positives < n THEN {m} END AS {m}" for m in ("average_precision", "roc_auc", "brier"))} FROM result""",
)
def guarded_group_metrics(spark, folder):
    return B.rounded(ranking.guarded_performance(document_scores(spark, folder), ["source"], "label", "score", 18))


# --- benchmarks and decisions


@query(
    "group_prevalence_benchmark",
    f"""{VALID_SQL}, r AS (SELECT ind, avg(gap_p20) AS rate FROM labelled WHERE split_role = 'training' AND fold = 'final_holdout' AND ind <> 'BUILDING' GROUP BY 1),
        s AS (SELECT gap_p20 AS label, coalesce(rate, 0.2::DOUBLE) AS score FROM valid LEFT JOIN r USING (ind) WHERE fold = 'final_holdout'), {metrics_sql('s', [], 'score', ('top10',))} SELECT * FROM result""",
)
def group_prevalence_benchmark(spark, folder):
    """Development category rates scored on the holdout; one unseen category falls back."""
    rows = L.labelled(spark, folder).filter("fold = 'final_holdout'")
    rates = E.prevalence_scores(rows.filter("split_role = 'training' AND ind <> 'BUILDING'"), "ind", "gap_p20")
    holdout = validation_scores(spark, folder).filter("fold = 'final_holdout'").withColumn("label", F.col("gap_p20"))
    scored = E.score_by_group(holdout, rates, "ind", "score", fallback=0.2)
    return B.rounded(ranking.performance(scored, [], "label", "score", {"top10": 0.1}))


@query(
    "development_prevalence",
    L.SQL
    + """SELECT ind, count(*) AS development_n, CAST(sum(gap_p20) AS BIGINT) AS development_gap_n, round(avg(gap_p20), 6) AS development_prevalence FROM labelled
         WHERE fold = 'final_holdout' AND split_role = 'training' GROUP BY 1""",
)
def development_prevalence(spark, folder):
    rows = L.labelled(spark, folder).filter("fold = 'final_holdout' AND split_role = 'training'")
    return B.rounded(E.prevalence_scores(rows, "ind", "gap_p20"))


_RANKED = "r AS (SELECT *, row_number() OVER (ORDER BY tied_score DESC, l_orderkey, l_linenumber) AS k, count(*) OVER () AS t FROM lines)"
FRACTIONS = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)


@query(
    "top_fraction_selection",
    f"WITH {LINES}, {_RANKED} SELECT l_orderkey, l_linenumber, tied_score, k AS selection_rank FROM r WHERE k <= ceil(t * 0.1::DOUBLE)",
)
def top_fraction_selection(spark, folder):
    """Ceiling-sized workload over all lines; a tenth of them share each score."""
    ranked = ranking.ranked_rows(line_scores(spark, folder), "tied_score", ["l_orderkey", "l_linenumber"])
    return ranked.filter(ranking.selected(0.1)).select("l_orderkey", "l_linenumber", "tied_score", "selection_rank")


def _rule(name, test):
    return f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {test}) AS f, count(*) FILTER (WHERE {test} AND label = 1) AS h, min(tied_score) FILTER (WHERE {test}) AS c, count(*) AS t, CAST(sum(label) AS BIGINT) AS p FROM r"


_RULES = [_rule(f"top_{round(x * 100)}%", f"k <= ceil(t * {x}::DOUBLE)") for x in FRACTIONS] + [
    _rule("threshold", "tied_score >= 0.08::DOUBLE"),
    _rule("next_10%", "k > ceil(t * 0.1::DOUBLE) AND k <= ceil(t * 0.2::DOUBLE)"),
]


@query(
    "decision_rules",
    f"""WITH {LINES}, {_RANKED}, d AS ({" UNION ALL ".join(_RULES)}), d2 AS (SELECT *, h::DOUBLE / f AS pr, h::DOUBLE / p AS rc FROM d)
        SELECT rule, f AS flagged_n, h AS true_positive_n, f - h AS false_positive_n, p - h AS false_negative_n, round(pr, 6) AS precision, round(rc, 6) AS recall, round(2 * pr * rc / (pr + rc), 6) AS f1,
          round(pr / (p::DOUBLE / t), 6) AS lift, round((f - h)::DOUBLE / h, 6) AS false_positives_per_true_positive, round(f::DOUBLE / t, 6) AS selection_fraction, round(c, 6) AS score_cutoff FROM d2""",
)
def decision_rules(spark, folder):
    """Six workloads, one threshold and a monitoring tier in one pass over ranked rows."""
    ranked = ranking.ranked_rows(line_scores(spark, folder), "tied_score", ["l_orderkey", "l_linenumber"])
    rules = {f"top_{round(x * 100)}%": ranking.selected(x) for x in FRACTIONS}
    rules["threshold"] = F.col("tied_score") >= 0.08
    rules["next_10%"] = ~ranking.selected(0.1) & ranking.selected(0.2)
    return B.rounded(ranking.decision_metrics(ranked, rules, "label", "tied_score"))


@query(
    "flag_concentration",
    f"""WITH {DOCS}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS t FROM docs),
        c AS (SELECT source, count(*) AS rows_n, count(*) FILTER (WHERE k <= ceil(t * 0.2::DOUBLE)) AS flagged_n, count(*) FILTER (WHERE k <= ceil(t * 0.2::DOUBLE) AND label = 1) AS flagged_gap_n FROM r GROUP BY 1),
        s AS (SELECT *, flagged_n::DOUBLE / sum(flagged_n) OVER () AS sf, rows_n::DOUBLE / sum(rows_n) OVER () AS sr FROM c)
        SELECT source, rows_n, flagged_n, flagged_gap_n, round(sf, 6) AS share_of_flagged, round(sr, 6) AS share_of_rows, round(flagged_n::DOUBLE / rows_n, 6) AS flag_rate,
          round(sf / sr, 6) AS representation_ratio, CASE WHEN flagged_n > 0 THEN round(flagged_gap_n::DOUBLE / flagged_n, 6) END AS precision FROM s""",
)
def flag_concentration(spark, folder):
    ranked = ranking.ranked_rows(document_scores(spark, folder), "score", ["doc_id"])
    return B.rounded(E.concentration(ranked.withColumn("flagged", ranking.selected(0.2)), "source", "flagged", "label"))


@query(
    "direct_standardisation",
    """WITH a AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem WHERE year(l_shipdate) <= 1998 GROUP BY 1, 2),
         b AS (SELECT l_returnflag, l_linenumber, avg(CASE WHEN l_discount >= 0.08::DOUBLE THEN 1 ELSE 0 END) AS r FROM lineitem WHERE year(l_shipdate) > 1998 GROUP BY 1, 2)
       SELECT round(sum(n * r) / sum(n), 6) AS standardized_prevalence, count(*) AS strata_n FROM a JOIN b USING (l_returnflag, l_linenumber)""",
)
def direct_standardisation(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", "l_linenumber", (F.col("l_discount") >= 0.08).cast("int").alias("label"), F.year("l_shipdate").alias("yr")
    )
    strata = ["l_returnflag", "l_linenumber"]
    return B.rounded(E.standardized_prevalence(rows.filter("yr <= 1998"), rows.filter("yr > 1998"), strata, "label"))


@query(
    "period_drift",
    L.SQL
    + """SELECT target_year, count(*) AS n, round(avg(gap_p20), 6) AS gap_prevalence, round(avg(target_rate), 6) AS observed_mean, round(avg(target_expected), 6) AS expected_mean, round(avg(alignment_residual), 6) AS residual_mean,
         round(stddev_samp(alignment_residual), 6) AS residual_sd, round(avg(CASE WHEN alignment_residual <= -5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_below_cutoff, round(median(target_rate), 6) AS observed_median,
         round(median(target_expected), 6) AS expected_median, round(quantile_cont(alignment_residual, 0.1), 6) AS residual_p10, round(quantile_cont(alignment_residual, 0.2), 6) AS residual_p20,
         round(quantile_cont(alignment_residual, 0.25), 6) AS residual_p25, round(median(alignment_residual), 6) AS residual_median FROM labelled WHERE split_role = 'validation' GROUP BY 1""",
)
def period_drift(spark, folder):
    rows = freeze(L.labelled(spark, folder).filter("split_role = 'validation'"))
    return B.rounded(
        E.period_summary(rows, "target_year", "gap_p20", "target_rate", "target_expected", "alignment_residual", -5.0)
    )


@query(
    "label_agreement",
    L.SQL
    + """, c AS (SELECT fold, count(*)::DOUBLE AS n, count(*) FILTER (WHERE gap_p20 = 1 AND gap_minus_1sd = 1) AS b, count(*) FILTER (WHERE gap_p20 = 1 OR gap_minus_1sd = 1) AS u,
            count(*) FILTER (WHERE gap_p20 = gap_minus_1sd) AS s, CAST(sum(gap_p20) AS BIGINT) AS x, CAST(sum(gap_minus_1sd) AS BIGINT) AS y FROM labelled WHERE split_role = 'validation' GROUP BY 1),
         e AS (SELECT *, x / n * (y / n) + (1 - x / n) * (1 - y / n) AS ch FROM c)
         SELECT fold, CAST(n AS BIGINT) AS n, round(s / n, 6) AS agreement, round(CASE WHEN u > 0 THEN b::DOUBLE / u ELSE 1 END, 6) AS positive_jaccard, CASE WHEN ch < 1 THEN round((s / n - ch) / (1 - ch), 6) END AS cohen_kappa,
           x AS first_positive_n, y AS second_positive_n FROM e""",
)
def label_agreement(spark, folder):
    rows = L.labelled(spark, folder).filter("split_role = 'validation'")
    return B.rounded(E.label_agreement(rows, ["fold"], "gap_p20", "gap_minus_1sd"))


_REGRESSION = """round(avg(abs(r)), 6) AS mae, round(sqrt(avg(r * r)), 6) AS rmse, round(avg(r), 6) + 0.0::DOUBLE AS mean_residual, round(stddev_samp(r), 6) AS residual_sd,
  round(quantile_cont(r, 0.05), 6) AS residual_p05, round(median(r), 6) AS median_residual, round(quantile_cont(r, 0.95), 6) AS residual_p95"""


@query(
    "regression_error_metrics",
    L.SQL
    + f""", v AS (SELECT fold, target_rate AS y, target_expected AS e, alignment_residual AS r FROM labelled WHERE split_role = 'validation')
         SELECT fold, count(*) AS n, round(1 - sum(r * r) / (var_pop(y) * count(*)), 6) AS r_squared, count(*) FILTER (WHERE e < 0) AS negative_expected_n, {_REGRESSION} FROM v GROUP BY 1""",
)
def regression_error_metrics(spark, folder):
    rows = L.labelled(spark, folder).filter("split_role = 'validation'")
    result = B.rounded(E.regression_metrics(rows, ["fold"], "target_rate", "target_expected"))
    return result.withColumn("mean_residual", F.col("mean_residual") + 0.0)


@query(
    "regression_metrics_training_mean",
    L.SQL
    + f""", m AS (SELECT avg(start_rate) AS c FROM residuals WHERE fold = 'final_holdout'),
         v AS (SELECT target_rate AS y, target_expected AS e, alignment_residual AS r FROM labelled WHERE split_role = 'validation' AND fold = 'final_holdout')
         SELECT count(*) AS n, round(1 - sum(r * r) / sum((y - c) ** 2), 6) AS r_squared, count(*) FILTER (WHERE e < 0) AS negative_expected_n, {_REGRESSION} FROM v, m""",
)
def regression_metrics_training_mean(spark, folder):
    """R squared around the training mean, not the evaluation mean."""
    mean = L.training_residuals(spark, folder).filter("fold = 'final_holdout'").select(F.avg("start_rate").alias("m")).scalar()
    rows = L.labelled(spark, folder).filter("split_role = 'validation' AND fold = 'final_holdout'")
    return B.rounded(E.regression_metrics(rows, [], "target_rate", "target_expected", mean))


@query(
    "coefficient_stability",
    L.SQL
    + """SELECT ind, count(*) AS fold_n, round(avg(slope), 6) AS mean, round(stddev_samp(slope), 6) AS sd, round(min(slope), 6) AS min, round(max(slope), 6) AS max,
         count(DISTINCT sign(slope)) = 1 AS sign_consistent FROM fits GROUP BY 1""",
)
def coefficient_stability(spark, folder):
    return B.rounded(E.coefficient_stability(L.fold_fits(spark, folder), ["ind"], "slope"))


@query(
    "model_coverage",
    f"""{VALID_SQL} SELECT n_nationkey AS geo, count(v.geo) AS prediction_rows, count(v.geo) > 0 AS modeling_eligible FROM nation LEFT JOIN valid v ON v.geo = n_nationkey GROUP BY 1""",
)
def model_coverage(spark, folder):
    places = table(spark, folder, "nation").select(F.col("n_nationkey").alias("geo"))
    return E.model_coverage(places, validation_scores(spark, folder), "geo")


@query(
    "robustness_scorecard",
    f"""{VALID_SQL}, long AS (SELECT 'alternative_label' AS check_family, 'gap_p25' AS variant, gap_p25 AS label, rate_score AS score FROM valid
          UNION ALL SELECT 'year_exclusion', 'without_1999', gap_p20, rate_score FROM valid WHERE target_year <> 1999
          UNION ALL SELECT 'primary', 'gap_p20', gap_p20, rate_score FROM valid), {metrics_sql('long', ['check_family', 'variant'], 'score', ('top10',))}
        SELECT check_family, variant, n, average_precision, roc_auc, top10_lift FROM result""",
)
def robustness_scorecard(spark, folder):
    rows = freeze(validation_scores(spark, folder))

    def check(df, label, variant):
        df = df.withColumns({"label": F.col(label), "variant": F.lit(variant)})
        result = ranking.performance(df, ["variant"], "label", "rate_score", {"top10": 0.1})
        return result.select("variant", "n", "average_precision", "roc_auc", "top10_lift")

    return B.rounded(
        E.scorecard(
            {
                "primary": check(rows, "gap_p20", "gap_p20"),
                "alternative_label": check(rows, "gap_p25", "gap_p25"),
                "year_exclusion": check(rows.filter("target_year <> 1999"), "gap_p20", "without_1999"),
            }
        )
    )


@query(
    "fold_stability",
    f"""{VALID_SQL}, long AS (SELECT 'rate' AS model, fold, gap_p20 AS label, rate_score AS score FROM valid UNION ALL SELECT 'coarse', fold, gap_p20, coarse_score FROM valid),
        {metrics_sql('long', ['model', 'fold'], 'score', ())}, w AS (SELECT fold, max(average_precision) FILTER (WHERE model = 'rate') AS rate, max(average_precision) FILTER (WHERE model = 'coarse') AS coarse FROM result GROUP BY 1)
        SELECT fold, rate, coarse, round(rate - coarse, 5) AS difference, rate > coarse AS higher_wins FROM w""",
)
def fold_stability(spark, folder):
    metrics = B.rounded(ranking.performance(model_rows(spark, folder), ["model", "fold"], "label", "score", {}))
    result = E.fold_stability(metrics, "fold", "model", "average_precision", "rate", "coarse")
    return result.withColumn("difference", F.round("difference", 5))


@query(
    "size_group_metrics",
    f"""{VALID_SQL}, pm AS (SELECT geo, median(population) AS m FROM labelled WHERE split_role = 'training' AND fold = 'final_holdout' GROUP BY 1), q AS (SELECT quantile_cont(m, 1.0::DOUBLE / 3) AS a, quantile_cont(m, 2.0::DOUBLE / 3) AS b FROM pm),
        g AS (SELECT gap_p20 AS label, rate_score AS score, CASE WHEN population IS NULL THEN 'unclassified_missing_population' WHEN population <= a THEN 'small' WHEN population <= b THEN 'middle' ELSE 'large' END AS size_group FROM valid, q),
        {metrics_sql('g', ['size_group'], 'score', ('top10',))} SELECT * FROM result""",
)
def size_group_metrics(spark, folder):
    training = L.labelled(spark, folder).filter("split_role = 'training' AND fold = 'final_holdout'").select("geo", "population")
    grouped = E.size_groups(training, validation_scores(spark, folder), "geo", "population")
    rows = grouped.withColumn("label", F.col("gap_p20"))
    return B.rounded(ranking.performance(rows, ["size_group"], "label", "rate_score", {"top10": 0.1}))


@query(
    "training_cut_thirds",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 1.0::DOUBLE / 3) AS a, quantile_cont(o_totalprice, 2.0::DOUBLE / 3) AS b FROM orders WHERE year(o_orderdate) <= 1998)
       SELECT CASE WHEN o_totalprice <= a THEN 'lower_third' WHEN o_totalprice <= b THEN 'middle_third' ELSE 'upper_third' END AS third, count(*) AS n, round(min(o_totalprice), 2) AS low, round(max(o_totalprice), 2) AS high
       FROM orders, q WHERE year(o_orderdate) > 1998 GROUP BY 1""",
)
def training_cut_thirds(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice", F.year("o_orderdate").alias("yr"))
    grouped = profile.cutpoint_thirds(orders.filter("yr <= 1998"), orders.filter("yr > 1998"), "o_totalprice", "third")
    return grouped.groupBy("third").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("o_totalprice"), 2).alias("low"), F.round(F.max("o_totalprice"), 2).alias("high")
    )


@query(
    "winsorized_totals",
    """WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders WHERE year(o_orderdate) <= 1998)
       SELECT CAST(year(o_orderdate) AS INT) AS yr, round(min(least(greatest(o_totalprice, a), b)), 6) AS low, round(max(least(greatest(o_totalprice, a), b)), 6) AS high,
         round(avg(least(greatest(o_totalprice, a), b)), 4) AS mean_clipped FROM orders, q GROUP BY 1""",
)
def winsorized_totals(spark, folder):
    """Clip both samples at quantiles of the training years only."""
    from cellwise.operators.modeling import winsorize

    orders = table(spark, folder, "orders").select("o_totalprice", B.year_of("o_orderdate"))
    clipped = winsorize(orders.filter("yr <= 1998"), orders, "o_totalprice", "clipped")
    return clipped.groupBy("yr").agg(
        F.round(F.min("clipped"), 6).alias("low"), F.round(F.max("clipped"), 6).alias("high"), F.round(F.avg("clipped"), 4).alias("mean_clipped")
    )


# --- order, ranks, samples


@query(
    "average_ranks",
    """SELECT l_returnflag, l_discount, count(*) AS n, min(r) AS rank, max(t) AS total_n FROM (SELECT l_returnflag, l_discount, count(*) OVER (PARTITION BY l_returnflag) AS t,
         rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS r FROM lineitem) GROUP BY 1, 2""",
)
def average_ranks(spark, folder):
    return ordered.average_ranks(table(spark, folder, "lineitem").select("l_returnflag", "l_discount"), ["l_returnflag"], "l_discount")


@query(
    "global_row_numbers",
    "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS place, count(*) OVER () AS place_of FROM lineitem",
)
def global_row_numbers(spark, folder):
    """Exact positions of all lines in one global order, without a single-task window."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    order = [F.col("l_discount").desc(), F.col("l_orderkey").asc(), F.col("l_linenumber").asc()]
    return ordered.row_numbers(rows, [], order, "place").drop("l_discount")


@query(
    "top_risk_table",
    f"WITH {LINES} SELECT l_orderkey, l_linenumber, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY lines.score DESC, l_orderkey, l_linenumber) AS INT) AS display_rank FROM lines ORDER BY lines.score DESC, l_orderkey, l_linenumber LIMIT 25",
)
def top_risk_table(spark, folder):
    rows = line_scores(spark, folder).select("l_orderkey", "l_linenumber", "score")
    return B.rounded(ranking.top_table(rows, "score", ["l_orderkey", "l_linenumber"], 25))


@query(
    "top_counts",
    "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10",
)
def top_counts(spark, folder):
    """Ten largest counts, code ascending on ties."""
    counts = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), F.col("o_custkey").asc()).limit(10)


@query(
    "absolute_effect_order",
    L.SQL + "SELECT fold, ind, round(slope, 6) AS slope, CAST(row_number() OVER (ORDER BY abs(slope) DESC) AS INT) AS position FROM fits",
)
def absolute_effect_order(spark, folder):
    from pyspark.sql import Window

    fits = L.fold_fits(spark, folder).select("fold", "ind", "slope")
    return B.rounded(fits.withColumn("position", F.row_number().over(Window.orderBy(F.abs("slope").desc()))))


@query(
    "nulls_last_order",
    B.with_sql(B.START_PANEL_SQL)
    + """SELECT geo, ind, yr, round(start_rate_lag1, 6) AS start_rate_lag1 FROM start_panel ORDER BY start_panel.start_rate_lag1 NULLS LAST, geo, ind, yr""",
)
def nulls_last_order(spark, folder):
    rows = B.start_panel(spark, folder).select(*B.KEY, "start_rate_lag1")
    return B.rounded(rows.orderBy(F.col("start_rate_lag1").asc_nulls_last(), *B.KEY))


@query(
    "seeded_sample",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('754|' || o_orderkey), o_orderkey LIMIT 2500",
)
def seeded_sample(spark, folder):
    return sampling.seeded_sample(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 2500, 754)


@query(
    "group_hash_split",
    """SELECT o_custkey, CAST(('0x' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 10000 AS INT) AS hash_bucket,
       CASE WHEN ('0x' || substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS role FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def group_hash_split(spark, folder):
    return sampling.group_split(table(spark, folder, "orders"), "o_custkey")


@query(
    "unseen_group_metrics",
    f"""WITH {DOCS}, t AS (SELECT *, ('0x' || substr(sha256(source), 1, 8))::BIGINT % 10000 < 4000 AS unseen FROM docs), tested AS (SELECT label, score FROM t WHERE unseen),
        {metrics_sql('tested', [], 'score', ('top10',))} SELECT * FROM result""",
)
def unseen_group_metrics(spark, folder):
    rows = sampling.with_group_role(document_scores(spark, folder), "source", 0.4)
    return B.rounded(ranking.performance(rows.filter("role = 'test'"), [], "label", "score", {"top10": 0.1}))


@query(
    "scoring_input_contracts",
    f"""WITH {DOCS}, n AS (SELECT 'binary_label' AS name, count(*) FILTER (WHERE label NOT IN (0, 1)) AS v FROM docs UNION ALL SELECT 'probability_score', count(*) FILTER (WHERE score < 0 OR score > 1) FROM docs
          UNION ALL SELECT 'probability_tied_score', count(*) FILTER (WHERE tied_score < 0 OR tied_score > 1) FROM docs UNION ALL SELECT 'present_doc_id', count(*) FILTER (WHERE doc_id IS NULL) FROM docs
          UNION ALL SELECT 'unique_key', count(*) FROM (SELECT doc_id FROM docs GROUP BY 1 HAVING count(*) > 1))
        SELECT name, 'documents' AS dataset, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(v AS VARCHAR) AS observed, '0' AS expected FROM n
        UNION ALL SELECT 'both_classes', 'documents', CASE WHEN count(DISTINCT label) = 2 THEN 'pass' ELSE 'fail' END, CAST(count(DISTINCT label) AS VARCHAR), '2' FROM docs""",
)
def scoring_input_contracts(spark, folder):
    rows = document_scores(spark, folder)
    return checks.scoring_input_checks(rows, ["doc_id"], "label", ["score", "tied_score"], "documents")


# --- uncertainty


@query("cluster_bootstrap")
def cluster_bootstrap(spark, folder):
    """Whole sources resampled; two scores compared on the same draws."""
    rows = freeze(document_scores(spark, folder))
    replicates = bootstrap.paired_bootstrap(
        rows, "source", "label", {"fine": "score", "coarse": "tied_score"}, ("fine", "coarse"), replications=500
    )
    return B.rounded(freeze(replicates))


@query("cluster_bootstrap_lines")
def cluster_bootstrap_lines(spark, folder):
    """The same over every order line, clustered by supplier, with the summary."""
    rows = table(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b")
    )
    observed = {
        m: ranking.performance(rows, [], "label", c, {}).first()["average_precision"] for m, c in (("discount", "a"), ("tax", "b"))
    }
    observed["discount_minus_tax"] = observed["discount"] - observed["tax"]
    replicates = bootstrap.paired_bootstrap(
        rows, "l_suppkey", "label", {"discount": "a", "tax": "b"}, ("discount", "tax"), replications=200
    )
    return B.rounded(bootstrap.bootstrap_summary(freeze(replicates), observed))


@query(
    "replicate_summary",
    f"""WITH {DOCS}, m AS (SELECT lang, source, avg(score) AS v FROM docs GROUP BY 1, 2)
        SELECT lang, count(v) AS replications, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS se, round(avg(CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_positive,
          round(avg(CASE WHEN v < 0 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_negative, round(median(v), 6) AS median, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM m GROUP BY 1""",
)
def replicate_summary(spark, folder):
    means = document_scores(spark, folder).groupBy("lang", "source").agg(F.avg("score").alias("v"))
    return B.rounded(E.distribution_summary(means, ["lang"], "v"))
