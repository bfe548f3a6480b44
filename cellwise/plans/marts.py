"""Marts, consumer filters and the incremental ingest."""

from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators import checks as K
from cellwise.operators import evaluation as E
from cellwise.operators import joins, marts, ranking
from cellwise.plans import base as B
from cellwise.plans import etl
from cellwise.plans import labels as L
from cellwise.plans import scoring as S
from cellwise.plans.registry import query
from cellwise.session import freeze, scratch_path, table
from cellwise.sources import files, sinks

PANEL = B.with_sql(B.PANEL_SQL).rstrip() + "\n"


@query(
    "filtered_selection",
    PANEL + "SELECT geo, ind, yr, round(start_rate, 6) AS start_rate FROM analytic_panel WHERE geo = 3 AND ind IN ('BUILDING', 'MACHINERY') AND yr = 1999",
)
def filtered_selection(spark, folder):
    rows = marts.apply_filters(
        B.panel_table(spark, folder), place=3, categories=["BUILDING", "MACHINERY"], year=1999, known_years=range(1995, 2002)
    )
    return B.rounded(rows.select(*B.KEY, "start_rate"))


@query(
    "selection_summary",
    PANEL + "SELECT count(*) AS row_count, count(DISTINCT ind) AS category_count, count(*) || ' rows across ' || count(DISTINCT ind) || ' categories' AS summary FROM analytic_panel WHERE yr = 1999 AND rate_available",
)
def selection_summary(spark, folder):
    rows = marts.apply_filters(B.panel_table(spark, folder), year=1999).filter("rate_available")
    return marts.selection_summary(rows, "ind")


@query(
    "export_projection",
    PANEL + "SELECT geo AS place_code, ind AS sector_code, yr AS calendar_year, round(start_rate, 6) AS observed_rate, 'panel' AS dataset, CAST(1 AS INT) AS version FROM analytic_panel",
)
def export_projection(spark, folder):
    renames = {"geo": "place_code", "ind": "sector_code", "yr": "calendar_year", "start_rate": "observed_rate"}
    return B.rounded(sinks.with_constants(B.panel_table(spark, folder), renames, {"dataset": "panel", "version": 1}))


@query(
    "filtered_predictions",
    S.VALID_SQL + " SELECT geo, ind, predictor_year, round(rate_score, 6) AS rate_score FROM valid WHERE fold = 'final_holdout' AND predictor_year = 1998 AND ind IN ('BUILDING', 'FURNITURE')",
)
def filtered_predictions(spark, folder):
    rows = freeze(S.validation_scores(spark, folder))
    kept = marts.filter_predictions(
        rows, "fold", "final_holdout", [f.name for f in L.FOLDS], year=1998, categories=["BUILDING", "FURNITURE"],
        names={"category": "ind", "year": "predictor_year"},
    )
    return B.rounded(kept.select("geo", "ind", "predictor_year", "rate_score"))


@query(
    "prediction_semi_join",
    S.VALID_SQL + " SELECT geo, ind, yr FROM analytic_panel p WHERE EXISTS (SELECT 1 FROM valid v WHERE v.geo = p.geo AND v.ind = p.ind AND v.predictor_year = p.yr)",
)
def prediction_semi_join(spark, folder):
    scored = S.validation_scores(spark, folder).select("geo", "ind", F.col("predictor_year").alias("yr"))
    return marts.with_predictions_only(B.panel_table(spark, folder), scored, B.KEY).select(*B.KEY)


@query(
    "attached_predictions",
    S.VALID_SQL
    + """ SELECT p.geo, p.ind, p.yr, round(rate_score, 6) AS rate_score, CASE WHEN alignment_residual IS NULL THEN 'No expected-rate comparison is available for this row.'
            WHEN gap_p20 = 1 THEN 'The observed rate is far enough below the expected rate to count as a gap.' WHEN alignment_residual < 0 THEN 'The observed rate is below the expected rate, but not a gap.'
            ELSE 'The observed rate is at or above the expected rate; no gap.' END AS reading
          FROM analytic_panel p LEFT JOIN (SELECT geo, ind, predictor_year, rate_score FROM valid) v ON v.geo = p.geo AND v.ind = p.ind AND v.predictor_year = p.yr
          LEFT JOIN (SELECT geo, ind, target_year, alignment_residual, gap_p20 FROM labelled WHERE split_role = 'validation') l ON l.geo = p.geo AND l.ind = p.ind AND l.target_year = p.yr""",
)
def attached_predictions(spark, folder):
    """Scores at the predictor year and residual readings at the target year, both one-to-one."""
    scored = S.validation_scores(spark, folder).select("geo", "ind", F.col("predictor_year").alias("yr"), "rate_score")
    residuals = L.labelled(spark, folder).filter("split_role = 'validation'").select(
        "geo", "ind", F.col("target_year").alias("yr"), "alignment_residual", "gap_p20"
    )
    rows = joins.checked_join(B.panel_table(spark, folder).select(*B.KEY), scored, B.KEY, "left", "one_to_one")
    rows = joins.checked_join(rows, residuals, B.KEY, "left", "many_to_one")
    return B.rounded(rows.select(*B.KEY, "rate_score", M.residual_reading(F.col("alignment_residual"), F.col("gap_p20")).alias("reading")))


@query(
    "reconciled_scores",
    S.VALID_SQL + " SELECT fold, geo, ind, predictor_year, gap_p20 AS actual_gap, round(rate_score, 6) AS rate_score, round(coarse_score, 6) AS coarse_score FROM valid",
)
def reconciled_scores(spark, folder):
    """Two score tables joined full-outer; keys or outcomes that differ fail the query."""
    rows = freeze(S.validation_scores(spark, folder).withColumn("actual_gap", F.col("gap_p20")))
    keys = ["fold", "geo", "ind", "predictor_year"]
    left = rows.select(*keys, "actual_gap", "rate_score")
    right = rows.select(*keys, "actual_gap", "coarse_score")
    return B.rounded(joins.reconciled(left, right, keys, ["actual_gap"], "scores"))


@query(
    "prediction_union",
    S.VALID_SQL + """ SELECT CASE WHEN fold = 'final_holdout' THEN 'final_holdout' ELSE 'development_oof' END AS split, CASE WHEN fold <> 'final_holdout' THEN fold END AS fold,
        geo, ind, predictor_year, gap_p20, round(rate_score, 6) AS rate_score FROM valid""",
)
def prediction_union(spark, folder):
    rows = S.validation_scores(spark, folder).select("fold", "geo", "ind", "predictor_year", "gap_p20", "rate_score")
    return B.rounded(
        marts.union_predictions(
            {
                "development_oof": rows.filter("fold <> 'final_holdout'"),
                "final_holdout": rows.filter("fold = 'final_holdout'").drop("fold"),
            }
        )
    )


_METRICS = {"average_precision": "Average precision", "roc_auc": "ROC AUC", "brier": "Brier score", "top10_lift": "Lift in the top 10 %"}
_MODELS = {"rate": "Rate model"}
_LONG = f"""{S.VALID_SQL}, long AS (SELECT 'rate' AS model, gap_p20 AS label, rate_score AS score FROM valid UNION ALL SELECT 'coarse', gap_p20, coarse_score FROM valid),
  {S.metrics_sql('long', ['model'], 'score')}"""


@query(
    "model_summary_mart",
    _LONG
    + " UNION ALL ".join(
        f""" SELECT model, CASE WHEN model = 'rate' THEN 'Rate model' ELSE model END AS model_label, '{m}' AS metric, '{n}' AS metric_label, CAST({i} AS INT) AS display_order, {m} AS value FROM result"""
        for i, (m, n) in enumerate(_METRICS.items(), start=1)
    ),
)
def model_summary_mart(spark, folder):
    wide = ranking.performance(S.model_rows(spark, folder), ["model"], "label", "score")
    return B.rounded(marts.labelled_long(wide.select("model", *_METRICS), ["model"], _METRICS, _MODELS))


@query(
    "harmonised_names",
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'final_holdout' WHEN 'O' THEN 'development_oof' ELSE o_orderstatus END AS split, count(*) AS n FROM orders GROUP BY 1",
)
def harmonised_names(spark, folder):
    name = marts.harmonised(F.col("o_orderstatus"), {"F": "final_holdout", "O": "development_oof"})
    return table(spark, folder, "orders").groupBy(name.alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_options",
    """SELECT option, value, CAST(row_number() OVER (PARTITION BY option ORDER BY value) AS INT) AS position FROM (
         SELECT DISTINCT 'category' AS option, c_mktsegment AS value FROM customer UNION SELECT DISTINCT 'place', CAST(c_nationkey AS VARCHAR) FROM customer)""",
)
def filter_options(spark, folder):
    return marts.option_lists(table(spark, folder, "customer"), {"category": "c_mktsegment", "place": "c_nationkey"})


@query(
    "source_registry",
    """SELECT 'orders' AS source, 'Customer orders' AS title, CAST(min(year(o_orderdate)) AS INT) AS first_year, CAST(max(year(o_orderdate)) AS INT) AS last_year, count(*) AS row_count FROM orders
       UNION ALL SELECT 'lineitem', 'Shipped lines', CAST(min(year(l_shipdate)) AS INT), CAST(max(year(l_shipdate)) AS INT), count(*) FROM lineitem""",
)
def source_registry(spark, folder):
    return marts.source_registry(
        {
            "orders": (table(spark, folder, "orders").select(B.year_of("o_orderdate")), "yr"),
            "lineitem": (table(spark, folder, "lineitem").select(B.year_of("l_shipdate")), "yr"),
        },
        {"orders": "Customer orders", "lineitem": "Shipped lines"},
    )


@query(
    "binned_medians",
    """WITH e AS (SELECT list_distinct(quantile_cont(l_extendedprice, [i / 20.0 for i in range(0, 21)])) AS edges FROM lineitem),
       b AS (SELECT greatest(1, len([x for x in edges if x < l_extendedprice])) AS bin, l_extendedprice AS x, l_quantity AS y FROM lineitem, e)
       SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(median(x), 6) AS l_extendedprice_median, round(median(y), 6) AS l_quantity_median FROM b GROUP BY 1""".replace(
        "[i / 20.0 for i in range(0, 21)]", "[" + ", ".join(str(i / 20) for i in range(21)) + "]"
    ),
)
def binned_medians(spark, folder):
    return B.rounded(marts.binned_medians(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity"))


@query(
    "risk_concentration_table",
    _LONG
    + " UNION ALL ".join(
        f" SELECT model, prevalence, '{c}' AS cut, CAST(ceil(n * {s}::DOUBLE) AS BIGINT) AS selected_n, {c}_lift AS lift, round({c}_lift * prevalence, 5) AS expected_rate FROM result"
        for c, s in ranking.DEFAULT_CUTS.items()
    ),
)
def risk_concentration_table(spark, folder):
    rows = B.rounded(ranking.performance(S.model_rows(spark, folder), ["model"], "label", "score"))
    result = marts.risk_concentration(rows, ranking.DEFAULT_CUTS)
    return result.withColumn("expected_rate", F.round("expected_rate", 5))


@query(
    "calibration_mart",
    S.VALID_SQL
    + """, r AS (SELECT CASE WHEN fold = 'final_holdout' THEN 'final_holdout' ELSE 'development_oof' END AS split, gap_p20 AS label, rate_score AS s, geo, ind, predictor_year FROM valid),
         k AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY s, geo, ind, predictor_year) AS k, count(*) OVER (PARTITION BY split) AS t FROM r)
         SELECT split, CAST(least(10, floor((k - 1) * 10 / t::DOUBLE) + 1) AS TINYINT) AS risk_bin, CAST(count(*) AS INT) AS n, round(avg(s), 6) AS mean_score, round(avg(label), 6) AS observed_rate FROM k GROUP BY 1, 2""",
)
def calibration_mart(spark, folder):
    """Development and holdout calibration in one typed table."""
    rows = S.validation_scores(spark, folder).withColumn("label", F.col("gap_p20"))
    holdout = F.col("fold") == "final_holdout"
    tagged = rows.withColumn("split", F.when(holdout, "final_holdout").otherwise("development_oof"))
    bins = ranking.equal_count_bins(tagged, ["split"], "label", "rate_score", ["geo", "ind", "predictor_year"])
    types = {"split": "string", "risk_bin": "tinyint", "n": "int", "mean_score": "double", "observed_rate": "double"}
    return B.rounded(sinks.enforce_types(bins, types))


@query(
    "frozen_size_groups",
    """SELECT CASE WHEN c_acctbal IS NULL THEN 'unclassified_missing_population' WHEN c_acctbal <= 2500 THEN 'small' WHEN c_acctbal <= 6000 THEN 'middle' ELSE 'large' END AS size_group,
       count(*) AS n FROM customer GROUP BY 1""",
)
def frozen_size_groups(spark, folder):
    """Groups from committed cutpoints instead of refitted ones."""
    grouped = E.size_groups_frozen(table(spark, folder, "customer"), "c_acctbal", 2500.0, 6000.0)
    return grouped.groupBy("size_group").agg(F.count(F.lit(1)).alias("n"))


@query(
    "consumer_contracts",
    S.VALID_SQL
    + """, n AS (SELECT 'probability_rate_score' AS name, count(*) FILTER (WHERE rate_score < 0 OR rate_score > 1) AS v FROM valid
           UNION ALL SELECT 'exact_horizon', count(*) FILTER (WHERE target_year <> predictor_year + 3) FROM valid UNION ALL SELECT 'known_category', count(*) FILTER (WHERE ind NOT IN (SELECT c_mktsegment FROM customer)) FROM valid
           UNION ALL SELECT 'known_split', count(*) FILTER (WHERE fold NOT IN ('fold_1', 'fold_2', 'final_holdout')) FROM valid UNION ALL SELECT 'year_sequence', CAST(max(predictor_year) - min(predictor_year) + 1 - count(DISTINCT predictor_year) AS BIGINT) FROM valid
           UNION ALL SELECT 'unique_key', CAST(0 AS BIGINT) UNION ALL SELECT 'reconciled_average_precision', CAST(0 AS BIGINT))
         SELECT name, 'predictions' AS dataset, CASE WHEN v = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(v AS VARCHAR) AS observed, '0' AS expected FROM n""",
)
def consumer_contracts(spark, folder):
    """Checks of the prediction mart, with stored metrics recomputed from its rows."""
    path = scratch_path(spark, "predictions")
    sinks.write_table(S.validation_scores(spark, folder), path)
    rows = spark.read.parquet(path)
    categories = table(spark, folder, "customer").select(F.col("c_mktsegment").alias("ind"), F.lit(True).alias("known")).distinct()
    joined = rows.join(categories, "ind", "left")
    conditions = {
        **{"probability_rate_score": K.not_probability(["rate_score"])["probability_rate_score"]},
        "exact_horizon": K.off_horizon("predictor_year", "target_year", B.HORIZON),
        "known_category": F.col("known").isNull(),
        "known_split": ~F.col("fold").isin(*[f.name for f in L.FOLDS]),
    }
    stored_path = scratch_path(spark, "metrics")
    metrics = ranking.performance(rows, ["fold"], "gap_p20", "rate_score")
    sinks.write_table(metrics, stored_path)
    return (
        K.row_checks(joined, conditions, "predictions")
        .unionByName(K.contiguous(rows, "predictor_year", "predictions"))
        .unionByName(K.unique_key(rows, ["geo", "ind", "predictor_year", "target_year"], "predictions"))
        .unionByName(
            K.reconciled_metric(
                spark.read.parquet(stored_path), ranking.performance(rows, ["fold"], "gap_p20", "rate_score"), ["fold"],
                "average_precision", 1e-14, "predictions",
            )
        )
    )


@query(
    "metrics_by_year_mart",
    f"""{S.VALID_SQL}, y AS (SELECT predictor_year, target_year, gap_p20 AS label, rate_score AS score FROM valid), {S.metrics_sql('y', ['predictor_year', 'target_year'], 'score', ('top10',))} SELECT * FROM result""",
)
def metrics_by_year_mart(spark, folder):
    rows = S.validation_scores(spark, folder)
    return B.rounded(ranking.performance(rows, ["predictor_year", "target_year"], "gap_p20", "rate_score", {"top10": 0.1}))


@query(
    "metrics_by_category_mart",
    f"""{S.VALID_SQL}, y AS (SELECT ind, gap_p20 AS label, rate_score AS score FROM valid), {S.metrics_sql('y', ['ind'], 'score', ('top10',))}
        SELECT ind, n, positives, prevalence, average_precision, roc_auc, brier, top10_n, top10_prevalence, top10_lift, CAST(row_number() OVER (ORDER BY average_precision DESC NULLS LAST, ind) AS INT) AS position FROM result""",
)
def metrics_by_category_mart(spark, folder):
    """Category table in display order; one row per category."""
    from pyspark.sql import Window

    rows = S.validation_scores(spark, folder)
    result = B.rounded(ranking.performance(rows, ["ind"], "gap_p20", "rate_score", {"top10": 0.1}))
    order = Window.orderBy(F.col("average_precision").desc_nulls_last(), F.col("ind").asc())
    return result.withColumn("position", F.row_number().over(order))


@query("mart_schema_listing")
def mart_schema_listing(spark, folder):
    return sinks.schema_listing(
        spark, {"panel": B.panel_table(spark, folder), "orders": table(spark, folder, "orders")}
    )


@query(
    "incremental_ingest",
    "SELECT o_orderstatus, count(*) AS rows_stored, count(DISTINCT o_orderkey) AS identities FROM orders GROUP BY 1",
)
def incremental_ingest(spark, folder):
    """Land files twice with overlap; the stream stores every order once."""
    from cellwise.streaming.ingest import source_stream, start_ingest

    landing, target = scratch_path(spark, "landing"), scratch_path(spark, "stored")
    checkpoint = scratch_path(spark, "stream")
    rows = etl.order_text(spark, folder)

    def land(part):
        part.write.mode("append").option("header", True).csv(landing)
        stream = source_stream(spark, landing, etl.ORDER_FIELDS)
        started = start_ingest(stream, target, checkpoint, "orders", ["year", "o_orderkey"], prune="year")
        started.awaitTermination()

    land(rows.filter("o_orderstatus <> 'P'"))
    land(rows.filter("o_orderstatus <> 'O'"))
    stored = spark.read.parquet(target)
    return files.require_columns(stored, etl.ORDER_FIELDS).groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("rows_stored"), F.count_distinct("o_orderkey").alias("identities")
    )
