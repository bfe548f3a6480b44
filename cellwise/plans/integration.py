"""Panel integration, merge audits, coverage and cross-source agreement."""

from pyspark.sql import functions as F

from cellwise.operators import joins, panel
from cellwise.operators import calendar as cal
from cellwise.operators.profile import collapse
from cellwise.operators.relations import agreement
from cellwise.plans import base as B
from cellwise.plans.registry import query
from cellwise.session import table

PANEL = B.with_sql(B.PANEL_SQL)
_MEASURES = ", ".join(f"round({c}, 6) AS {c}" for c in B.PANEL_MEASURES if c != "starts")
_NOTES = """concat_ws(';', CASE WHEN NOT controls_matched THEN 'acs_unmatched' END,
  CASE WHEN controls_matched AND controls_incomplete THEN 'acs_missing_controls' END,
  CASE WHEN NOT support_matched THEN 'cbp_unmatched' END, CASE WHEN starts_suppressed THEN 'bds_suppression' END,
  CASE WHEN activity_suppressed THEN 'qcew_suppression' END, CASE WHEN support_suppressed THEN 'cbp_suppression' END,
  CASE WHEN NOT support_complete THEN 'cbp_incomplete_county_coverage' END)"""


@query(
    "integrated_panel",
    PANEL
    + f"""SELECT geo, ind, yr, geo_name, starts, {_MEASURES}, {", ".join(B.PANEL_FLAGS)}, support_complete,
          {_NOTES} AS quality_notes FROM analytic_panel""",
)
def integrated_panel(spark, folder):
    return B.rounded(B.analytic_panel(spark, folder).withColumn("quality_notes", panel.quality_notes()))


@query(
    "panel_exists_flags",
    B.with_sql(B.SUPPORT_SQL, B.START_LAYER_SQL)
    + """SELECT b.geo, b.ind, b.yr,
         EXISTS (SELECT 1 FROM support_stage s WHERE s.geo = b.geo AND s.ind = b.ind AND s.yr = b.yr) AS staged_group,
         EXISTS (SELECT 1 FROM support_stage s WHERE s.geo = b.geo AND s.ind = b.ind AND s.yr = b.yr AND s.members_suppressed > 0) AS staged_suppression
         FROM start_layer b""",
)
def panel_exists_flags(spark, folder):
    """Both existence questions answered by one join to the staged groups."""
    staged = B.support_stage(spark, folder).select(*B.KEY, (F.col("members_suppressed") > 0).alias("_s"))
    joined = joins.checked_join(B.start_layer(spark, folder).select(*B.KEY), staged, B.KEY, "left", "one_to_one")
    return joined.select(
        *B.KEY, F.col("_s").isNotNull().alias("staged_group"), F.coalesce("_s", F.lit(False)).alias("staged_suppression")
    )


@query(
    "numerator_backbone_join",
    """WITH num AS (SELECT c_nationkey AS geo, c_mktsegment AS ind, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS urgent
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1, 2, 3),
       den AS (SELECT c_nationkey AS geo, c_mktsegment AS ind, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS backbone
          FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1, 2, 3)
       SELECT num.geo, num.ind, num.yr, urgent, backbone, round(100 * urgent::DOUBLE / backbone, 6) AS rate
       FROM num LEFT JOIN den ON den.geo = num.geo AND den.ind = num.ind AND den.yr = num.yr""",
)
def numerator_backbone_join(spark, folder):
    from cellwise.functions.measures import percent_of

    orders = B.orders_by_cell(spark, folder).filter("o_orderstatus = 'F'")
    cell = ["geo", "ind", B.year_of("o_orderdate")]
    num = orders.filter("o_orderpriority = '1-URGENT'").groupBy(*cell).agg(F.count(F.lit(1)).alias("urgent"))
    den = orders.filter("o_orderpriority <> '5-LOW'").groupBy(*cell).agg(F.count(F.lit(1)).alias("backbone"))
    joined = joins.checked_join(num, den, B.KEY, "left", "one_to_one")
    return B.rounded(joined.withColumn("rate", percent_of(F.col("urgent"), F.col("backbone"))))


@query(
    "audit_join_one_to_one",
    B.with_sql(B.START_LAYER_SQL)
    + """SELECT count(*) AS joined_rows, count(*) AS stage_rows, count(*) FILTER (WHERE start_rate IS NULL) AS missing_rate,
         TRUE AS one_to_one FROM start_layer""",
)
def audit_join_one_to_one(spark, folder):
    stage = B.start_layer(spark, folder)
    raw = B.start_counts(spark, folder).select(*B.KEY, F.col("backbone").alias("raw_backbone"))
    joined = joins.checked_join(stage, raw, B.KEY, "left", "one_to_one")
    rows = stage.select(F.count(F.lit(1)).alias("n")).scalar()
    return joined.agg(
        F.count(F.lit(1)).alias("joined_rows"),
        F.max(rows).alias("stage_rows"),
        F.count_if(F.col("start_rate").isNull()).alias("missing_rate"),
    ).withColumn("one_to_one", F.col("joined_rows") == F.col("stage_rows"))


@query(
    "merge_audit",
    B.with_sql(B.START_LAYER_SQL, B.SUPPORT_SQL, B.CONTROL_SQL)
    + """, core AS (SELECT geo, ind, yr FROM start_layer WHERE NOT is_suppressed),
         done AS (SELECT geo, ind, yr FROM support_stage WHERE is_complete),
         a AS (SELECT 'core with support' AS step, count(c.geo) AS left_rows, count(d.geo) AS right_rows,
                 count(*) FILTER (WHERE c.geo IS NOT NULL AND d.geo IS NOT NULL) AS matched
               FROM core c FULL JOIN done d ON c.geo = d.geo AND c.ind = d.ind AND c.yr = d.yr
               UNION ALL
               SELECT 'core with controls', count(c.geo), count(d.geo), count(*) FILTER (WHERE c.geo IS NOT NULL AND d.geo IS NOT NULL)
               FROM (SELECT DISTINCT geo, yr FROM core) c FULL JOIN (SELECT geo, yr FROM control_layer WHERE open_pct IS NOT NULL) d ON c.geo = d.geo AND c.yr = d.yr)
         SELECT *, left_rows - matched AS left_only, right_rows - matched AS right_only,
           CASE WHEN left_rows > 0 THEN round_even(100 * matched::DOUBLE / left_rows, 4) ELSE 0.0::DOUBLE END AS left_match_pct,
           CASE WHEN right_rows > 0 THEN round_even(100 * matched::DOUBLE / right_rows, 4) ELSE 0.0::DOUBLE END AS right_match_pct FROM a""",
)
def merge_audit(spark, folder):
    core = B.start_layer(spark, folder).filter("NOT is_suppressed")
    support = B.support_stage(spark, folder).filter("is_complete")
    controls = B.control_layer(spark, folder).filter("open_pct IS NOT NULL")
    return joins.merge_audit("core with support", core, support, B.KEY).unionByName(
        joins.merge_audit("core with controls", core, controls, ["geo", "yr"])
    )


@query(
    "key_set_operations",
    B.with_sql(B.START_LAYER_SQL, B.SUPPORT_SQL)
    + """, c AS (SELECT geo, ind, yr FROM start_layer WHERE NOT is_suppressed), d AS (SELECT geo, ind, yr FROM support_stage WHERE is_complete)
         SELECT 'both' AS side, geo, ind, yr FROM (SELECT * FROM c INTERSECT SELECT * FROM d)
         UNION ALL SELECT 'left_only', geo, ind, yr FROM (SELECT * FROM c EXCEPT SELECT * FROM d)
         UNION ALL SELECT 'right_only', geo, ind, yr FROM (SELECT * FROM d EXCEPT SELECT * FROM c)""",
)
def key_set_operations(spark, folder):
    core = B.start_layer(spark, folder).filter("NOT is_suppressed").select(*B.KEY)
    support = B.support_stage(spark, folder).filter("is_complete").select(*B.KEY)
    parts = {"both": core.intersect(support), "left_only": core.subtract(support), "right_only": support.subtract(core)}
    result = None
    for side, df in parts.items():
        df = df.withColumn("side", F.lit(side))
        result = df if result is None else result.unionByName(df)
    return result


@query(
    "panel_shape",
    PANEL
    + """, p AS (SELECT geo, ind, count(*) AS n FROM analytic_panel WHERE NOT any_suppression GROUP BY 1, 2), y AS (SELECT count(DISTINCT yr) AS k FROM analytic_panel WHERE NOT any_suppression)
         SELECT CAST(sum(n) AS BIGINT) AS row_count, count(DISTINCT geo) AS geo_count, count(DISTINCT ind) AS ind_count, (SELECT k FROM y) AS year_count,
           (SELECT min(yr) FROM analytic_panel WHERE NOT any_suppression) AS first_year, (SELECT max(yr) FROM analytic_panel WHERE NOT any_suppression) AS last_year,
           count(*) AS panel_count, count(*) FILTER (WHERE n = (SELECT k FROM y)) AS balanced_panels,
           count(*) FILTER (WHERE n <> (SELECT k FROM y)) AS unbalanced_panels, round_even(sum(n)::DOUBLE / count(*), 4) AS rows_per_panel FROM p""",
)
def panel_shape(spark, folder):
    rows = B.panel_table(spark, folder).filter("NOT any_suppression")
    return panel.shape(rows, B.PANEL, "yr")


def _present():
    return {
        "with_rate": F.col("start_rate").isNotNull(),
        "with_growth": F.col("employment_growth").isNotNull(),
        "with_controls": F.col("controls_matched") & ~F.col("controls_incomplete"),
        "with_support": F.col("support_matched"),
    }


_PRESENT_SQL = """count(*) FILTER (WHERE start_rate IS NOT NULL) AS with_rate, count(*) FILTER (WHERE employment_growth IS NOT NULL) AS with_growth,
  count(*) FILTER (WHERE controls_matched AND NOT controls_incomplete) AS with_controls, count(*) FILTER (WHERE support_matched) AS with_support"""


@query(
    "coverage_by_year",
    PANEL + f"SELECT yr, count(*) AS row_count, count(DISTINCT geo) AS geo_count, count(DISTINCT ind) AS ind_count, {_PRESENT_SQL} FROM analytic_panel GROUP BY 1",
)
def coverage_by_year(spark, folder):
    return panel.coverage(B.panel_table(spark, folder), ["yr"], ["geo", "ind"], _present())


@query(
    "coverage_by_category",
    PANEL + f"SELECT ind, count(*) AS row_count, count(DISTINCT geo) AS geo_count, count(DISTINCT yr) AS yr_count, {_PRESENT_SQL} FROM analytic_panel GROUP BY 1",
)
def coverage_by_category(spark, folder):
    return panel.coverage(B.panel_table(spark, folder), ["ind"], ["geo", "yr"], _present())


@query(
    "lowest_coverage_places",
    PANEL
    + """SELECT geo, geo_name, count(*) AS row_count, count(DISTINCT ind) AS ind_count, count(DISTINCT yr) AS yr_count
         FROM analytic_panel WHERE NOT any_suppression GROUP BY 1, 2 ORDER BY row_count, geo LIMIT 10""",
)
def lowest_coverage_places(spark, folder):
    rows = B.panel_table(spark, folder).filter("NOT any_suppression")
    return panel.lowest_coverage(panel.coverage(rows, ["geo", "geo_name"], ["ind", "yr"], {}), "geo")


_MISSING = ["start_rate", "start_rate_lag1", "start_rate_lag3", "employment_growth", "pay_growth_lag1", "open_pct", "support_employment"]


def _missing_sql(by: str) -> str:
    group = f"{by}, " if by else ""
    tail = " GROUP BY 1" if by else ""
    return " UNION ALL ".join(
        f"""SELECT {group}'{c}' AS variable, count(*) AS total_count, count({c}) AS non_missing_count, count(*) - count({c}) AS missing_count,
            round(100.0::DOUBLE * (count(*) - count({c})) / count(*), 6) AS missing_pct FROM analytic_panel{tail}"""
        for c in _MISSING
    )


@query("missing_by_column", PANEL + _missing_sql(""))
def missing_by_column(spark, folder):
    return B.rounded(panel.missing_by_column(B.panel_table(spark, folder), _MISSING))


@query("missing_by_year", PANEL + _missing_sql("yr"))
def missing_by_year(spark, folder):
    return B.rounded(panel.missing_by_column(B.panel_table(spark, folder), _MISSING, ["yr"]))


@query(
    "flag_totals",
    PANEL + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f}) AS row_count FROM analytic_panel" for f in B.PANEL_FLAGS),
)
def flag_totals(spark, folder):
    return panel.flag_totals(B.panel_table(spark, folder), B.PANEL_FLAGS)


@query(
    "control_growth_and_lags",
    B.with_sql(B.CONTROL_PANEL_SQL)
    + f"""SELECT geo, yr, {", ".join(f"round({c}, 6) AS {c}" for c in [*B.CONTROLS, "population_growth", *[f"{x}_lag1" for x in [*B.CONTROLS[1:], "population_growth"]]])}
          FROM control_panel""",
)
def control_growth_and_lags(spark, folder):
    return B.rounded(B.control_panel(spark, folder))


_AGREE = """pairs AS (
  SELECT 'all' AS dimension, 'all' AS dimension_value, employment AS a, support_employment * 1.5::DOUBLE AS b FROM analytic_panel
  UNION ALL SELECT 'year', CAST(yr AS VARCHAR), employment, support_employment * 1.5::DOUBLE FROM analytic_panel
  UNION ALL SELECT 'category', ind, employment, support_employment * 1.5::DOUBLE FROM analytic_panel
  UNION ALL SELECT 'place', CAST(geo AS VARCHAR), employment, support_employment * 1.5::DOUBLE FROM analytic_panel)"""
_AGREE_CORR = "CASE WHEN count(*) >= 2 AND min(a) < max(a) AND min(b) < max(b) THEN round(corr(b, a), 6) END"


@query(
    "cross_source_agreement",
    PANEL.rstrip() + f""", {_AGREE}
       SELECT dimension, dimension_value, count(*) AS matched, count(CASE WHEN a <> 0 THEN 1 END) AS nonzero_base,
         {_AGREE_CORR} AS correlation, round(median(CASE WHEN a <> 0 THEN b / a END), 6) AS median_ratio,
         round(median(CASE WHEN a <> 0 THEN abs(b - a) / abs(a) END), 6) AS median_apd,
         count(*) FILTER (WHERE a <> 0 AND abs(b - a) / abs(a) > 1) AS over_100pct
       FROM pairs WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2""",
)
def cross_source_agreement(spark, folder):
    return B.rounded(
        agreement(
            B.panel_table(spark, folder), {"year": "yr", "category": "ind", "place": "geo"},
            "employment", "support_employment", 1.5,
        )
    )


@query(
    "top_disagreement_places",
    PANEL.rstrip() + """, d AS (SELECT CAST(geo AS VARCHAR) AS geo, count(*) AS matched,
          count(*) FILTER (WHERE employment <> 0 AND abs(support_employment * 1.5::DOUBLE - employment) / abs(employment) > 1) AS over_100pct
        FROM analytic_panel WHERE employment IS NOT NULL AND support_employment IS NOT NULL GROUP BY 1)
       SELECT geo, over_100pct, matched FROM d WHERE over_100pct > 0 ORDER BY over_100pct DESC, geo LIMIT 10""",
)
def top_disagreement_places(spark, folder):
    summary = agreement(B.panel_table(spark, folder), {"place": "geo"}, "employment", "support_employment", 1.5)
    ranked = summary.filter("dimension = 'place' AND over_100pct > 0").select(
        F.col("dimension_value").alias("geo"), "over_100pct", "matched"
    )
    return ranked.orderBy(F.col("over_100pct").desc(), "geo").limit(10)


@query(
    "coverage_reconciliation",
    B.with_sql(B.START_LAYER_SQL, B.SUPPORT_SQL)
    + """, a AS (SELECT geo, count(*) AS n, count(DISTINCT yr) AS years FROM start_layer WHERE NOT is_suppressed GROUP BY 1),
         b AS (SELECT geo, count(*) AS n, count(DISTINCT yr) AS years FROM support_stage WHERE is_complete GROUP BY 1)
         SELECT count(*) FILTER (WHERE a.geo IS NOT NULL AND b.geo IS NOT NULL) AS both, count(*) FILTER (WHERE b.geo IS NULL) AS left_only,
           count(*) FILTER (WHERE a.geo IS NULL) AS right_only, count(*) FILTER (WHERE a.geo IS NOT NULL AND b.geo IS NOT NULL AND a.n <> b.n) AS n_differs,
           count(*) FILTER (WHERE a.geo IS NOT NULL AND b.geo IS NOT NULL AND a.years <> b.years) AS years_differs FROM a FULL JOIN b ON a.geo = b.geo""",
)
def coverage_reconciliation(spark, folder):
    def by_place(df):
        return df.groupBy("geo").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("yr").alias("years"))

    left = by_place(B.start_layer(spark, folder).filter("NOT is_suppressed"))
    right = by_place(B.support_stage(spark, folder).filter("is_complete"))
    return joins.reconciliation(joins.compare_sides(left, right, ["geo"], ["n", "years"]), ["n", "years"])


@query(
    "name_lookup",
    B.with_sql(B.GEO_SQL) + "SELECT c_custkey, geo_name, geo_type FROM customer JOIN geo_dim ON geo = c_nationkey",
)
def name_lookup(spark, folder):
    """Names by a many-to-one lookup that fails on an unmatched row."""
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("geo"))
    named = joins.checked_join(customers, B.geo_dim(spark, folder), ["geo"], "left", "many_to_one")
    return joins.require_match(named, ["geo_name"], "names").drop("geo")


@query(
    "distinct_name_pairs",
    "SELECT DISTINCT n_nationkey, n_name FROM nation JOIN customer ON c_nationkey = n_nationkey",
)
def distinct_name_pairs(spark, folder):
    """Distinct (code, name) pairs, each code once."""
    customers = table(spark, folder, "customer").select(F.col("c_nationkey").alias("n_nationkey"))
    names = table(spark, folder, "nation").select("n_nationkey", "n_name")
    pairs = customers.join(names, "n_nationkey").dropDuplicates(["n_nationkey", "n_name"])
    return joins.unique_on(pairs, ["n_nationkey"], "names")


@query(
    "collapsed_controls",
    B.with_sql(B.PANEL_SQL) + "SELECT DISTINCT geo, yr, round(population, 6) AS population, round(income, 6) AS income, round(open_pct, 6) AS open_pct FROM analytic_panel",
)
def collapsed_controls(spark, folder):
    return B.rounded(collapse(B.panel_table(spark, folder), ["geo", "yr"], ["population", "income", "open_pct"]))


@query(
    "prior_denominators",
    B.with_sql(B.ACTIVITY_LAYER_SQL)
    + """SELECT a.geo, a.ind, a.yr, p.employment AS prior_employment, round(p.payroll, 2) AS prior_payroll
         FROM activity_layer a LEFT JOIN activity_layer p ON p.geo = a.geo AND p.ind = a.ind AND p.yr = a.yr - 1""",
)
def prior_denominators(spark, folder):
    columns = {**cal.prior_value("employment", "prior_employment"), **cal.prior_value("payroll", "prior_payroll")}
    rows = cal.add(B.activity_layer(spark, folder), B.PANEL, "yr", columns)
    return B.rounded(rows.select(*B.KEY, "prior_employment", "prior_payroll"), 2)


@query(
    "union_of_layers",
    B.with_sql(B.START_LAYER_SQL, B.SUPPORT_SQL)
    + """SELECT layer, count(*) AS row_count, count(start_rate) AS with_rate, count(employment) AS with_employment FROM (
           SELECT 'starts' AS layer, start_rate, CAST(NULL AS DOUBLE) AS employment FROM start_layer
           UNION ALL SELECT 'support', NULL, employment FROM support_stage) GROUP BY 1""",
)
def union_of_layers(spark, folder):
    starts = B.start_layer(spark, folder).withColumn("layer", F.lit("starts"))
    support = B.support_stage(spark, folder).withColumn("layer", F.lit("support"))
    both = starts.unionByName(support, allowMissingColumns=True)
    return both.groupBy("layer").agg(
        F.count(F.lit(1)).alias("row_count"), F.count("start_rate").alias("with_rate"), F.count("employment").alias("with_employment")
    )
