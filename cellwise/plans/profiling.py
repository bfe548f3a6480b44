"""Profiles, missingness, relationships and contracts of the stored panel."""

from pyspark.sql import functions as F

from cellwise.operators import checks as K
from cellwise.operators import ordered, profile, relations
from cellwise.operators import calendar as cal
from cellwise.plans import base as B
from cellwise.plans.registry import query
from cellwise.session import table

PANEL = B.with_sql(B.PANEL_SQL).rstrip() + "\n"
VARIABLES = ["start_rate", "employment_growth", "pay_growth", "income", "open_pct"]
COARSE = ["population_growth", "income", "open_pct"]


def _unpivot(columns, extra="", where="TRUE"):
    lead = f"{extra}, " if extra else ""
    return " UNION ALL ".join(
        f"SELECT {lead}'{c}' AS variable, CAST({c} AS DOUBLE) AS v FROM analytic_panel WHERE {where}" for c in columns
    )


def _q(p, value="v"):
    return f"round(quantile_cont({value}, {p}), 6)"


_MOMENTS = "CASE WHEN count(v) >= 3 THEN round(coalesce(skewness(v), 0), 6) END AS skewness, CASE WHEN count(v) >= 4 THEN round(coalesce(kurtosis(v), 0), 6) END AS excess_kurtosis"
_COUNTS = "count(v) AS count, count(*) - count(v) AS missing_count"


@query(
    "numeric_summary",
    PANEL
    + f""", long AS ({_unpivot(VARIABLES)})
      SELECT variable, {_COUNTS}, round(100.0::DOUBLE * (count(*) - count(v)) / count(*), 6) AS missing_pct, CAST(0 AS BIGINT) AS nonfinite_count,
        round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, {_MOMENTS},
        {", ".join(f"{_q(p)} AS {n}" for n, p in profile.SUMMARY_QUANTILES.items())} FROM long GROUP BY 1""",
)
def numeric_summary(spark, folder):
    return B.rounded(profile.numeric_summary(B.panel_table(spark, folder), VARIABLES))


@query(
    "line_value_summary",
    """WITH long AS (SELECT l_returnflag, 'price' AS variable, l_extendedprice AS v FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount FROM lineitem)
       SELECT l_returnflag, variable, """
    + ", ".join(f"{_q(p)} AS {n}" for n, p in profile.SUMMARY_QUANTILES.items())
    + " FROM long GROUP BY 1, 2",
)
def line_value_summary(spark, folder):
    """Exact quantiles of whole fact columns per group, distributed over slices."""
    rows = table(spark, folder, "lineitem").select(
        "l_returnflag", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")
    )
    long = profile.to_long(rows, ["l_returnflag"], ["price", "discount"])
    return B.rounded(ordered.quantiles(long, ["l_returnflag", "variable"], "value", profile.SUMMARY_QUANTILES))


RATES = ["start_rate", "open_pct"]


@query(
    "distribution_shape",
    PANEL
    + f""", long AS ({_unpivot(VARIABLES)}),
      s AS (SELECT variable, {_COUNTS}, CASE WHEN count(v) >= 3 THEN coalesce(skewness(v), 0) END AS sk, CASE WHEN count(v) >= 4 THEN coalesce(kurtosis(v), 0) END AS ku,
            min(v) AS mn, max(v) AS mx, avg(v) AS mu, stddev_samp(v) AS sd, quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, quantile_cont(v, 0.99) AS p99 FROM long GROUP BY 1),
      c AS (SELECT variable, count(v) AS n, count(*) FILTER (WHERE v < q1 - 1.5::DOUBLE * (q3 - q1) OR v > q3 + 1.5::DOUBLE * (q3 - q1)) AS iqr_outlier_count,
            count(*) FILTER (WHERE sd > 0 AND abs(v - mu) > 3 * sd) AS three_sd_count, count(*) FILTER (WHERE v = 0) AS zero_count, count(*) FILTER (WHERE v < 0) AS negative_count
            FROM long JOIN s USING (variable) GROUP BY 1),
      t AS (SELECT s.*, c.* EXCLUDE (variable), concat_ws('; ', CASE WHEN abs(sk) >= 2 THEN 'strong skew' WHEN abs(sk) >= 1 THEN 'some skew' WHEN sk IS NOT NULL THEN 'little skew' END,
            CASE WHEN ku > 3 THEN 'tails heavier than normal' END, CASE WHEN zero_count::DOUBLE / n >= 0.05 THEN 'many zeros' END,
            CASE WHEN variable IN ('start_rate', 'open_pct') AND mn >= 0 AND mx <= 100 THEN 'rate, all values from 0 to 100'
                 WHEN variable IN ('start_rate', 'open_pct') THEN 'rate, some values outside 0 to 100' END,
            CASE WHEN negative_count > 0 THEN 'has negative values' END) AS note FROM s JOIN c USING (variable))
      SELECT variable, count, missing_count, round(sk, 6) AS skewness, round(ku, 6) AS excess_kurtosis, round(mn, 6) AS min, round(p01, 6) AS p01, round(p99, 6) AS p99, round(mx, 6) AS max,
        iqr_outlier_count, three_sd_count, zero_count, negative_count, CAST(0 AS BIGINT) AS nonfinite_count,
        CASE WHEN note = '' THEN 'nothing notable' ELSE note END AS notes FROM t""",
)
def distribution_shape(spark, folder):
    return B.rounded(profile.distribution_shape(B.panel_table(spark, folder), VARIABLES, RATES))


def _grouped_sql(group, columns, source=None):
    long = source or _unpivot(columns, group)
    return f""", long AS ({long})
      SELECT {group}, variable, count(*) AS row_count, {_COUNTS}, round(100.0::DOUBLE * (count(*) - count(v)) / count(*), 6) AS missing_pct,
        round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max,
        round(100.0::DOUBLE * count(*) FILTER (WHERE v = 0) / nullif(count(v), 0), 6) AS zero_pct,
        {", ".join(f"{_q(p)} AS {n}" for n, p in profile.GROUP_QUANTILES.items())},
        round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr, round(mad(v), 6) AS mad FROM long GROUP BY 1, 2"""


@query("summary_by_year", PANEL + _grouped_sql("yr", VARIABLES))
def summary_by_year(spark, folder):
    return B.rounded(profile.grouped_summary(B.panel_table(spark, folder), ["yr"], VARIABLES))


@query(
    "summary_by_category",
    PANEL
    + f""", covered AS (SELECT ind, count(DISTINCT geo) AS place_count, count(DISTINCT yr) AS year_count FROM analytic_panel GROUP BY 1)
      SELECT g.*, place_count, year_count FROM (SELECT * FROM ({_grouped_sql("ind", VARIABLES).replace(", long AS", "WITH long AS", 1)})) g JOIN covered USING (ind)""",
)
def summary_by_category(spark, folder):
    rows = B.panel_table(spark, folder)
    covered = rows.groupBy("ind").agg(
        F.count_distinct("geo").alias("place_count"), F.count_distinct("yr").alias("year_count")
    )
    return B.rounded(profile.grouped_summary(rows, ["ind"], VARIABLES).join(covered, "ind"))


@query(
    "summary_by_place",
    PANEL
    + f""", covered AS (SELECT geo, count(DISTINCT ind) AS category_count, count(DISTINCT yr) AS year_count, (count(*) >= 30 AND count(DISTINCT ind) >= 5 AND count(DISTINCT yr) >= 6) AS eligible_for_comparison FROM analytic_panel GROUP BY 1),
      coarse AS (SELECT DISTINCT geo, yr, population_growth, income, open_pct FROM analytic_panel),
      mid AS (SELECT geo, round(median(population_growth), 6) AS population_growth_control_median, round(median(income), 6) AS income_control_median, round(median(open_pct), 6) AS open_pct_control_median FROM coarse GROUP BY 1)
      SELECT g.*, category_count, year_count, eligible_for_comparison, mid.* EXCLUDE (geo)
      FROM (SELECT * FROM ({_grouped_sql("geo", ["start_rate", "employment_growth"]).replace(", long AS", "WITH long AS", 1)})) g JOIN covered USING (geo) JOIN mid USING (geo)""",
)
def summary_by_place(spark, folder):
    return B.rounded(
        profile.group_profile(
            B.panel_table(spark, folder), "geo", "ind", "yr", ["start_rate", "employment_growth"], COARSE,
            min_rows=30, min_categories=5, min_years=6,
        )
    )


@query(
    "place_coverage_rule",
    PANEL
    + """SELECT geo, count(*) AS row_count, count(DISTINCT ind) AS category_count, count(DISTINCT yr) AS year_count,
         (count(*) >= 30 AND count(DISTINCT ind) >= 5 AND count(DISTINCT yr) >= 6) AS eligible_for_comparison
         FROM analytic_panel WHERE NOT any_suppression GROUP BY 1""",
)
def place_coverage_rule(spark, folder):
    rows = B.panel_table(spark, folder).filter("NOT any_suppression")
    return profile.group_coverage(rows, "geo", "ind", "yr", min_rows=30, min_categories=5, min_years=6)


@query(
    "year_summary_two_grains",
    PANEL
    + f""", coarse AS (SELECT DISTINCT geo, yr, income, open_pct FROM analytic_panel)
      SELECT 'row' AS grain, * FROM ({_grouped_sql("yr", ["start_rate"]).replace(", long AS", "WITH long AS", 1)})
      UNION ALL SELECT 'place_year', * FROM ({_grouped_sql("yr", [], "SELECT yr, 'income' AS variable, income AS v FROM coarse UNION ALL SELECT yr, 'open_pct', open_pct FROM coarse").replace(", long AS", "WITH long AS", 1)})""",
)
def year_summary_two_grains(spark, folder):
    rows = B.panel_table(spark, folder)
    coarse = profile.collapse(rows, ["geo", "yr"], ["income", "open_pct"])
    fine = profile.grouped_summary(rows, ["yr"], ["start_rate"]).withColumn("grain", F.lit("row"))
    return B.rounded(
        fine.unionByName(
            profile.grouped_summary(coarse, ["yr"], ["income", "open_pct"]).withColumn("grain", F.lit("place_year"))
        )
    )


@query(
    "category_year_medians",
    PANEL
    + """SELECT yr, ind, round(median(start_rate), 6) AS start_median, round(median(employment_growth), 6) AS growth_median FROM analytic_panel
         GROUP BY 1, 2""",
)
def category_year_medians(spark, folder):
    return B.rounded(
        profile.medians(
            B.panel_table(spark, folder), ["yr", "ind"], {"start_rate": "start_median", "employment_growth": "growth_median"}
        )
    )


@query(
    "median_on_rows",
    PANEL
    + """SELECT geo, ind, yr, round(start_rate, 6) AS start_rate, round(median(start_rate) OVER (PARTITION BY yr, ind), 6) AS group_median,
         round(start_rate - avg(start_rate) OVER (PARTITION BY geo, ind), 6) AS start_rate_within FROM analytic_panel""",
)
def median_on_rows(spark, folder):
    """Group median put on rows, and the deviation from the panel mean."""
    rows = B.panel_table(spark, folder).select(*B.KEY, "start_rate")
    cut = profile.medians(rows, ["yr", "ind"], {"start_rate": "group_median"})
    return B.rounded(relations.demeaned(rows.join(cut, ["yr", "ind"], "left"), B.PANEL, ["start_rate"]))


@query(
    "plausibility_counts",
    PANEL
    + """SELECT 'employment' AS variable, 'negative_value' AS rule, count(*) FILTER (WHERE employment < 0) AS flagged_count FROM analytic_panel
      UNION ALL SELECT 'payroll', 'negative_value', count(*) FILTER (WHERE payroll < 0) FROM analytic_panel
      UNION ALL SELECT 'pay_growth', 'negative_value', count(*) FILTER (WHERE pay_growth < 0) FROM analytic_panel
      UNION ALL SELECT 'start_rate', 'outside_0_100', count(*) FILTER (WHERE start_rate < 0 OR start_rate > 100) FROM analytic_panel
      UNION ALL SELECT 'average_pay', 'outside_0_100', count(*) FILTER (WHERE average_pay < 0 OR average_pay > 100) FROM analytic_panel
      UNION ALL SELECT 'employment_growth', 'nonfinite_growth', CAST(0 AS BIGINT)""",
)
def plausibility_counts(spark, folder):
    return profile.plausibility(
        B.panel_table(spark, folder), ["employment", "payroll", "pay_growth"], ["start_rate", "average_pay"], ["employment_growth"]
    )


CAUSES = {
    "start_rate_lag1": {"lag": 1, "flags": [("always", "source_data_quality_missing")]},
    "employment_growth": {"growth": True, "flags": [("activity_suppressed", "source_data_quality_missing")]},
    "employment_growth_lag1": {"lag": 1, "growth": True, "flags": [("activity_suppressed", "source_data_quality_missing")]},
    "employment_growth_lag2": {"lag": 2, "growth": True, "flags": [("activity_suppressed", "source_data_quality_missing")]},
    "income_lag1": {"lag": 1, "coarse": True},
    "open_pct_lag1": {"lag": 1, "coarse": True, "flags": [("controls_incomplete", "source_data_quality_missing")]},
    "support_employment": {
        "flags": [("support_suppressed", "source_data_quality_missing"), ("support_unmatched", "support_source_missing")]
    },
}


def _causes_sql():
    parts = []
    for name, rule in CAUSES.items():
        tests = []
        lag = rule.get("lag")
        if lag:
            probe = (
                f"NOT EXISTS (SELECT 1 FROM rows_ p WHERE p.geo = a.geo AND p.yr = a.yr - {lag})"
                if rule.get("coarse")
                else f"NOT EXISTS (SELECT 1 FROM rows_ p WHERE p.geo = a.geo AND p.ind = a.ind AND p.yr = a.yr - {lag})"
            )
            if rule.get("growth"):
                probe += f" OR a.yr - {lag} = 1995"
            tests.append(f"WHEN {probe} THEN 'expected_structural_missing'")
        elif rule.get("growth"):
            tests.append("WHEN a.yr = 1995 THEN 'expected_structural_missing'")
        for flag, cause in rule.get("flags", []):
            test = "TRUE" if flag == "always" else flag
            tests.append(f"WHEN {test} THEN '{cause}'")
        tests.append("ELSE 'unexplained_missing'")
        parts.append(f"SELECT '{name}' AS variable, CASE {' '.join(tests)} END AS cause_category FROM rows_ a WHERE {name} IS NULL")
    names = ", ".join(f"('{n}')" for n in CAUSES)
    return f""", rows_ AS (SELECT *, NOT support_matched AS support_unmatched FROM analytic_panel WHERE NOT starts_suppressed), found AS ({" UNION ALL ".join(parts)})
      SELECT n.variable, c.cause_category, count(f.variable) AS missing_count FROM (VALUES {names}) n(variable)
      CROSS JOIN (VALUES ('expected_structural_missing'), ('source_data_quality_missing'), ('support_source_missing'), ('unexplained_missing')) c(cause_category)
      LEFT JOIN found f ON f.variable = n.variable AND f.cause_category = c.cause_category GROUP BY 1, 2"""


@query("structural_missingness", PANEL + _causes_sql())
def structural_missingness(spark, folder):
    rows = B.panel_table(spark, folder).filter("NOT starts_suppressed").withColumn("support_unmatched", ~F.col("support_matched"))
    rules = {
        name: {**rule, "flags": [(F.lit(True) if t == "always" else F.col(t), c) for t, c in rule.get("flags", [])]}
        for name, rule in CAUSES.items()
    }
    return profile.structural_missingness(rows, B.PANEL, "geo", "yr", rules, 1995)


CONCENTRATED = ["employment_growth", "support_employment"]


def _concentration_part(label, column):
    return " UNION ALL ".join(
        f"""SELECT '{label}' AS grouping, '{v}' AS variable, CAST({column} AS VARCHAR) AS group_value, count(*) AS group_n, count(*) - count({v}) AS missing_count,
            100.0::DOUBLE * (count(*) - count({v})) / count(*) AS r FROM analytic_panel GROUP BY {column}"""
        for v in CONCENTRATED
    )


@query(
    "missing_concentration",
    PANEL
    + f""", rates AS ({_concentration_part("category", "ind")} UNION ALL {_concentration_part("place", "geo")}),
      kept AS (SELECT *, row_number() OVER (PARTITION BY variable, "grouping" ORDER BY r DESC, group_value) AS k, median(r) OVER (PARTITION BY variable, "grouping") AS m FROM rates WHERE group_n >= 20)
      SELECT variable, "grouping", group_value, group_n, missing_count, round(r, 6) AS missing_pct, round(m, 6) AS median_group_missing_pct FROM kept WHERE k <= 5""",
)
def missing_concentration(spark, folder):
    return B.rounded(
        profile.missing_concentration(
            B.panel_table(spark, folder), CONCENTRATED, {"category": "ind", "place": "geo"}, min_rows=20
        )
    )


@query(
    "size_and_missingness",
    PANEL
    + f""", places AS (SELECT geo, avg(population) AS s, {", ".join(f"avg(CASE WHEN {v} IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS {v}" for v in CONCENTRATED)} FROM analytic_panel GROUP BY 1 HAVING count(*) >= 20),
      ranked AS (SELECT *, row_number() OVER (ORDER BY s, geo) AS k, count(*) OVER () AS n FROM places),
      long AS (SELECT variable, r, s, CASE WHEN k <= 1 + (n - 1) / 3.0::DOUBLE THEN 'lower' WHEN k <= 1 + 2 * (n - 1) / 3.0::DOUBLE THEN 'middle' ELSE 'upper' END AS third
               FROM ranked UNPIVOT (r FOR variable IN ({", ".join(CONCENTRATED)}))),
      rk AS (SELECT *, rank() OVER (PARTITION BY variable ORDER BY s) + (count(*) OVER (PARTITION BY variable, s) - 1) / 2.0 AS rs,
               rank() OVER (PARTITION BY variable ORDER BY r) + (count(*) OVER (PARTITION BY variable, r) - 1) / 2.0 AS rr FROM long)
      SELECT variable, count(*) AS place_count, count(*) AS n_pairs, CASE WHEN min(rr) < max(rr) AND min(rs) < max(rs) THEN round(corr(rs, rr), 6) END AS spearman,
        {", ".join(f"round(100 * avg(r) FILTER (WHERE third = '{t}'), 6) AS {t}_third_missing_pct" for t in ("lower", "middle", "upper"))} FROM rk GROUP BY 1""",
)
def size_and_missingness(spark, folder):
    return B.rounded(
        profile.size_missingness(B.panel_table(spark, folder), "geo", "population", CONCENTRATED, min_rows=20)
    )


@query(
    "extreme_observations",
    PANEL
    + " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, '{tail}' AS tail, CAST(k AS INT) AS tail_rank, round({v}, 6) AS value, geo, ind, yr FROM
            (SELECT *, row_number() OVER (ORDER BY {v} {way}, geo, ind, yr) AS k FROM analytic_panel WHERE {v} IS NOT NULL) WHERE k <= 3"""
        for v in ("start_rate", "employment_growth")
        for tail, way in (("lowest", "ASC"), ("highest", "DESC"))
    ),
)
def extreme_observations(spark, folder):
    return B.rounded(profile.extremes(B.panel_table(spark, folder), ["start_rate", "employment_growth"], B.KEY))


_DENOMINATORS = {"employment_growth": "prior_employment", "payroll_growth": "prior_payroll"}


@query(
    "growth_denominators",
    B.with_sql(B.ACTIVITY_GROWTH_SQL)
    + """, long AS (SELECT 'employment_growth' AS growth_variable, a.employment_growth AS g, p.employment AS d FROM activity_growth a LEFT JOIN activity_growth p ON p.geo = a.geo AND p.ind = a.ind AND p.yr = a.yr - 1
           UNION ALL SELECT 'payroll_growth', a.payroll_growth, p.payroll FROM activity_growth a LEFT JOIN activity_growth p ON p.geo = a.geo AND p.ind = a.ind AND p.yr = a.yr - 1),
         cuts AS (SELECT growth_variable, quantile_cont(abs(g), 0.99) AS c, quantile_cont(d, 0.1) FILTER (WHERE g IS NOT NULL AND d > 0) AS q FROM long GROUP BY 1)
         SELECT growth_variable, round(c, 6) AS absolute_growth_p99, round(q, 6) AS prior_p10_positive, count(g) AS finite_count, count(*) FILTER (WHERE abs(g) >= c) AS top_count,
           count(*) FILTER (WHERE abs(g) >= c AND d IS NULL) AS top_missing_prior, round(avg(CASE WHEN d <= q THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE abs(g) >= c), 6) AS top_bottom_decile_share,
           count(*) FILTER (WHERE abs(g) >= c AND d <= 0) AS top_nonpositive_prior, count(*) - count(g) AS missing_growth, count(*) FILTER (WHERE g IS NULL AND d = 0) AS missing_prior_zero,
           count(*) FILTER (WHERE g IS NULL AND d IS NULL) AS missing_prior_unavailable, round(median(d) FILTER (WHERE abs(g) >= c), 6) AS top_prior_median
         FROM long JOIN cuts USING (growth_variable) GROUP BY growth_variable, c, q""",
)
def growth_denominators(spark, folder):
    columns = {
        **cal.growths(B.GROWTHS, suppressed="is_suppressed"),
        **cal.prior_value("employment", "prior_employment"),
        **cal.prior_value("payroll", "prior_payroll"),
    }
    rows = cal.add(B.activity_layer(spark, folder), B.PANEL, "yr", columns)
    return B.rounded(profile.growth_denominators(rows, _DENOMINATORS))


@query("panel_fingerprint")
def panel_fingerprint(spark, folder):
    return profile.fingerprint(B.panel_table(spark, folder))


@query(
    "read_only_guarantee",
    "SELECT count(*) AS row_count, TRUE AS unchanged FROM orders",
)
def read_only_guarantee(spark, folder):
    """Fingerprint before and after a full read of the table."""
    orders = table(spark, folder, "orders")
    before = profile.fingerprint(orders)
    summary = orders.agg(F.count(F.lit(1)).alias("row_count"))
    same = profile.unchanged(before, profile.fingerprint(table(spark, folder, "orders")))
    return summary.withColumn("unchanged", F.lit(same))


@query(
    "price_histogram",
    """SELECT CASE WHEN o_totalprice = 500000 THEN 20 ELSE CAST(floor(o_totalprice / 25000) AS INT) + 1 END AS bin, count(*) AS n
       FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1""",
)
def price_histogram(spark, folder):
    return profile.histogram(table(spark, folder, "orders"), "o_totalprice", 0.0, 500000.0, 20)


# --- relationships

PAIRS = [("employment_growth", "start_rate"), ("income", "start_rate"), ("open_pct", "start_rate"), ("pay_growth", "employment_growth")]


def _corr_sql(pairs_cte, keys):
    by = ", ".join(keys)
    return f""", {pairs_cte},
      rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx,
                rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL),
      c AS (SELECT {by}, 'pearson' AS method, count(*) AS n, CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(y, x) END AS r FROM rk GROUP BY {by}
            UNION ALL SELECT {by}, 'spearman', count(*), CASE WHEN count(*) >= 3 AND min(x) < max(x) AND min(y) < max(y) THEN corr(ry, rx) END FROM rk GROUP BY {by})
      SELECT {by}, method, n, round(r, 6) AS coefficient, round(CASE WHEN n > 2 AND abs(r) < 1 THEN r * sqrt((n - 2) / (1 - r * r)) END, 4) AS t_statistic FROM c"""


def _pairs_sql(pairs, extra="", source="analytic_panel"):
    return "pairs AS (" + " UNION ALL ".join(
        f"SELECT {extra}'{a}' AS x_name, '{b}' AS y_name, {a} AS x, {b} AS y FROM {source}" for a, b in pairs
    ) + ")"


def _coefficients(rows, keys, **options):
    result = relations.correlations(rows, keys, **options)
    return result.select(
        *keys, "method", "n", F.round("coefficient", 6).alias("coefficient"), F.round("t_statistic", 4).alias("t_statistic")
    )


@query("pairwise_correlations", PANEL + _corr_sql(_pairs_sql(PAIRS), ["x_name", "y_name"]))
def pairwise_correlations(spark, folder):
    rows = relations.pair_rows(B.panel_table(spark, folder), PAIRS)
    return _coefficients(rows, ["x_name", "y_name"])


@query("correlation_p_values")
def correlation_p_values(spark, folder):
    """Exact Student p-values beside the coefficients."""
    rows = relations.pair_rows(B.panel_table(spark, folder), PAIRS)
    return B.rounded(relations.with_p_value(relations.correlations(rows, ["x_name", "y_name"])))


_MATRIX = ["start_rate", "employment_growth", "income", "open_pct"]


@query(
    "correlation_matrix",
    PANEL
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, round(corr({a}, {b}), 6) AS coefficient FROM analytic_panel WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for a in _MATRIX
        for b in _MATRIX
    ),
)
def correlation_matrix(spark, folder):
    return B.rounded(relations.correlation_matrix(B.panel_table(spark, folder), _MATRIX))


@query(
    "category_relationships",
    PANEL
    + """, rk AS (SELECT ind, employment_growth AS x, start_rate AS y, rank() OVER (PARTITION BY ind ORDER BY employment_growth) + (count(*) OVER (PARTITION BY ind, employment_growth) - 1) / 2.0 AS rx,
             rank() OVER (PARTITION BY ind ORDER BY start_rate) + (count(*) OVER (PARTITION BY ind, start_rate) - 1) / 2.0 AS ry FROM analytic_panel WHERE employment_growth IS NOT NULL AND start_rate IS NOT NULL)
         SELECT ind, count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, CASE WHEN count(*) >= 10 THEN round(regr_slope(y, x), 6) END AS slope, count(*) >= 10 AS slope_eligible FROM rk GROUP BY 1""",
)
def category_relationships(spark, folder):
    return B.rounded(relations.group_relationships(B.panel_table(spark, folder), "ind", "employment_growth", "start_rate"))


_LAG_PAIRS = [(f"start_rate_lag{n}", "start_rate") for n in (1, 2, 3)]


@query("lag_correlations", PANEL + _corr_sql(_pairs_sql(_LAG_PAIRS), ["x_name", "y_name"]))
def lag_correlations(spark, folder):
    rows = relations.pair_rows(B.panel_table(spark, folder), _LAG_PAIRS)
    return _coefficients(rows, ["x_name", "y_name"])


_SAMPLES = {"full": "TRUE", "exclude_2000": "yr <> 2000", "exclude_2000_2001": "yr NOT IN (2000, 2001)"}


@query(
    "year_exclusion_sensitivity",
    PANEL
    + _corr_sql(
        "pairs AS (" + " UNION ALL ".join(f"SELECT '{n}' AS sample, employment_growth AS x, start_rate AS y FROM analytic_panel WHERE {t}" for n, t in _SAMPLES.items()) + ")",
        ["sample"],
    ),
)
def year_exclusion_sensitivity(spark, folder):
    rows = relations.sample_variants(B.panel_table(spark, folder), {n: F.expr(t) for n, t in _SAMPLES.items()})
    pairs = relations.pair_rows(rows, [("employment_growth", "start_rate")], ["sample"])
    return _coefficients(pairs, ["sample"])


@query(
    "trimmed_correlation",
    PANEL
    + """, p AS (SELECT employment_growth AS x, start_rate AS y FROM analytic_panel WHERE employment_growth IS NOT NULL AND start_rate IS NOT NULL),
         b AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM p)
         SELECT count(*) AS n, round(corr(y, x), 6) AS coefficient FROM p, b WHERE x BETWEEN lo AND hi""",
)
def trimmed_correlation(spark, folder):
    pairs = relations.pair_rows(B.panel_table(spark, folder), [("employment_growth", "start_rate")])
    kept = relations.trimmed(pairs, "x")
    return B.rounded(kept.agg(F.count(F.lit(1)).alias("n"), relations.pearson(F.col("x"), F.col("y")).alias("coefficient")))


@query(
    "within_panel_persistence",
    PANEL
    + """, w AS (SELECT start_rate, start_rate_lag1, start_rate - avg(start_rate) OVER (PARTITION BY geo, ind) AS a, start_rate_lag1 - avg(start_rate_lag1) OVER (PARTITION BY geo, ind) AS b FROM analytic_panel)
         SELECT 'pooled_levels' AS sample_grain, count(*) AS n, round(corr(start_rate, start_rate_lag1), 6) AS coefficient FROM w WHERE start_rate IS NOT NULL AND start_rate_lag1 IS NOT NULL
         UNION ALL SELECT 'within_panel_deviations', count(*), round(corr(a, b), 6) FROM w WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def within_panel_persistence(spark, folder):
    rows = relations.demeaned(B.panel_table(spark, folder), B.PANEL, ["start_rate", "start_rate_lag1"])
    pairs = relations.pair_rows(
        rows, [("start_rate_lag1", "start_rate"), ("start_rate_lag1_within", "start_rate_within")]
    )
    grain = F.when(F.col("x_name") == "start_rate_lag1", "pooled_levels").otherwise("within_panel_deviations")
    return B.rounded(
        pairs.groupBy(grain.alias("sample_grain")).agg(
            F.count(F.lit(1)).alias("n"), relations.pearson(F.col("x"), F.col("y")).alias("coefficient")
        )
    )


@query(
    "place_year_means",
    PANEL
    + """, m AS (SELECT geo, yr, avg(start_rate) AS start_rate, avg(employment_growth) AS employment_growth, max(income) AS income, max(open_pct) AS open_pct FROM analytic_panel GROUP BY 1, 2)
         SELECT geo, yr, round(start_rate, 6) AS start_rate, round(employment_growth, 6) AS employment_growth, round(income, 6) AS income, round(open_pct, 6) AS open_pct FROM m""",
)
def place_year_means(spark, folder):
    rows = B.panel_table(spark, folder)
    means = rows.groupBy("geo", "yr").agg(F.avg("start_rate").alias("start_rate"), F.avg("employment_growth").alias("employment_growth"))
    controls = profile.collapse(rows, ["geo", "yr"], ["income", "open_pct"])
    return B.rounded(means.join(controls, ["geo", "yr"]))


QUADRANTS = """, cut AS (SELECT yr, ind, median(start_rate) AS sc, median(employment_growth) AS gc FROM analytic_panel GROUP BY 1, 2),
  quad AS (SELECT p.*, CASE WHEN employment_growth >= gc THEN 'high' ELSE 'low' END || '_growth_' || CASE WHEN start_rate >= sc THEN 'high' ELSE 'low' END || '_startup' AS quadrant
           FROM analytic_panel p JOIN cut USING (yr, ind) WHERE start_rate IS NOT NULL AND employment_growth IS NOT NULL)"""


def quadrant_rows(spark, folder):
    return relations.with_quadrants(B.panel_table(spark, folder), ["yr", "ind"], "start_rate", "employment_growth")


@query(
    "descriptive_quadrants",
    PANEL
    + QUADRANTS
    + """ SELECT yr, ind, quadrant, count(*) AS observation_count, count(DISTINCT geo) AS geo_count,
          round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY yr, ind) * 100, 6) AS percent_within_group FROM quad GROUP BY 1, 2, 3""",
)
def descriptive_quadrants(spark, folder):
    return B.rounded(
        relations.group_shares(quadrant_rows(spark, folder), ["yr", "ind"], ["quadrant"], "percent_within_group", "geo")
    )


@query(
    "quadrant_context",
    PANEL
    + QUADRANTS
    + """, m AS (SELECT geo, yr, quadrant, avg(start_rate) AS start_rate, avg(income) AS income FROM quad GROUP BY 1, 2, 3)
         SELECT quadrant, count(*) AS place_year_count, count(DISTINCT geo) AS place_count, round(avg(start_rate), 6) AS start_rate_mean, round(avg(income), 6) AS income_mean,
           round(median(income), 6) AS income_median FROM m GROUP BY 1""",
)
def quadrant_context(spark, folder):
    return B.rounded(
        relations.quadrant_context(quadrant_rows(spark, folder), "geo", "yr", ["start_rate", "income"], ["income"])
    )


@query(
    "quadrant_composition",
    PANEL
    + QUADRANTS
    + """ SELECT 'ind' AS dimension, quadrant, ind AS value, count(*) AS observation_count, round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY quadrant) * 100, 6) AS percent_within_quadrant FROM quad GROUP BY quadrant, ind
          UNION ALL SELECT 'yr', quadrant, CAST(yr AS VARCHAR), count(*), round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY quadrant) * 100, 6) FROM quad GROUP BY quadrant, yr""",
)
def quadrant_composition(spark, folder):
    rows = quadrant_rows(spark, folder)
    parts = [
        relations.group_shares(rows.withColumn("value", F.col(c).cast("string")), ["quadrant"], ["value"], "percent_within_quadrant")
        .withColumn("dimension", F.lit(c))
        for c in ("ind", "yr")
    ]
    return B.rounded(parts[0].unionByName(parts[1]))


@query(
    "quadrant_row_context",
    PANEL
    + QUADRANTS
    + """ SELECT quadrant, count(*) AS observation_count, count(DISTINCT geo) AS place_count, count(DISTINCT ind) AS category_count, round(avg(start_rate), 6) AS start_rate_mean,
          round(median(start_rate), 6) AS start_rate_median, round(avg(employment_growth), 6) AS growth_mean, round(median(employment_growth), 6) AS growth_median FROM quad GROUP BY 1""",
)
def quadrant_row_context(spark, folder):
    rows = quadrant_rows(spark, folder)
    counts = rows.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct("geo").alias("place_count"),
        F.count_distinct("ind").alias("category_count"), F.avg("start_rate").alias("start_rate_mean"),
        F.avg("employment_growth").alias("growth_mean"),
    )
    middle = profile.medians(rows, ["quadrant"], {"start_rate": "start_rate_median", "employment_growth": "growth_median"})
    return B.rounded(counts.join(middle, "quadrant"))


@query(
    "clustered_regression",
    PANEL
    + """, d AS (SELECT geo, ind, start_rate AS y, employment_growth AS x FROM analytic_panel WHERE start_rate IS NOT NULL AND employment_growth IS NOT NULL),
         f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx FROM d),
         g AS (SELECT geo, ind, sum(y - a - b * x) AS s0, sum((y - a - b * x) * x) AS s1 FROM d, f GROUP BY 1, 2),
         m AS (SELECT sum(s0 * s0) AS m00, sum(s0 * s1) AS m01, sum(s1 * s1) AS m11, count(*)::DOUBLE AS gn FROM g),
         v AS (SELECT f.*, m.*, n * sxx - sx * sx AS det, gn / (gn - 1) * (n - 1) / (n - 2) AS k FROM f, m)
         SELECT 'bivariate' AS model, 'const' AS term, round(a, 6) AS coefficient, round(sqrt(k * (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11)) / det, 6) AS std_error, CAST(n AS BIGINT) AS n, round(r2, 6) AS r_squared FROM v
         UNION ALL SELECT 'bivariate', 'employment_growth', round(b, 6), round(sqrt(k * (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11)) / det, 6), CAST(n AS BIGINT), round(r2, 6) FROM v""",
)
def clustered_regression(spark, folder):
    result = relations.clustered_ols(
        B.panel_table(spark, folder), "start_rate", ["employment_growth"], clusters=B.PANEL, model="bivariate"
    )
    return B.rounded(result.select("model", "term", "coefficient", "std_error", "n", "r_squared"))


@query("regression_specifications")
def regression_specifications(spark, folder):
    """The five control sets with panel-clustered errors, and one HC3 fit."""
    rows = B.panel_table(spark, folder)
    controls = ["income", "open_pct"]
    specs = [
        ("bivariate", ["employment_growth"], []),
        ("year_controls", ["employment_growth"], ["yr"]),
        ("category_controls", ["employment_growth"], ["ind"]),
        ("year_category_controls", ["employment_growth"], ["yr", "ind"]),
        ("regional_controls", ["employment_growth", *controls], ["yr", "ind"]),
    ]
    result = relations.clustered_ols(rows, "start_rate", ["employment_growth"], model="hc3")
    for name, predictors, categorical in specs:
        result = result.unionByName(
            relations.clustered_ols(rows, "start_rate", predictors, categorical, B.PANEL, name)
        )
    return B.rounded(result)


# --- contracts


@query(
    "panel_contracts",
    PANEL
    + """SELECT name, 'panel' AS dataset, CASE WHEN n = 0 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS VARCHAR) AS observed, '0' AS expected FROM (
           SELECT 'year_range' AS name, count(*) FILTER (WHERE yr NOT BETWEEN 1995 AND 2000) AS n FROM analytic_panel
           UNION ALL SELECT 'nonnegative_employment', count(*) FILTER (WHERE employment < 0) FROM analytic_panel
           UNION ALL SELECT 'nonnegative_pay_growth', count(*) FILTER (WHERE pay_growth < 0) FROM analytic_panel
           UNION ALL SELECT 'percentage_start_rate', count(*) FILTER (WHERE start_rate < 0 OR start_rate > 100) FROM analytic_panel
           UNION ALL SELECT 'suppression_matches_metric', count(*) FILTER (WHERE starts_suppressed <> (start_rate IS NULL)) FROM analytic_panel
           UNION ALL SELECT 'unique_key', count(*) FROM (SELECT geo, ind, yr FROM analytic_panel GROUP BY 1, 2, 3 HAVING count(*) > 1))""",
)
def panel_contracts(spark, folder):
    rows = B.panel_table(spark, folder)
    conditions = {
        "year_range": K.outside_years("yr", 1995, 2000),
        **K.negative(["employment", "pay_growth"]),
        **K.outside_percent(["start_rate"]),
        "suppression_matches_metric": K.flag_mismatch(F.col("starts_suppressed"), "start_rate"),
    }
    return K.row_checks(rows, conditions, "panel").unionByName(K.unique_key(rows, B.KEY, "panel"))


@query(
    "column_contracts",
    """SELECT * FROM (VALUES ('required_columns', 'orders', 'fail', 'o_missing', 'none missing'), ('forbidden_columns', 'orders', 'fail', 'o_orderpriority,o_totalprice', 'none present'),
       ('required_columns', 'customer', 'pass', '', 'none missing'), ('forbidden_columns', 'customer', 'pass', '', 'none present')) t(name, dataset, status, observed, expected)""",
)
def column_contracts(spark, folder):
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return (
        K.required_columns(orders, ["o_orderkey", "o_missing"], "orders")
        .unionByName(K.forbidden_columns(orders, ["o_totalprice"], ["priority"], "orders"))
        .unionByName(K.required_columns(customer, ["c_custkey"], "customer"))
        .unionByName(K.forbidden_columns(customer, [], ["target", "label", "future_"], "customer"))
    )


@query(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def duplicate_keys(spark, folder):
    return K.duplicates(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "scope_contracts",
    PANEL
    + """SELECT name, 'panel' AS dataset, CASE WHEN observed = expected THEN 'pass' ELSE 'fail' END AS status, observed, expected FROM (
           SELECT 'first_year' AS name, CAST(min(yr) AS VARCHAR) AS observed, '1995' AS expected FROM analytic_panel
           UNION ALL SELECT 'last_year', CAST(max(yr) AS VARCHAR), '2001' FROM analytic_panel
           UNION ALL SELECT 'category_count', CAST(count(DISTINCT ind) AS VARCHAR), '5' FROM analytic_panel
           UNION ALL SELECT 'non_member_rows', CAST(count(*) FILTER (WHERE geo_type <> 'MSA') AS VARCHAR), '0' FROM analytic_panel JOIN geo_dim USING (geo)
           UNION ALL SELECT 'year_sequence', CAST(max(yr) - min(yr) + 1 - count(DISTINCT yr) AS VARCHAR), '0' FROM analytic_panel)""",
)
def scope_contracts(spark, folder):
    rows = B.panel_table(spark, folder)
    typed = rows.join(B.geo_dim(spark, folder).select("geo", "geo_type"), "geo")
    span = {
        "first_year": (F.min("yr"), 1995),
        "last_year": (F.max("yr"), 2001),
        "category_count": (F.count_distinct("ind"), 5),
        "non_member_rows": (F.count_if(F.col("geo_type") != "MSA"), 0),
    }
    return K.value_checks(typed, span, "panel").unionByName(K.contiguous(rows, "yr", "panel"))


@query(
    "post_write_assertion",
    PANEL
    + """SELECT 'written_rows' AS name, 'panel' AS dataset, 'pass' AS status, CAST(count(*) AS VARCHAR) AS observed, CAST(count(*) AS VARCHAR) AS expected FROM analytic_panel
         UNION ALL SELECT 'unique_key', 'panel', 'pass', '0', '0'""",
)
def post_write_assertion(spark, folder):
    """Rows read back from storage equal the core keys that should have been written."""
    stored = B.panel_table(spark, folder)
    core = B.start_layer(spark, folder).select(*B.KEY)
    growth = B.activity_layer(spark, folder).select(*B.KEY)
    places = B.geo_dim(spark, folder).filter("geo_type = 'MSA'").select("geo")
    expected = core.join(growth, B.KEY).join(places, "geo").filter("yr BETWEEN 1995 AND 2001").count()
    return K.value_checks(stored, {"written_rows": (F.count(F.lit(1)), expected)}, "panel").unionByName(
        K.unique_key(stored, B.KEY, "panel")
    )
