"""The panel layers over the provided tables, as DataFrames and as SQL text.

place = customer or supplier nation, category = market segment, year = calendar
year of the order or shipment. Thresholds below which a cell counts as suppressed
are parameters of the layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators import calendar as cal
from cellwise.session import table

KEY = ["geo", "ind", "yr"]
PANEL = ["geo", "ind"]
MIN_ORDERS = 12
MIN_LINES = 50
MIN_MEMBER_LINES = 8
MIN_CONTROL_ORDERS = 25
HORIZON = 3
DEV_LAST_YEAR = 2000

CONTROLS = ["population", "income", "finished_pct", "open_pct", "pending_pct"]


def year_of(column: str):
    return F.year(column).alias("yr")


def orders_by_cell(spark: SparkSession, folder: str, *columns) -> DataFrame:
    """Orders with place and category of the customer; ``columns`` prunes the orders before the join."""
    orders = table(spark, folder, "orders")
    orders = orders.select("o_custkey", *columns) if columns else orders
    customer = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).withColumnsRenamed(
        {"c_nationkey": "geo", "c_mktsegment": "ind"}
    )


def is_urgent():
    return (F.col("o_orderpriority") == "1-URGENT").alias("urgent")


def start_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Numerator (urgent orders), backbone (all orders) and revenue per cell."""
    return (
        orders_by_cell(spark, folder, is_urgent(), "o_totalprice", year_of("o_orderdate"))
        .groupBy(*KEY)
        .agg(
            F.count_if("urgent").alias("starts"),
            F.count(F.lit(1)).alias("backbone"),
            F.round(F.sum("o_totalprice"), 2).alias("revenue"),
        )
    )


STATUSES = ("F", "O", "P")


def order_cells(spark: SparkSession, folder: str) -> DataFrame:
    """What the start and the control layer count, per cell, in one pass over the orders.

    Orders are counted per customer and year first. ``customers`` adds up over the
    categories of a place: a customer key that occurs with two of them counts in one.
    Sums of prices are not rounded yet.
    """
    counts = {
        "starts": F.count_if("urgent"),
        "backbone": F.count(F.lit(1)),
        "revenue": F.sum("o_totalprice"),
        **{f"n_{s}": F.count_if(F.col("o_orderstatus") == s) for s in STATUSES},
    }
    per_customer = (
        table(spark, folder, "orders")
        .select("o_custkey", is_urgent(), "o_orderstatus", "o_totalprice", year_of("o_orderdate"))
        .repartition("o_custkey")
        .groupBy("o_custkey", "yr")
        .agg(*[c.alias(name) for name, c in counts.items()])
    )
    same_key = Window.partitionBy("o_custkey").orderBy("geo", "ind")
    again = (F.row_number().over(same_key) > 1) & F.lag("geo").over(same_key).eqNullSafe(F.col("geo"))
    customer = (
        table(spark, folder, "customer")
        .select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("geo"), F.col("c_mktsegment").alias("ind")
        )
        .withColumn("_again", again)
    )
    return (
        per_customer.join(customer, "o_custkey")
        .groupBy(*KEY)
        .agg(F.count_if(~F.col("_again")).alias("customers"), *[F.sum(c).alias(c) for c in counts])
    )


START_COUNTS_SQL = """
start_counts AS (
  SELECT c_nationkey AS geo, c_mktsegment AS ind, CAST(year(o_orderdate) AS INT) AS yr,
         CAST(count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS starts,
         count(*) AS backbone, round(sum(o_totalprice), 2) AS revenue
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3
)"""


def start_layer(
    spark: SparkSession, folder: str, min_orders: int = MIN_ORDERS, cells: DataFrame | None = None
) -> DataFrame:
    """Start rate per cell; a small cell keeps its row but loses its measures.

    ``cells`` here and in the other layers: the counts, where a caller has them.
    """
    counts = start_counts(spark, folder) if cells is None else cells
    kept = F.col("backbone") >= min_orders
    return counts.select(
        *KEY,
        (~kept).alias("is_suppressed"),
        F.when(kept, F.col("starts")).alias("starts"),
        F.when(kept, F.col("backbone")).alias("backbone"),
        F.when(kept, M.percent_of(F.col("starts"), F.col("backbone"))).alias("start_rate"),
    )


def start_panel(
    spark: SparkSession, folder: str, min_orders: int = MIN_ORDERS, cells: DataFrame | None = None
) -> DataFrame:
    lags = cal.lags(["start_rate"], (1, 2, 3), suppressed="is_suppressed")
    return cal.add(start_layer(spark, folder, min_orders, cells), PANEL, "yr", lags)


START_LAYER_SQL = (
    START_COUNTS_SQL
    + f""",
start_layer AS (
  SELECT geo, ind, yr, backbone < {MIN_ORDERS} AS is_suppressed,
         CASE WHEN backbone >= {MIN_ORDERS} THEN starts END AS starts,
         CASE WHEN backbone >= {MIN_ORDERS} THEN backbone END AS backbone,
         CASE WHEN backbone >= {MIN_ORDERS} THEN starts::DOUBLE / backbone * 100 END AS start_rate
  FROM start_counts
)"""
)

START_PANEL_SQL = (
    START_LAYER_SQL
    + """,
start_panel AS (
  SELECT a.*,
         CASE WHEN NOT p1.is_suppressed THEN p1.start_rate END AS start_rate_lag1,
         CASE WHEN NOT p2.is_suppressed THEN p2.start_rate END AS start_rate_lag2,
         CASE WHEN NOT p3.is_suppressed THEN p3.start_rate END AS start_rate_lag3
  FROM start_layer a
  LEFT JOIN start_layer p1 ON p1.geo = a.geo AND p1.ind = a.ind AND p1.yr = a.yr - 1
  LEFT JOIN start_layer p2 ON p2.geo = a.geo AND p2.ind = a.ind AND p2.yr = a.yr - 2
  LEFT JOIN start_layer p3 ON p3.geo = a.geo AND p3.ind = a.ind AND p3.yr = a.yr - 3
)"""
)


def shipped_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the category of the customer, columns pruned before the joins.

    Of the moment of shipment only the year is moved. The orders of a partition, one
    narrow row each, are hashed, so that the lines need no sort.
    """
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", year_of("l_shipdate")
    )
    buyers = orders_by_cell(spark, folder, "o_orderkey").select("o_orderkey", "geo", "ind")
    return lines.join(buyers.hint("shuffle_hash"), lines.l_orderkey == buyers.o_orderkey)


def line_sums() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("lines"),
        F.sum("l_quantity").alias("quantity"),
        F.round(F.sum("l_extendedprice"), 2).alias("payroll"),
    ]


def line_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Lines summed per cell and, where ``by_member``, per supplier, category and year.

    Both sums are taken in one aggregation, so the lines meet their orders once.
    """
    sets = [[F.col(c) for c in ("l_suppkey", "ind", "yr")], [F.col(c) for c in KEY]]
    return (
        shipped_lines(spark, folder)
        .groupingSets(sets, "l_suppkey", *KEY)
        .agg((F.grouping("geo") == 1).alias("by_member"), *line_sums())
    )


def activity_layer(
    spark: SparkSession, folder: str, min_lines: int = MIN_LINES, cells: DataFrame | None = None
) -> DataFrame:
    """Levels per cell and year of shipment, cells below ``min_lines`` suppressed."""
    if cells is None:
        cells = shipped_lines(spark, folder).groupBy(*KEY).agg(*line_sums())
    kept = F.col("lines") >= min_lines
    return cells.select(
        *KEY,
        (~kept).alias("is_suppressed"),
        F.when(kept, F.col("quantity")).alias("employment"),
        F.when(kept, F.col("lines").cast("double")).alias("establishments"),
        F.when(kept, F.col("payroll")).alias("payroll"),
        F.when(kept, M.average_pay(F.col("payroll"), F.col("quantity"))).alias("average_pay"),
    )


GROWTHS = {
    "employment": "employment_growth",
    "establishments": "establishment_growth",
    "payroll": "payroll_growth",
    "average_pay": "pay_growth",
}
GROWTH_LAGS = {
    "employment_growth": (1, 2, 3),
    "establishment_growth": (1, 2, 3),
    "payroll_growth": (1,),
    "pay_growth": (1,),
}


def activity_panel(
    spark: SparkSession, folder: str, min_lines: int = MIN_LINES, cells: DataFrame | None = None
) -> DataFrame:
    """Growth from the calendar-prior year, then lags of growth, in one shuffle."""
    levels = activity_layer(spark, folder, min_lines, cells)
    grown = cal.add(levels, PANEL, "yr", cal.growths(GROWTHS, suppressed="is_suppressed"))
    lagged = {}
    for column, steps in GROWTH_LAGS.items():
        lagged.update(cal.lags([column], steps, suppressed="is_suppressed"))
    return cal.add(grown, PANEL, "yr", lagged)


ACTIVITY_LAYER_SQL = f"""
activity_cells AS (
  SELECT c_nationkey AS geo, c_mktsegment AS ind, CAST(year(l_shipdate) AS INT) AS yr,
         count(*) AS lines, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS pay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3
),
activity_layer AS (
  SELECT geo, ind, yr, lines < {MIN_LINES} AS is_suppressed,
         CASE WHEN lines >= {MIN_LINES} THEN quantity END AS employment,
         CASE WHEN lines >= {MIN_LINES} THEN lines::DOUBLE END AS establishments,
         CASE WHEN lines >= {MIN_LINES} THEN pay END AS payroll,
         CASE WHEN lines >= {MIN_LINES} AND quantity > 0 THEN round_even(pay / quantity, 0) END AS average_pay
  FROM activity_cells
)"""


def _growth_sql(value: str, name: str) -> str:
    return (
        f"CASE WHEN NOT p.is_suppressed AND p.{value} > 0 "
        f"THEN (a.{value} - p.{value}) / p.{value} END AS {name}"
    )


ACTIVITY_GROWTH_SQL = (
    ACTIVITY_LAYER_SQL
    + f""",
activity_growth AS (
  SELECT a.*, {", ".join(_growth_sql(v, n) for v, n in GROWTHS.items())}
  FROM activity_layer a
  LEFT JOIN activity_layer p ON p.geo = a.geo AND p.ind = a.ind AND p.yr = a.yr - 1
)"""
)

ACTIVITY_PANEL_SQL = (
    ACTIVITY_GROWTH_SQL
    + f""",
activity_panel AS (
  SELECT a.*, {", ".join(
      f"CASE WHEN NOT p{n}.is_suppressed THEN p{n}.{column} END AS {column}_lag{n}"
      for column, steps in GROWTH_LAGS.items() for n in steps)}
  FROM activity_growth a
  LEFT JOIN activity_growth p1 ON p1.geo = a.geo AND p1.ind = a.ind AND p1.yr = a.yr - 1
  LEFT JOIN activity_growth p2 ON p2.geo = a.geo AND p2.ind = a.ind AND p2.yr = a.yr - 2
  LEFT JOIN activity_growth p3 ON p3.geo = a.geo AND p3.ind = a.ind AND p3.yr = a.yr - 3
)"""
)


def with_sql(*ctes: str) -> str:
    """``WITH`` clause over whole CTE blocks, each block named once."""
    seen: list[str] = []
    for block in ctes:
        if block not in seen:
            seen.append(block)
    return "WITH " + ",".join(b.strip().rstrip(",") for b in seen) + "\n"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that summation order does not show."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def member_rows(
    spark: SparkSession, folder: str, min_lines: int = MIN_MEMBER_LINES, cells: DataFrame | None = None
) -> DataFrame:
    """Supplier x category x year rows with their nation; thin rows are suppressed."""
    supplier = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("place"))
    if cells is None:
        cells = shipped_lines(spark, folder).groupBy("l_suppkey", "ind", "yr").agg(*line_sums())
    kept = F.col("lines") >= min_lines
    return cells.join(supplier, cells.l_suppkey == supplier.s_suppkey).select(
        F.col("place").alias("geo"),
        "ind",
        "yr",
        F.col("s_suppkey").alias("member"),
        (~kept).alias("is_suppressed"),
        F.when(kept, F.col("lines").cast("double")).alias("establishments"),
        F.when(kept, F.col("quantity")).alias("employment"),
        F.when(kept, F.col("payroll")).alias("payroll"),
    )


MEMBER_MEASURES = ["establishments", "employment", "payroll"]


def expected_members(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "supplier")
        .groupBy(F.col("s_nationkey").alias("geo"))
        .agg(F.count(F.lit(1)).alias("expected"))
    )


def support_stage(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """Every staged group with its coverage, complete or not."""
    from cellwise.operators.rollup import coverage_rollup

    return coverage_rollup(
        member_rows(spark, folder, cells=cells), expected_members(spark, folder), KEY, "geo", "member",
        MEMBER_MEASURES, "is_suppressed",
    )


SUPPORT_SQL = f"""
member_cells AS (
  SELECT l_suppkey, c_mktsegment AS ind, CAST(year(l_shipdate) AS INT) AS yr,
         count(*) AS lines, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS pay
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  GROUP BY 1, 2, 3
),
member_rows AS (
  SELECT s_nationkey AS geo, ind, yr, s_suppkey AS member, lines < {MIN_MEMBER_LINES} AS is_suppressed,
         CASE WHEN lines >= {MIN_MEMBER_LINES} THEN lines::DOUBLE END AS establishments,
         CASE WHEN lines >= {MIN_MEMBER_LINES} THEN quantity END AS employment,
         CASE WHEN lines >= {MIN_MEMBER_LINES} THEN pay END AS payroll
  FROM member_cells JOIN supplier ON l_suppkey = s_suppkey
),
expected AS (SELECT s_nationkey AS geo, count(*) AS members_expected FROM supplier GROUP BY 1),
support_groups AS (
  SELECT m.geo, m.ind, m.yr, e.members_expected,
         count(DISTINCT member) AS members_observed,
         CAST(count(*) FILTER (WHERE is_suppressed) AS BIGINT) AS members_suppressed,
         CAST(count(*) FILTER (WHERE establishments IS NULL OR employment IS NULL OR payroll IS NULL) AS BIGINT) AS members_missing,
         count(*) AS source_rows,
         sum(establishments) AS s1, sum(employment) AS s2, sum(payroll) AS s3
  FROM member_rows m JOIN expected e ON e.geo = m.geo
  GROUP BY 1, 2, 3, 4
),
support_stage AS (
  SELECT geo, ind, yr, members_expected, members_observed, members_suppressed, members_missing,
         source_rows,
         (members_observed = members_expected AND members_suppressed = 0 AND members_missing = 0) AS is_complete,
         CASE WHEN members_observed = members_expected AND members_suppressed = 0 AND members_missing = 0 THEN s1 END AS establishments,
         CASE WHEN members_observed = members_expected AND members_suppressed = 0 AND members_missing = 0 THEN s2 END AS employment,
         CASE WHEN members_observed = members_expected AND members_suppressed = 0 AND members_missing = 0 THEN s3 END AS payroll
  FROM support_groups
)"""


def control_cells(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """Wide (estimate, margin) pairs per place and year; thin shares are missing."""
    cells = order_cells(spark, folder) if cells is None else cells
    places = cells.groupBy("geo", "yr").agg(
        F.sum("backbone").alias("n"),
        F.sum("customers").cast("double").alias("population_est"),
        (F.round(F.sum("revenue"), 2) / F.sum("backbone")).alias("income_est"),
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in STATUSES],
    )

    def share(s: str):
        seen = F.col(f"n_{s}")
        return F.when(seen >= MIN_CONTROL_ORDERS, 100 * seen / F.col("n"))

    wide = places.withColumns(
        {"finished_pct_est": share("F"), "open_pct_est": share("O"), "pending_pct_est": share("P")}
    )
    return wide.select(
        "geo",
        "yr",
        *[f"{c}_est" for c in CONTROLS],
        *[F.round(F.col(f"{c}_est") / F.sqrt("n"), 6).alias(f"{c}_moe") for c in CONTROLS],
    )


def control_long(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    from cellwise.sources.files import pairs_to_long

    return pairs_to_long(
        control_cells(spark, folder, cells), ["geo", "yr"], {c: (f"{c}_est", f"{c}_moe") for c in CONTROLS}
    )


def control_layer(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    from cellwise.operators.rollup import pivot_controls

    return pivot_controls(
        control_long(spark, folder, cells), ["geo", "yr"], "control_name", CONTROLS, {"estimate": "", "margin": "moe"}
    )


def control_panel(spark: SparkSession, folder: str, cells: DataFrame | None = None) -> DataFrame:
    """Controls with population growth and one-year lags, window by place only."""
    layer = control_layer(spark, folder, cells).select("geo", "yr", *CONTROLS)
    grown = cal.add(layer, ["geo"], "yr", cal.growths({"population": "population_growth"}))
    return cal.add(grown, ["geo"], "yr", cal.lags([*CONTROLS[1:], "population_growth"], (1,)))


def _pct_sql(s: str) -> str:
    return f"CASE WHEN n_{s} >= {MIN_CONTROL_ORDERS} THEN 100 * n_{s}::DOUBLE / n END"


CONTROL_SQL = f"""
control_counts AS (
  SELECT c_nationkey AS geo, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n,
         count(DISTINCT o_custkey)::DOUBLE AS population, round(sum(o_totalprice), 2) / count(*) AS income,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS n_F,
         count(*) FILTER (WHERE o_orderstatus = 'O') AS n_O,
         count(*) FILTER (WHERE o_orderstatus = 'P') AS n_P
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2
),
control_est AS (
  SELECT geo, yr, n, population, income, {_pct_sql("F")} AS finished_pct,
         {_pct_sql("O")} AS open_pct, {_pct_sql("P")} AS pending_pct
  FROM control_counts
),
control_layer AS (
  SELECT geo, yr, {", ".join(CONTROLS)},
         {", ".join(f"round({c} / sqrt(n), 6) AS {c}_moe" for c in CONTROLS)}
  FROM control_est
)"""

CONTROL_PANEL_SQL = (
    CONTROL_SQL
    + f""",
control_growth AS (
  SELECT a.geo, a.yr, {", ".join("a." + c for c in CONTROLS)},
         CASE WHEN p.population > 0 THEN (a.population - p.population) / p.population END AS population_growth
  FROM control_layer a LEFT JOIN control_layer p ON p.geo = a.geo AND p.yr = a.yr - 1
),
control_panel AS (
  SELECT a.*, {", ".join(f"p.{c} AS {c}_lag1" for c in [*CONTROLS[1:], "population_growth"])}
  FROM control_growth a LEFT JOIN control_growth p ON p.geo = a.geo AND p.yr = a.yr - 1
)"""
)


def geo_dim(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with their region and type: one region plays the non-metropolitan type."""
    nation = table(spark, folder, "nation")
    return nation.select(
        F.col("n_nationkey").alias("geo"),
        F.col("n_name").alias("geo_name"),
        F.when(F.col("n_regionkey") == 4, "MICROPOLITAN").otherwise("MSA").alias("geo_type"),
    )


GEO_SQL = """
geo_dim AS (
  SELECT n_nationkey AS geo, n_name AS geo_name,
         CASE WHEN n_regionkey = 4 THEN 'MICROPOLITAN' ELSE 'MSA' END AS geo_type
  FROM nation
)"""

PANEL_MEASURES = [
    "starts", "start_rate", "start_rate_lag1", "start_rate_lag2", "start_rate_lag3",
    "employment", "establishments", "payroll", "average_pay",
    *GROWTHS.values(),
    *[f"{c}_lag{n}" for c, steps in GROWTH_LAGS.items() for n in steps],
    *CONTROLS, "population_growth",
    *[f"{c}_lag1" for c in [*CONTROLS[1:], "population_growth"]],
    "support_establishments", "support_employment", "support_payroll",
]
PANEL_FLAGS = [
    "starts_suppressed", "rate_available", "activity_suppressed", "controls_matched",
    "controls_incomplete", "support_matched", "support_suppressed", "any_suppression",
]


def written(df: DataFrame, label: str, partition: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a Parquet table below the shared folder, so that several readers share its work."""
    from cellwise.session import scratch_path
    from cellwise.sources.sinks import write_table

    path = scratch_path(df.sparkSession, label)
    write_table(df, path, partition)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def analytic_panel(spark: SparkSession, folder: str) -> DataFrame:
    """The layers put together; orders and lines are each counted once, for all layers."""
    from cellwise.operators.panel import integrate

    orders = written(order_cells(spark, folder), "order_cells")
    lines = written(line_cells(spark, folder), "line_cells", ("by_member",))
    return integrate(
        core=start_panel(spark, folder, cells=orders).drop("backbone"),
        growth=activity_panel(spark, folder, cells=lines.filter("NOT by_member")),
        places=geo_dim(spark, folder),
        place_type="MSA",
        controls=control_panel(spark, folder, cells=orders),
        control_fields=CONTROLS,
        support=support_stage(spark, folder, cells=lines.filter("by_member")),
        support_measures=MEMBER_MEASURES,
        years=(1995, 2001),
    )


PANEL_SQL = (
    START_PANEL_SQL + "," + ACTIVITY_PANEL_SQL + "," + CONTROL_PANEL_SQL + "," + SUPPORT_SQL + "," + GEO_SQL
    + f""",
panel AS (
  SELECT b.geo, b.ind, b.yr, g.geo_name,
         b.starts, b.start_rate, b.start_rate_lag1, b.start_rate_lag2, b.start_rate_lag3,
         q.employment, q.establishments, q.payroll, q.average_pay,
         {", ".join("q." + c for c in GROWTHS.values())},
         {", ".join(f"q.{c}_lag{n}" for c, steps in GROWTH_LAGS.items() for n in steps)},
         {", ".join("a." + c for c in CONTROLS)}, a.population_growth,
         {", ".join(f"a.{c}_lag1" for c in [*CONTROLS[1:], "population_growth"])},
         CASE WHEN s.is_complete THEN s.establishments END AS support_establishments,
         CASE WHEN s.is_complete THEN s.employment END AS support_employment,
         CASE WHEN s.is_complete THEN s.payroll END AS support_payroll,
         b.is_suppressed AS starts_suppressed, b.start_rate IS NOT NULL AS rate_available,
         q.is_suppressed AS activity_suppressed,
         a.geo IS NOT NULL AS controls_matched,
         (a.geo IS NULL OR {" OR ".join(f"a.{c} IS NULL" for c in CONTROLS)}) AS controls_incomplete,
         coalesce(s.is_complete, FALSE) AS support_matched,
         coalesce(s.members_suppressed > 0, FALSE) AS support_suppressed,
         s.is_complete AS support_complete
  FROM start_panel b
  JOIN activity_panel q ON q.geo = b.geo AND q.ind = b.ind AND q.yr = b.yr
  JOIN geo_dim g ON g.geo = b.geo
  LEFT JOIN control_panel a ON a.geo = b.geo AND a.yr = b.yr
  LEFT JOIN support_stage s ON s.geo = b.geo AND s.ind = b.ind AND s.yr = b.yr
  WHERE g.geo_type = 'MSA' AND b.yr BETWEEN 1995 AND 2001
),
analytic_panel AS (
  SELECT *, (starts_suppressed OR activity_suppressed OR support_suppressed) AS any_suppression
  FROM panel
)"""
)


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, folder: str, name: str, build, partition: tuple[str, ...] = ()) -> DataFrame:
    """A layer as a Parquet table below the shared folder, written once per application."""
    from cellwise.session import scratch_path
    from cellwise.sources.sinks import write_table

    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        write_table(build(spark, folder), path, partition)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def panel_table(spark: SparkSession, folder: str) -> DataFrame:
    """The integrated panel, partitioned by year."""
    return stored(spark, folder, "panel", analytic_panel, ("yr",))
