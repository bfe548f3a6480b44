"""Mapping audits, reject tables, quality metrics and readiness grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M


def mapping_audit(rows: DataFrame, code: str, status: str) -> DataFrame:
    """Distinct codes and rows per mapping status."""
    return (
        rows.groupBy(code, status)
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(status)
        .agg(F.count(F.lit(1)).alias("code_count"), F.sum("n").alias("row_count"))
    )


def rejects(
    rows: DataFrame, stage: str, identity: Sequence[str], reasons: Sequence[tuple[Column, str]]
) -> DataFrame:
    """Rows with a reason, their identity and the whole row as JSON."""
    unknown = sorted({name for _, name in reasons} - set(M.REASONS))
    if unknown:
        raise ValueError(f"Unknown rejection reasons: {unknown}")
    payload = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    return (
        rows.withColumn("reason", M.first_reason(reasons))
        .filter(F.col("reason").isNotNull())
        .select(F.lit(stage).alias("stage"), *identity, "reason", payload.alias("payload"))
    )


def rollup_reasons() -> list[tuple[Column, str]]:
    """Why a staged group is not accepted; missing measures are told from missing members."""
    incomplete = ~F.col("is_complete")
    return [
        (incomplete & (F.col("members_suppressed") > 0), "suppressed_value"),
        (incomplete & (F.col("members_missing") > 0), "missing_required_measure"),
        (incomplete, "incomplete_aggregation"),
    ]


def reject_summary(rejected: DataFrame, by: Sequence[str] = ("stage", "reason")) -> DataFrame:
    return rejected.groupBy(*by).agg(F.count(F.lit(1)).alias("rejected_rows"))


def metrics(rows: DataFrame, table: str, values: Mapping[str, Column], by: Sequence[str] = (), scope: str = "all") -> DataFrame:
    """Long (table, metric, value, scope) rows from one aggregation."""
    wide = rows.groupBy(*by).agg(*[v.cast("double").alias(n) for n, v in values.items()])
    long = wide.unpivot(list(by), list(values), "metric", "value")
    return long.select(
        F.lit(table).alias("table_name"), "metric", "value", F.lit(scope).alias("scope"), *by
    )


def counts_by_dimension(
    rows: DataFrame, dimensions: Mapping[str, Column], measure: str
) -> DataFrame:
    """Counts of ``measure`` values inside every value of every dimension, plus the total.

    Rows are counted once on the full combination; the dimensions are unfolded
    afterwards, on counts instead of rows.
    """
    cells = rows.groupBy(*[d.cast("string").alias(n) for n, d in dimensions.items()], measure).agg(
        F.count(F.lit(1)).alias("n")
    )
    unfolded = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("dimension_value")),
        *[F.struct(F.lit(n).alias("dimension"), F.col(n).alias("dimension_value")) for n in dimensions],
    )
    return (
        cells.select(measure, "n", F.inline(unfolded))
        .groupBy("dimension", "dimension_value", measure)
        .agg(F.sum("n").alias("row_count"))
    )


def share_within(counts: DataFrame, by: Sequence[str], count: str, name: str, digits: int = 2) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum(count).alias("_whole"))
    return counts.join(totals, list(by)).withColumn(
        name, F.bround(100 * F.col(count) / F.col("_whole"), digits)
    ).drop("_whole")


def source_overlap(sources: Mapping[str, DataFrame], code: str) -> DataFrame:
    """Per code the sorted list of sources that have it and whether all do."""
    parts = [
        df.select(F.col(code).alias("code")).distinct().withColumn("source", F.lit(name))
        for name, df in sources.items()
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("code").agg(
        F.count(F.lit(1)).alias("source_count"),
        F.array_join(F.array_sort(F.collect_list("source")), ",").alias("sources"),
    ).withColumn("is_common", F.col("source_count") == len(sources))


def common_codes(overlap: DataFrame) -> DataFrame:
    common = overlap.filter("is_common").select("code")
    if common.isEmpty():
        raise ValueError("No code is common to all sources")
    return common


def readiness_grid(sources: Mapping[str, DataFrame], year: str, first: int, last: int) -> DataFrame:
    """Rows per source and year of the window; a year without rows is blocked."""
    spark = next(iter(sources.values())).sparkSession
    years = spark.range(first, last + 1).select(F.col("id").cast("int").alias("yr"))
    parts = []
    for name, df in sources.items():
        have = df.groupBy(F.col(year).alias("yr")).agg(F.count(F.lit(1)).alias("row_count"))
        parts.append(years.join(have, "yr", "left").withColumn("source", F.lit(name)))
    grid = parts[0]
    for part in parts[1:]:
        grid = grid.unionByName(part)
    rows = F.coalesce("row_count", F.lit(0).cast("bigint"))
    return grid.select(
        "source", "yr", rows.alias("row_count"), F.when(rows > 0, "ready").otherwise("blocked").alias("state")
    )


def vintage_audit(
    rows: DataFrame, source: str, year: str, code: str, target: str, stored: str, expected: Column, status: str
) -> DataFrame:
    """Rows per source and year by status, stored against expected vintage, and code lists.

    Rows collapse to one per code first; the lists are bounded by the classification.
    """
    per_code = rows.groupBy(source, year, code, target, status).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(~F.col(stored).eqNullSafe(expected)).alias("_off")
    )

    def with_status(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(status) == name, F.col("_n"))), F.lit(0).cast("bigint"))

    def listed(values: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(values)), ",")

    return per_code.groupBy(source, year).agg(
        F.sum("_n").alias("row_count"),
        with_status("directly_comparable").alias("direct_rows"),
        with_status("official_mapping_required").alias("mapped_rows"),
        with_status("unresolved").alias("unresolved_rows"),
        F.sum("_off").alias("vintage_mismatches"),
        listed(F.col(target)).alias("retained_codes"),
        listed(F.when(F.col(target).isNull(), F.col(code))).alias("excluded_codes"),
    )
