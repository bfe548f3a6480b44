"""Member-to-group roll-ups that stay empty unless every member is present."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M


def coverage_rollup(
    members: DataFrame,
    expected: DataFrame,
    keys: Sequence[str],
    group: str,
    member: str,
    measures: Sequence[str],
    suppressed: str,
    require_measures: bool = True,
) -> DataFrame:
    """Sum measures per key where all expected members are observed and unsuppressed.

    ``expected`` has (group, expected). Rows of one member are collapsed first, so
    the distinct-member count needs no second distinct pass and a hot group is
    reduced map-side.
    """
    per_member = members.groupBy(*keys, member).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col(suppressed)).alias("_suppressed"),
        F.count_if(M.any_null(measures)).alias("_missing"),
        *[F.sum(m).alias(m) for m in measures],
    )
    totals = per_member.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members_observed"),
        F.sum("_suppressed").alias("members_suppressed"),
        F.sum("_missing").alias("members_missing"),
        F.sum("_rows").alias("source_rows"),
        *[F.sum(m).alias(f"_sum_{m}") for m in measures],
    )
    complete = (
        (F.col("members_expected") > 0)
        & (F.col("members_observed") == F.col("members_expected"))
        & (F.col("members_suppressed") == 0)
    )
    if require_measures:
        complete = complete & (F.col("members_missing") == 0)
    return (
        totals.join(expected.withColumnRenamed("expected", "members_expected"), group, "left")
        .withColumn("members_expected", F.coalesce("members_expected", F.lit(0).cast("bigint")))
        .withColumn("is_complete", complete)
        .select(
            *keys,
            "members_expected",
            "members_observed",
            "members_suppressed",
            "members_missing",
            "source_rows",
            "is_complete",
            *[F.when(F.col("is_complete"), F.col(f"_sum_{m}")).alias(m) for m in measures],
        )
    )


def lineage(rows: DataFrame, keys: Sequence[str], source_id: str) -> DataFrame:
    """Which source rows fed a cell, as rows: a list per cell could hold most of the table."""
    return rows.select(*keys, F.col(source_id).alias("source_id"))


def pivot_controls(
    long: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], values: Mapping[str, str]
) -> DataFrame:
    """One row per key, ``<control>`` and ``<control>_<suffix>`` columns, fixed control list.

    Conditional maxima keep this a single hash aggregation; a key has one row per
    control.
    """
    cells = []
    for control in names:
        for column, suffix in values.items():
            label = control if not suffix else f"{control}_{suffix}"
            cells.append(F.max(F.when(F.col(name) == control, F.col(column))).alias(label))
    return long.groupBy(*keys).agg(
        *cells, F.count(F.lit(1)).alias("source_rows"), F.count_distinct(name).alias("controls_present")
    )
