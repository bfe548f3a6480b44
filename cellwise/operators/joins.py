"""Joins with cardinality contracts, reconciliation and merge audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions import measures as M


def unique_on(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """``df`` with a guard that fails the query if a key occurs twice.

    The window sits on the join keys, so a shuffle join reuses its exchange and
    sort: the contract costs no extra job and no extra shuffle.
    """
    copies = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = f"{name} has duplicate keys on {', '.join(keys)}"
    return (
        df.withColumn("_copies", copies)
        .filter(F.when(F.col("_copies") > 1, F.raise_error(F.lit(message)).cast("boolean")).otherwise(True))
        .drop("_copies")
    )


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> DataFrame:
    """Equi-join whose declared cardinality is enforced while it runs."""
    if validate not in {"one_to_one", "many_to_one", "one_to_many"}:
        raise ValueError(f"Unknown cardinality {validate}")
    if validate in {"one_to_one", "one_to_many"}:
        left = unique_on(left, on, "left side")
    if validate in {"one_to_one", "many_to_one"}:
        right = unique_on(right, on, "right side")
    return left.join(right, list(on), how)


def require_match(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """Fail the query where a lookup left any of ``columns`` empty."""
    empty = M.any_null(columns)
    message = F.lit(f"{name}: a row has no match")
    return df.filter(F.when(empty, F.raise_error(message).cast("boolean")).otherwise(True))


def compare_sides(
    left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str]
) -> DataFrame:
    """Full outer join with the side each key came from and field agreement."""
    a = left.select(*on, F.struct(*fields).alias("_left"))
    b = right.select(*on, F.struct(*fields).alias("_right"))
    side = (
        F.when(F.col("_right").isNull(), "left_only")
        .when(F.col("_left").isNull(), "right_only")
        .otherwise("both")
    )
    return a.join(b, list(on), "full_outer").select(
        *on,
        side.alias("side"),
        *[F.col(f"_left.{f}").eqNullSafe(F.col(f"_right.{f}")).alias(f"{f}_agrees") for f in fields],
    )


def reconciliation(sides: DataFrame, fields: Sequence[str]) -> DataFrame:
    return sides.agg(
        *[F.count_if(F.col("side") == s).alias(s) for s in ("both", "left_only", "right_only")],
        *[
            F.count_if((F.col("side") == "both") & ~F.col(f"{f}_agrees")).alias(f"{f}_differs")
            for f in fields
        ],
    )


def reconciled(left: DataFrame, right: DataFrame, on: Sequence[str], fields: Sequence[str], name: str) -> DataFrame:
    """Both sides joined; any one-sided key or differing field fails the query."""
    a = left.withColumn("_in_left", F.lit(True))
    renamed = right.withColumnsRenamed({f: f"_right_{f}" for f in fields}).withColumn("_in_right", F.lit(True))
    agrees: Column = F.col("_in_left").isNotNull() & F.col("_in_right").isNotNull()
    for f in fields:
        agrees = agrees & F.col(f).eqNullSafe(F.col(f"_right_{f}"))
    joined = a.join(renamed, list(on), "full_outer")
    kept = joined.filter(
        F.when(agrees, True).otherwise(F.raise_error(F.lit(f"{name}: sides disagree")).cast("boolean"))
    )
    return kept.drop("_in_left", "_in_right", *[f"_right_{f}" for f in fields])


def merge_audit(step: str, left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Matched, left-only and right-only keys and match rates of one join step."""
    a = left.select(*on).distinct().withColumn("_l", F.lit(1))
    b = right.select(*on).distinct().withColumn("_r", F.lit(1))
    matched = F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull())
    left_rows, right_rows = F.count("_l"), F.count("_r")
    return (
        a.join(b, list(on), "full_outer")
        .agg(
            F.lit(step).alias("step"),
            left_rows.alias("left_rows"),
            right_rows.alias("right_rows"),
            matched.alias("matched"),
            (left_rows - matched).alias("left_only"),
            (right_rows - matched).alias("right_only"),
        )
        .withColumn("left_match_pct", M.guarded_percent(F.col("matched"), F.col("left_rows")))
        .withColumn("right_match_pct", M.guarded_percent(F.col("matched"), F.col("right_rows")))
    )


def attach_agreeing(
    labels: DataFrame, panel: DataFrame, on: Sequence[str], pairs: Mapping[str, str], tolerance: float = 1e-9
) -> DataFrame:
    """Left join that fails where a label row finds no panel row or values differ."""
    right = panel.select(*on, *pairs.values(), F.lit(True).alias("_found"))
    agrees: Column = F.col("_found").isNotNull()
    for mine, theirs in pairs.items():
        close = F.coalesce(F.abs(F.col(mine) - F.col(theirs)) <= tolerance, F.lit(False))
        agrees = agrees & (close | (F.col(mine).isNull() & F.col(theirs).isNull()))
    joined = checked_join(labels, right, on, "left", "one_to_one")
    return joined.filter(
        F.when(agrees, True).otherwise(F.raise_error(F.lit("labels disagree with the panel")).cast("boolean"))
    ).drop("_found")
