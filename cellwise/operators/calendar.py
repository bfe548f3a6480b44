"""Calendar-exact offsets: lags, growth, exact-horizon pairs and transitions.

Every offset is a RANGE frame over the integer year, so a gap in the calendar
yields NULL instead of the nearest row. All expressions of one call share one
window, hence one shuffle and one sort by the panel key. A panel key has at most
one row per year, so no window group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions import measures as M

Offset = Callable[[int], object]
Calendar = Mapping[str, Callable[[Offset], Column]]


def year_frame(keys: Sequence[str], year: str) -> Offset:
    """Window frame of exactly the row ``offset`` years away."""

    def frame(offset: int):
        return Window.partitionBy(*keys).orderBy(year).rangeBetween(offset, offset)

    return frame


def add(df: DataFrame, keys: Sequence[str], year: str, columns: Calendar) -> DataFrame:
    frame = year_frame(keys, year)
    return df.select("*", *[make(frame).alias(name) for name, make in columns.items()])


def _usable(value: Column, suppressed: str | None) -> Column:
    if suppressed is None:
        return value
    return F.when(~F.coalesce(F.col(suppressed), F.lit(False)), value)


def lags(columns: Sequence[str], steps: Sequence[int], suppressed: str | None = None) -> Calendar:
    """``<column>_lag<n>``: the value n years earlier unless that row is suppressed."""

    def lag(column: str, step: int):
        return lambda frame: F.first(_usable(F.col(column), suppressed)).over(frame(-step))

    return {f"{c}_lag{n}": lag(c, n) for c in columns for n in steps}


def growths(columns: Mapping[str, str], suppressed: str | None = None) -> Calendar:
    """Relative change against the prior calendar year, where its value is positive."""

    def change(column: str):
        return lambda frame: M.growth(
            F.col(column), F.first(_usable(F.col(column), suppressed)).over(frame(-1))
        )

    return {name: change(column) for column, name in columns.items()}


def prior_value(column: str, name: str, step: int = 1) -> Calendar:
    """Unconditional value ``step`` years earlier (growth denominators)."""
    return {name: lambda frame: F.first(F.col(column)).over(frame(-step))}


def exact_pairs(
    df: DataFrame,
    keys: Sequence[str],
    year: str,
    horizon: int,
    features: Sequence[str] = (),
    outcomes: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows t with an existing row t + horizon of the same key.

    ``features`` stay at the predictor year; ``outcomes`` maps target-year columns
    to their new names. One window replaces the self-join and both attach joins.
    """
    if horizon < 1:
        raise ValueError("The horizon must be a positive number of calendar years")
    outcomes = dict(outcomes or {})
    frame = year_frame(keys, year)(horizon)
    target = F.struct(
        F.col(year).alias("_target"), *[F.col(c).alias(n) for c, n in outcomes.items()]
    )
    return (
        df.select(
            *keys,
            F.col(year).alias("predictor_year"),
            *features,
            F.first(target).over(frame).alias("_pair"),
        )
        .filter(F.col("_pair").isNotNull())
        .select(
            *keys,
            "predictor_year",
            F.col("_pair._target").alias("target_year"),
            *features,
            *[F.col(f"_pair.{n}").alias(n) for n in outcomes.values()],
        )
    )


def transitions(
    df: DataFrame, keys: Sequence[str], year: str, label: str, role: str, current_role: str
) -> DataFrame:
    """Label changes between exactly consecutive years, counted at ``current_role`` rows.

    Training and validation rows of one key are ordered together, so a validation
    row may follow a training row.
    """
    order = Window.partitionBy(*keys).orderBy(year)
    state = lambda c: F.when(c == 1, "gap").otherwise("non_gap")
    return (
        df.select(
            *keys,
            year,
            label,
            role,
            F.lag(year).over(order).alias("prior_year"),
            F.lag(label).over(order).alias("prior_label"),
        )
        .filter((F.col(role) == current_role) & (F.col(year) - F.col("prior_year") == 1))
        .withColumn("transition", F.concat_ws("_to_", state(F.col("prior_label")), state(F.col(label))))
    )
