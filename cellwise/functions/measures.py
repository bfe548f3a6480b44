"""Parsing of published measures, rates and flags, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rejection reason codes.
REASONS = (
    "invalid_cbsa",
    "invalid_naics",
    "invalid_year",
    "duplicate_key",
    "missing_required_field",
    "invalid_numeric_value",
    "suppressed_value",
    "failed_reference_match",
    "unresolved_geography",
    "unresolved_industry",
    "excluded_ownership",
    "duplicate_standardized_key",
    "incomplete_aggregation",
    "missing_required_measure",
    "missing_required_startup_measure",
    "other",
)

# Published status codes and estimate sentinels.
STATUS_CODES = ("D", "N", "S", "X")
SUPPRESSION_CODES = ("D", "S")
SENTINELS = (-666666666, -999999999, -888888888, -222222222)

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def parse_measure(text: Column) -> Column:
    """Number, or NULL for a status code, a blank or anything that is no plain number."""
    token = F.trim(text)
    return F.when(token.rlike(NUMBER), token.try_cast("double"))


def parse_estimate(text: Column, sentinels: Sequence[int] = SENTINELS) -> Column:
    value = parse_measure(text)
    return F.when(~value.isin([float(s) for s in sentinels]), value)


def parse_margin(text: Column) -> Column:
    value = parse_estimate(text)
    return F.when(value >= 0, value)


def finite(value: Column) -> Column:
    """NULL for NaN and both infinities."""
    number = value.cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def percent_of(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator / denominator * 100)


def growth(current: Column, prior: Column) -> Column:
    return F.when(prior > 0, (current - prior) / prior)


def average_pay(payroll: Column, headcount: Column) -> Column:
    """Half-even rounding to whole units."""
    return F.when(headcount > 0, F.bround(payroll / headcount))


def guarded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.bround(100 * part / whole, 4)).otherwise(F.lit(0.0))


def divide(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def any_null(columns: Sequence[str]) -> Column:
    return F.exists(F.array(*[F.col(c) for c in columns]), lambda x: x.isNull())


def any_code(columns: Sequence[str], codes: Sequence[str] = STATUS_CODES) -> Column:
    values = F.array(*[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in columns])
    return F.exists(values, lambda x: x.isin(list(codes)))


def not_blank(column: Column) -> Column:
    return F.coalesce(F.trim(column), F.lit("")) != ""


def any_not_blank(columns: Sequence[str]) -> Column:
    values = F.array(*[F.coalesce(F.trim(F.col(c)), F.lit("")) for c in columns])
    return F.exists(values, lambda x: x != "")


def flag_json(columns: Sequence[str]) -> Column:
    """JSON object of the non-blank flags in name order, or NULL if all are blank."""
    fields = [F.when(not_blank(F.col(c)), F.trim(F.col(c))).alias(c) for c in sorted(columns)]
    return F.when(any_not_blank(columns), F.to_json(F.struct(*fields)))


def payload_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def invalid_percent(columns: Sequence[str]) -> Column:
    values = F.array(*[F.col(c) for c in columns])
    return F.exists(values, lambda x: (x < 0) | (x > 100))


def joined_notes(conditions: Mapping[str, Column], separator: str = ";") -> Column:
    return F.concat_ws(separator, *[F.when(test, F.lit(note)) for note, test in conditions.items()])


def first_reason(conditions: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Name of the first condition that holds."""
    first_test, first_name = conditions[0]
    chain = F.when(first_test, F.lit(first_name))
    for test, name in conditions[1:]:
        chain = chain.when(test, F.lit(name))
    return chain if otherwise is None else chain.otherwise(F.lit(otherwise))


def missing_ratio_reason(
    numerator: Column, denominator: Column, place_status: Column, category_status: Column
) -> Column:
    """First supported cause of a missing ratio, from the raw text of both sides."""

    def causes(text: Column, role: str) -> list[tuple[Column, str]]:
        token = F.coalesce(F.trim(text), F.lit(""))
        return [
            (token.isin(*SUPPRESSION_CODES), f"{role}_suppressed"),
            (token.isin("", "N", "X") | parse_measure(token).isNull(), f"{role}_missing"),
        ]

    return first_reason(
        [
            (~place_status.eqNullSafe("direct_match"), "geography_mismatch"),
            (
                ~F.coalesce(
                    category_status.isin("directly_comparable", "official_mapping_required"),
                    F.lit(False),
                ),
                "industry_mismatch",
            ),
            *causes(numerator, "numerator"),
            *causes(denominator, "denominator"),
            (parse_measure(denominator) == 0, "denominator_zero"),
        ],
        otherwise="other",
    )


def residual_direction(residual: Column) -> Column:
    return F.when(residual >= 0, "at_or_above_expected").when(residual < 0, "below_expected")


def residual_reading(residual: Column, label: Column) -> Column:
    """Reading of a residual together with the label, where one exists."""
    known = label.isNotNull()
    return (
        F.when(residual.isNull(), "No expected-rate comparison is available for this row.")
        .when(label == 1, "The observed rate is far enough below the expected rate to count as a gap.")
        .when((residual < 0) & known, "The observed rate is below the expected rate, but not a gap.")
        .when(residual < 0, "The observed rate is below the expected rate; no label is available.")
        .when(known, "The observed rate is at or above the expected rate; no gap.")
        .otherwise("The observed rate is at or above the expected rate; no label is available.")
    )
