"""Data-quality and leakage contracts; each returns (name, dataset, status, observed, expected).

Row checks of one dataset share a single aggregation pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "name string, dataset string, status string, observed string, expected string"


def _rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, RESULT)


def required_columns(df: DataFrame, columns: Sequence[str], dataset: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    return _rows(
        df, [("required_columns", dataset, "fail" if missing else "pass", ",".join(missing), "none missing")]
    )


def forbidden_columns(df: DataFrame, names: Sequence[str] = (), fragments: Sequence[str] = (), dataset: str = "panel") -> DataFrame:
    """Leakage by exact name or by a fragment of the lower-cased name."""
    found = sorted(
        c for c in df.columns if c in names or any(part in c.lower() for part in fragments)
    )
    return _rows(df, [("forbidden_columns", dataset, "fail" if found else "pass", ",".join(found), "none present")])


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def unique_key(df: DataFrame, keys: Sequence[str], dataset: str) -> DataFrame:
    groups = duplicates(df, keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.select(
        F.lit("unique_key").alias("name"),
        F.lit(dataset).alias("dataset"),
        F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"),
        F.col("n").cast("string").alias("observed"),
        F.lit("0").alias("expected"),
    )


def row_checks(df: DataFrame, invalid: Mapping[str, Column], dataset: str) -> DataFrame:
    """One check per named condition: the number of rows where it holds must be zero."""
    wide = df.agg(*[F.count_if(F.coalesce(test, F.lit(False))).alias(name) for name, test in invalid.items()])
    long = wide.unpivot([], list(invalid), "name", "n")
    return long.select(
        "name",
        F.lit(dataset).alias("dataset"),
        F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"),
        F.col("n").cast("string").alias("observed"),
        F.lit("0").alias("expected"),
    )


def value_checks(df: DataFrame, expected: Mapping[str, tuple[Column, object]], dataset: str) -> DataFrame:
    """One check per named aggregate that must equal an expected value."""
    parts = []
    for name, (aggregate, want) in expected.items():
        text = F.coalesce(aggregate.cast("string"), F.lit("null"))
        parts.append(
            F.struct(
                F.lit(name).alias("name"), F.lit(dataset).alias("dataset"),
                F.when(text == str(want), "pass").otherwise("fail").alias("status"),
                text.alias("observed"), F.lit(str(want)).alias("expected"),
            )
        )
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c"))


# --- conditions that mark a row invalid


def outside_years(year: str, first: int, last: int) -> Column:
    return F.col(year).isNull() | ~F.col(year).between(first, last)


def negative(columns: Sequence[str]) -> dict[str, Column]:
    return {f"nonnegative_{c}": F.col(c) < 0 for c in columns}


def outside_percent(columns: Sequence[str]) -> dict[str, Column]:
    return {f"percentage_{c}": (F.col(c) < 0) | (F.col(c) > 100) for c in columns}


def not_probability(columns: Sequence[str]) -> dict[str, Column]:
    return {
        f"probability_{c}": F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1) for c in columns
    }


def not_binary(column: str) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(0, 1)


def off_horizon(predictor: str, target: str, horizon: int) -> Column:
    return F.col(target) != F.col(predictor) + horizon


def null_in(columns: Sequence[str]) -> dict[str, Column]:
    return {f"present_{c}": F.col(c).isNull() for c in columns}


def flag_mismatch(flag: Column, value: str) -> Column:
    """A suppression flag must hold exactly where the metric is empty."""
    return flag != F.col(value).isNull()


def pair_checks(
    pairs: DataFrame, keys: Sequence[str], horizon: int, last_target: int, label: str, dataset: str
) -> DataFrame:
    """Exact horizon, development boundary, binary label and unique pairs."""
    conditions = {
        "exact_horizon": off_horizon("predictor_year", "target_year", horizon),
        "development_boundary": F.col("target_year") > last_target,
        "binary_label": not_binary(label),
    }
    return row_checks(pairs, conditions, dataset).unionByName(unique_key(pairs, keys, dataset))


def scoring_input_checks(df: DataFrame, keys: Sequence[str], label: str, scores: Sequence[str], dataset: str) -> DataFrame:
    """Inputs of bootstrap, decision and benchmark operators."""
    conditions = {"binary_label": not_binary(label), **not_probability(scores), **null_in(keys)}
    both = value_checks(df, {"both_classes": (F.count_distinct(label), 2)}, dataset)
    return row_checks(df, conditions, dataset).unionByName(both).unionByName(unique_key(df, keys, dataset))


def reconciled_metric(stored: DataFrame, fresh: DataFrame, on: Sequence[str], metric: str, tolerance: float, dataset: str) -> DataFrame:
    """Stored metric values must equal recomputed ones within a tolerance."""
    joined = stored.select(*on, F.col(metric).alias("_a")).join(
        fresh.select(*on, F.col(metric).alias("_b")), list(on), "full_outer"
    )
    differs = F.abs(F.col("_a") - F.col("_b")) > tolerance
    one_sided = F.col("_a").isNull() != F.col("_b").isNull()
    return row_checks(joined, {f"reconciled_{metric}": differs | one_sided}, dataset)


def contiguous(df: DataFrame, year: str, dataset: str) -> DataFrame:
    """The distinct years must form one unbroken sequence."""
    span = F.max(year) - F.min(year) + 1 - F.count_distinct(year)
    return value_checks(df, {"year_sequence": (span, 0)}, dataset)


def enforce(results: DataFrame) -> None:
    """Raise if any check failed; the message holds the failing names only."""
    failed = [r.name for r in results.filter("status <> 'pass'").select("name").limit(50).collect()]
    if failed:
        raise ValueError(f"Failed checks: {sorted(failed)}")
