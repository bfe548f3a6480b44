"""Landed source files: string scans, contracts on the header and fields, extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellwise.functions import codes as C


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV with a header, every value kept as text; no schema inference pass."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    if columns is not None:
        reader = reader.schema(string_schema(columns)).option("enforceSchema", False)
    return reader.csv(path)


def require_columns(df: DataFrame, columns: Sequence[str], dataset: str = "source") -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{dataset} lacks required columns: {missing}")
    return df


def require_rows(df: DataFrame, dataset: str = "source") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{dataset} has no rows")
    return df


def is_year(column: Column) -> Column:
    return F.coalesce(F.trim(column).rlike("^[0-9]+$"), F.lit(False))


def field_failures(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Row count and number of rows failing each rule, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()],
    )


def route(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Split rows into those that pass every rule and rejects with the first broken rule."""
    reason = F.coalesce(
        *[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]
    )
    marked = df.withColumn("reason", reason)
    return (
        marked.filter(F.col("reason").isNull()).drop("reason"),
        marked.filter(F.col("reason").isNotNull()),
    )


def extract_slice(
    df: DataFrame, year: Column, first: int, last: int, category: Column | None = None, value: str | None = None
) -> DataFrame:
    keep = year.between(first, last)
    if category is not None:
        keep = keep & (category == value)
    return df.filter(keep)


def extract_counts(df: DataFrame, selected: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), F.count_if(selected).alias("rows_selected")
    )


def is_member_area(code: Column) -> Column:
    """Five digits that name neither a state total nor an unknown area."""
    return code.rlike("^[0-9]{5}$") & ~F.substring(code, 3, 3).isin("000", "999")


def member_extract(
    df: DataFrame,
    area: str,
    owner: tuple[str, str],
    size: tuple[str, str],
    period: tuple[str, str],
    category: str,
    categories: Sequence[str],
    renamed: Mapping[str, str],
) -> DataFrame:
    """Member areas of one owner, size and period; a renamed field keeps its new name."""
    keep = (
        is_member_area(F.col(area))
        & (F.col(owner[0]) == owner[1])
        & (F.col(size[0]) == size[1])
        & (F.col(period[0]) == period[1])
        & F.col(category).isin(list(categories))
    )
    merged = {
        new: F.coalesce(F.col(new), F.col(old)) if new in df.columns else F.col(old)
        for new, old in renamed.items()
    }
    return df.filter(keep).withColumns(merged).drop(*[o for o in renamed.values() if o not in renamed])


def pairs_to_long(
    df: DataFrame, keys: Sequence[str], concepts: Mapping[str, tuple[str, str]]
) -> DataFrame:
    """(estimate, margin) column pairs to one row per concept."""
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("control_name"),
                F.col(estimate).alias("estimate"),
                F.col(margin).alias("margin"),
            )
            for name, (estimate, margin) in concepts.items()
        ]
    )
    return df.select(*keys, F.inline(rows))


def normalised_flags(df: DataFrame, flags: Sequence[str], state: str, county: str) -> DataFrame:
    return df.withColumns(
        {
            **{f: F.coalesce(F.trim(F.col(f)), F.lit("")) for f in flags},
            "geoid": C.place_code(F.col(state), F.col(county)),
        }
    )
