"""Ordered exports, typed marts and the dataset inventory."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def export_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Globally ordered gzip CSV: range-partitioned parts in key order."""
    (
        df.orderBy(*order)
        .write.mode("overwrite")
        .option("header", True)
        .option("compression", "gzip")
        .csv(path)
    )


def write_table(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def enforce_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select and cast the declared columns; an absent one is an error."""
    absent = sorted(set(types) - set(df.columns))
    if absent:
        raise ValueError(f"Mart lacks declared columns: {absent}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])


def bounded_scan(
    df: DataFrame,
    year: str,
    columns: Sequence[str],
    last: int | None = None,
    years: Sequence[int] | None = None,
) -> DataFrame:
    """Pruned scan up to a year, or of the listed years only."""
    if last is not None:
        df = df.filter(F.col(year) <= last)
    if years is not None:
        df = df.filter(F.col(year).isin(list(years)))
    return df.select(*columns)


def inventory(datasets: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Rows, columns and key of every dataset."""
    parts = [
        df.agg(
            F.lit(name).alias("dataset"),
            F.count(F.lit(1)).alias("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
            F.lit(",".join(key)).alias("key_columns"),
        )
        for name, (df, key) in datasets.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def schema_listing(spark: SparkSession, datasets: Mapping[str, DataFrame]) -> DataFrame:
    rows = [
        (name, position, field, kind)
        for name, df in datasets.items()
        for position, (field, kind) in enumerate(df.dtypes)
    ]
    return spark.createDataFrame(rows, "dataset string, position int, column string, type string")


def with_constants(df: DataFrame, renames: Mapping[str, str], constants: Mapping[str, object]) -> DataFrame:
    """Export projection: chosen columns under new names, then constant columns."""
    chosen: list[Column] = [F.col(c).alias(n) for c, n in renames.items()]
    return df.select(*chosen, *[F.lit(v).alias(n) for n, v in constants.items()])
