"""Helpers the corpus operators share."""

from __future__ import annotations

import math
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cellwise.session import freeze

ROWS_PER_SLICE = 50_000
_shipped: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df`` itself, once its cluster has this package, which tasks in Python import.

    Spark's file server hands the archive to every executor, also to later ones.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[2]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/cellwise-tasks", "zip", root, "cellwise")
        context.addPyFile(archive)
        _shipped.add(context.applicationId)
    return df


def utf8_length(text: str | Column) -> Column:
    """Bytes of a text in UTF-8; null counts as none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def column_like(df: DataFrame, name: str, default: str) -> Column:
    """``df[name]``, or a null of type ``default`` where the table has no such column."""
    return F.col(name) if name in df.columns else F.lit(None).cast(default)


def scalar(df: DataFrame):
    """The single value of a one-row, one-column frame."""
    return df.first()[0]


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name (case aside)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def numbered(df: DataFrame, group: str, order: list[str], out: str, rows: int) -> DataFrame:
    """Add ``out``: gapless long positions from 0 inside each ``group``.

    No group is ever sorted in one task: rows are dealt by a hash of ``order`` over slices
    of about ``ROWS_PER_SLICE``, numbered inside (group, slice), and shifted by the rows of
    the group's earlier slices. ``rows`` is the row count, which only sets the number of
    slices. Positions follow (slice, order), so they do not depend on partitioning.
    """
    slices = max(1, math.ceil(rows / ROWS_PER_SLICE))
    cut, before = free_name(df, "slice"), free_name(df, "before")
    dealt = df.withColumn(cut, F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = dealt.groupBy(group, cut).agg(F.count(F.lit(1)).alias(before))
    earlier = Window.partitionBy(group).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn(before, F.coalesce(F.sum(before).over(earlier), F.lit(0)))
    inside = Window.partitionBy(group, cut).orderBy(*order)
    return (
        dealt.withColumn(out, F.row_number().over(inside).cast("long") - 1)
        .join(offsets, [group, cut])
        .withColumn(out, F.col(out) + F.col(before))
        .drop(cut, before)
    )


def partitions_for(total_bytes: int, each: int) -> int:
    """As many partitions as ``total_bytes`` needs at about ``each`` bytes."""
    return max(1, math.ceil(total_bytes / each))


def fields(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items()])


__all__ = ["ROWS_PER_SLICE", "column_like", "fields", "free_name", "freeze", "numbered", "partitions_for", "scalar", "ship", "utf8_length"]
