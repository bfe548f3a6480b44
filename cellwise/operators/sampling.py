"""Deterministic samples and splits that do not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.codes import hash_bucket


def seeded_order(keys: Sequence[str], seed: int) -> Column:
    """MD5 of seed and keys: the same order on every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def seeded_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """Exactly n rows (all if fewer) by hash order; a distributed top-n, not a full sort."""
    return df.orderBy(seeded_order(keys, seed), *keys).limit(n)


def group_split(df: DataFrame, group: str, test_fraction: float = 0.2) -> DataFrame:
    """Role of every group from a SHA-256 bucket."""
    if not 0 < test_fraction < 1:
        raise ValueError("test_fraction must be between zero and one")
    limit = int(test_fraction * 10_000)
    bucket = hash_bucket(F.col(group).cast("string"))
    groups = df.select(group).distinct().filter(F.col(group).isNotNull())
    return groups.withColumn("hash_bucket", bucket).withColumn(
        "role", F.when(F.col("hash_bucket") < limit, "test").otherwise("train")
    )


def with_group_role(df: DataFrame, group: str, test_fraction: float = 0.2) -> DataFrame:
    """The same role straight on rows: a pure expression, no join."""
    limit = int(test_fraction * 10_000)
    bucket = hash_bucket(F.col(group).cast("string"))
    return df.withColumn("role", F.when(bucket < limit, "test").otherwise("train"))


def overlapping_groups(split: DataFrame, group: str, role: str = "role") -> DataFrame:
    """Groups found in more than one role; must be empty."""
    return split.groupBy(group).agg(F.min(role).alias("a"), F.max(role).alias("b")).filter("a <> b").select(group)
