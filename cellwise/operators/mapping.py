"""Crosswalks, vintage concordances and classification dimensions.

Crosswalk and concordance tables are dimensions. They get a broadcast hint only
after a count shows them small; otherwise the joins shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.functions import codes as C
from cellwise.session import broadcast_checked


def classify_place(rows: DataFrame, code: str, members: DataFrame, groups: DataFrame) -> DataFrame:
    """Status and group of a place code: member through the crosswalk, or a group itself.

    ``members`` has (member, group), ``groups`` has (group).
    """
    crosswalk = members.select(F.col("member").alias("_member"), F.col("group").alias("_via"))
    direct = groups.select(F.col("group").alias("_direct"))
    joined = rows.join(broadcast_checked(crosswalk), F.col(code) == F.col("_member"), "left").join(
        broadcast_checked(direct), F.col(code) == F.col("_direct"), "left"
    )
    status = (
        F.when(F.col("_via").isNotNull(), "crosswalk_required")
        .when(F.col("_direct").isNotNull(), "direct_match")
        .otherwise("unresolved")
    )
    return joined.withColumn("place_status", status).withColumn(
        "place_group", F.coalesce("_via", "_direct")
    ).drop("_member", "_via", "_direct")


def classify_exact(rows: DataFrame, code: str, dimension: DataFrame, dim_code: str) -> DataFrame:
    """Category status by exact match with the classification dimension."""
    known = dimension.select(F.col(dim_code).alias("_known")).distinct()
    joined = rows.join(broadcast_checked(known), F.col(code) == F.col("_known"), "left")
    status = F.when(F.col("_known").isNotNull(), "directly_comparable").otherwise("unresolved")
    return joined.withColumn("category_status", status).drop("_known")


def chain(steps: Sequence[DataFrame]) -> DataFrame:
    """Follow (old, new) edges through all steps; a broken hand-off fails the query."""
    current = steps[0].select("old", "new").distinct()
    for step in steps[1:]:
        edge = step.select(F.col("old").alias("_old"), F.col("new").alias("_new")).distinct()
        current = (
            current.join(broadcast_checked(edge), F.col("new") == F.col("_old"), "left")
            .filter(
                F.when(
                    F.col("_old").isNull(),
                    F.raise_error(F.concat(F.lit("No hand-off for code "), F.col("new"))).cast("boolean"),
                ).otherwise(True)
            )
            .select("old", F.col("_new").alias("new"))
            .distinct()
        )
    return current


def missing_handoffs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Codes a step arrives at but the next step does not continue from."""
    return first.select(F.col("new").alias("code")).distinct().join(
        second.select(F.col("old").alias("code")).distinct(), "code", "left_anti"
    )


def reciprocal(relations: DataFrame) -> DataFrame:
    """Accept a source code only if it has one target and that target has no other source."""
    edges = relations.select("old", "new").distinct()
    forward = edges.groupBy("old").agg(F.count(F.lit(1)).alias("targets"), F.min("new").alias("target"))
    backward = edges.groupBy("new").agg(F.count(F.lit(1)).alias("sources"))
    one_to_one = (F.col("targets") == 1) & (F.col("sources") == 1)
    return forward.join(backward, F.col("target") == F.col("new")).select(
        F.col("old").alias("source_code"),
        F.when(one_to_one & (F.col("old") == F.col("target")), "directly_comparable")
        .when(one_to_one, "official_mapping_required")
        .otherwise("unresolved")
        .alias("category_status"),
        F.when(one_to_one, F.col("target")).alias("target_code"),
    )


def map_codes(rows: DataFrame, code: str, mapping: DataFrame) -> DataFrame:
    """Attach status and target of a :func:`reciprocal` mapping; unknown is unresolved."""
    joined = rows.join(broadcast_checked(mapping), F.col(code) == F.col("source_code"), "left")
    return joined.withColumn(
        "category_status", F.coalesce("category_status", F.lit("unresolved"))
    ).drop("source_code")


def classification(codes: DataFrame, code: str, title: str) -> DataFrame:
    """Valid codes with level, clean title and parent.

    The parent is the longest shorter prefix that is a code itself, else the range
    code that contains the two-digit prefix. Ranges are expanded to their members,
    so both look-ups are equi-joins.
    """
    listed = codes.filter(C.is_valid_code(F.col(code))).groupBy(F.col(code).alias("code")).agg(F.min(title).alias("_title"))
    valid = listed.select(
        "code",
        C.code_level(F.col("code")).alias("level"),
        C.clean_title(F.col("_title")).alias("title"),
        C.title_note(F.col("_title")).alias("note"),
    )
    known = valid.select(F.col("code").alias("parent"))
    prefixes = valid.filter("level > 2").select(
        "code", F.explode(F.sequence(F.lit(2), F.col("level") - 1)).alias("n")
    ).select("code", "n", F.expr("substring(code, 1, n)").alias("parent"))
    longest = prefixes.join(known, "parent").groupBy("code").agg(F.max_by("parent", "n").alias("parent"))
    ranges = known.filter(F.col("parent").contains("-")).select(
        F.col("parent").alias("range_parent"),
        F.explode(
            F.sequence(F.substring("parent", 1, 2).cast("int"), F.substring("parent", 4, 2).cast("int"))
        ).alias("sector"),
    )
    sector = F.when(F.col("level") > 2, F.substring("code", 1, 2).cast("int"))
    return (
        valid.withColumn("sector", sector)
        .join(longest, "code", "left")
        .join(ranges, "sector", "left")
        .select("code", "level", "title", "note", F.coalesce("parent", "range_parent").alias("parent"))
    )


def group_dimension(rows: DataFrame, group: str, name: str, kind: str, state: str) -> DataFrame:
    """One row per group with its type and sorted list of states.

    The list is bounded by the number of states, not by the number of rows.
    """
    return rows.groupBy(group).agg(
        F.max(name).alias(name),
        F.max(kind).alias(kind),
        F.array_join(F.array_sort(F.collect_set(C.normalize_code(F.col(state), 2))), ",").alias("states"),
    )


def member_dimension(rows: DataFrame, group: str, state: str, county: str) -> DataFrame:
    return rows.select(
        F.col(group), C.place_code(F.col(state), F.col(county)).alias("geoid")
    ).distinct()
