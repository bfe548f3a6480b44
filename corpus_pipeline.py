"""A corpus from raw documents to packed batches: STAGES in order, each written and read again.

Every stage but the last returns the columns it was given. Rows that share a doc_id count as
one document: what removes one of them removes all, and of equal rows one stays. Rows with a
null doc_id are judged by their text as all others are: in place of the id stands a negative
hash of the text, so those with equal texts are one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import decontam, neardup, packing, quality, suffixes
from cellwise.llm.common import free_name, freeze
from cellwise.session import broadcast_checked, scratch_path, table


def _key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseOR(F.lit(-(1 << 63))))


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with an id for every row."""
    return docs.select(_key().alias("doc_id"), "text")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without those of the given ids; a short list is broadcast, a long one shuffled."""
    key = free_name(docs, "key")
    gone = freeze(ids.select(F.col("doc_id").alias(key)).distinct())
    return docs.withColumn(key, _key()).join(broadcast_checked(gone), key, "left_anti").select(docs.columns)


def _distinct_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with equal rows once. Only rows whose id occurs several times are compared."""
    key = free_name(docs, "key")
    keyed = docs.withColumn(key, _key())
    several = freeze(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(key))
    if not several.limit(1).count():
        return docs
    ids = broadcast_checked(several)
    return keyed.join(ids, key, "left_anti").select(docs.columns).unionByName(keyed.join(ids, key, "left_semi").select(docs.columns).distinct())


#: Near copies from a similarity of 0.8 on, of five-word shingles (op10 alone links from 0.85 on).
#: A pair at exactly 0.8 misses all bands with probability (1 - 0.8**5)**36 = 6e-7.
NEAR = neardup.Settings(percent=80, bands=36)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is fitted on these documents."""
    scored = quality.classify(_named(docs), table(spark, sf_dir, "labels"))
    return _without(docs, scored.filter("predicted = 0"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (NEAR) the document with the least doc_id stays, of equal rows one."""
    return _distinct_rows(_without(docs, neardup.near_duplicates(_named(docs), NEAR).filter("NOT kept")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings met in a smaller document are cut out; a document left with nothing goes.

    n_chars, where the table has it, follows the text. Documents without text stay.
    """
    had = free_name(docs, "had_text")
    marked = docs.withColumn(had, F.coalesce(F.octet_length("text") > 0, F.lit(False)))
    left = suffixes.remove_repeats(marked, rewrite=True).filter(~F.col(had) | (F.octet_length("text") > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(kind)))
    return left.select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words stand in benchmark windows go."""
    found = decontam.contamination(_named(docs), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The classifier and the signatures have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
