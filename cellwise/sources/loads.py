"""Idempotent appends, manifests and dimension upserts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame | None, identity: Sequence[str]) -> DataFrame:
    """Incoming rows whose identity is new, each identity once."""
    unique = incoming.dropDuplicates(list(identity))
    if existing is None:
        return unique
    return unique.join(existing.select(*identity), list(identity), "left_anti")


def append_new(incoming: DataFrame, path: str, identity: Sequence[str], existing: DataFrame | None) -> None:
    new_rows(incoming, existing, identity).write.mode("append").parquet(path)


def load_counts(incoming: DataFrame, existing: DataFrame, identity: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows read, inserted and skipped.

    Copies are counted per identity before the join, so the counts come from one
    pass over the incoming rows.
    """
    per_identity = incoming.groupBy(*dict.fromkeys([*identity, *by])).agg(
        F.count(F.lit(1)).alias("copies")
    )
    seen = existing.select(*identity).distinct().withColumn("_seen", F.lit(True))
    return (
        per_identity.join(seen, list(identity), "left")
        .groupBy(*by)
        .agg(
            F.sum("copies").alias("rows_read"),
            F.count_if(F.col("_seen").isNull()).alias("rows_inserted"),
            (F.sum("copies") - F.count_if(F.col("_seen").isNull())).alias("rows_skipped"),
        )
    )


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], version: Column) -> DataFrame:
    """Newest row per natural key; ``version`` must differ between rows of a key."""
    both = existing.unionByName(incoming, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def fingerprint_columns(columns: Sequence[str]) -> list[Column]:
    """Row count and two order-free hashes of whole rows, all mergeable map-side."""
    row_hash = F.xxhash64(*[F.col(c) for c in columns])
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(row_hash).alias("xor_hash"),
        F.sum(row_hash.cast("decimal(38,0)")).alias("sum_hash"),
    ]


def data_manifest(spark: SparkSession, path: str, source: str) -> DataFrame:
    """One row per Parquet file: size, rows and a content fingerprint."""
    data = spark.read.parquet(path)
    return (
        data.select("*", "_metadata.file_name", "_metadata.file_size")
        .groupBy("file_name", "file_size")
        .agg(*fingerprint_columns(data.columns))
        .select(F.lit(source).alias("source"), "*")
    )


def _streamed_digests(files: DataFrame, block: int) -> DataFrame:
    """(path, length, sha256) of (path, length) rows; a task reads a file in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch["path"].to_pylist():
                if path.startswith("file:"):
                    system, name = fs.LocalFileSystem(), path.removeprefix("file:")
                else:
                    system, name = fs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with system.open_input_stream(name) as stream:
                    while data := stream.read(block):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch["path"], batch["length"], pa.array(digests, pa.string())], ["path", "length", "sha256"])

    return files.mapInArrow(run, "path string, length long, sha256 string")


def file_manifest(
    spark: SparkSession, path: str, source: str, glob: str = "*", whole_bytes: int = 1 << 28, block: int = 8 << 20
) -> DataFrame:
    """One row per landed file with its SHA-256.

    Files of up to ``whole_bytes`` are hashed as one value. Larger ones, which may not fit a
    row, are listed without their content and read by tasks in blocks of ``block`` bytes; the
    scan gives each a partition of its own. Files without a byte have no row: Spark's scans
    pass over them.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    small = files.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = _streamed_digests(files.filter(F.col("length") > whole_bytes).select("path", "length"), block)
    return small.unionByName(large).select(
        F.lit(source).alias("source"),
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("file_size"),
        "sha256",
    )


def register_manifest(found: DataFrame, known: DataFrame) -> DataFrame:
    """Manifest rows not yet known by source, name and digest."""
    return found.join(known, ["source", "file_name", "sha256"], "left_anti")
