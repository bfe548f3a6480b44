"""Incremental ingest of landed files: each source row is stored once."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cellwise.functions.codes import row_identifier
from cellwise.sources.files import string_schema
from cellwise.sources.loads import new_rows

# The setting and the class of Spark's state store on disk.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source_stream(spark: SparkSession, path: str, columns: Sequence[str], files_per_batch: int | None = None) -> DataFrame:
    """New CSV files of a folder, every value text."""
    reader = spark.readStream.schema(string_schema(columns)).option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(path)


def start_ingest(
    stream: DataFrame, target: str, checkpoint: str, tag: str, identity: Sequence[str], prune: str | None = None
) -> StreamingQuery:
    """Append rows whose identifier the target does not hold yet.

    Identifiers that this checkpoint's stream has seen are keyed state (RocksDB, dealt by
    identifier), so a batch reads what it brings and nothing its own stream has stored,
    however many batches went before. Only rows that other checkpoints stored are compared
    by a join, and with ``prune`` of those only the batch's range of that column.

    A batch writes its own folder with overwrite, so a batch that runs again after a
    failure replaces itself. Batch numbers belong to one checkpoint; its digest is
    part of the folder name, so a second stream cannot overwrite the first.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    spark = stream.sparkSession
    keyed = stream.withColumn("source_row_id", row_identifier(tag, identity))
    stored_schema = T.StructType(
        [*keyed.schema.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())]
    )
    spark.createDataFrame([], keyed.schema).write.mode("overwrite").parquet(f"{target}/run=start/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        fresh = batch
        others = batch.sparkSession.read.schema(stored_schema).parquet(target).filter(~F.col("run").isin(run, "start"))
        if others.select("run").limit(1).count():
            fresh = batch = batch.persist()  # the range and the join take the state's rows once
            if prune is not None:
                low, high = batch.agg(F.min(prune), F.max(prune)).first()
                others = others.filter(F.col(prune).between(low, high))
            fresh = new_rows(batch, others, ["source_row_id"])
        fresh.write.mode("overwrite").parquet(f"{target}/run={run}/batch={number}")
        batch.unpersist()

    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:  # a query keeps the settings it was started with
        return (
            keyed.dropDuplicates(["source_row_id"]).writeStream.foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        spark.conf.set(STATE_STORE, before)
