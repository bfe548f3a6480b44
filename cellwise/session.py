"""Session helpers: table access, durable lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine (unit tests, a laptop) that names none gets a scratch
    folder; on a cluster that would be one machine's disk, so there it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("Set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="cellwise-"))
    return context.getCheckpointDir()


def freeze(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the files.

    Used where later steps must see one fixed set of rows (slice numbers, model
    scores). The files outlive executors, so a lost executor costs a re-read.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def broadcast_checked(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to hold at most ``max_rows`` rows.

    A larger side is returned without a hint, so Spark shuffles both sides (with
    the adaptive skew split) instead.
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
