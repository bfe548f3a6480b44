"""Incremental ingest: overlap between files and a restarted stream store rows once."""

from pyspark.sql import functions as F

from cellwise.streaming.ingest import source_stream, start_ingest

COLUMNS = ["year", "k", "v"]


def land(spark, path, rows):
    spark.createDataFrame(rows, "year string, k string, v string").coalesce(1).write.mode("append").option("header", True).csv(path)


def run(spark, landing, target, checkpoint):
    start_ingest(source_stream(spark, landing, COLUMNS), target, checkpoint, "t", ["year", "k"], prune="year").awaitTermination()
    return sorted((r.year, r.k, r.v) for r in spark.read.parquet(target).collect())


def test_overlap_and_restart(spark, tmp_path):
    landing, target = str(tmp_path / "landing"), str(tmp_path / "target")
    land(spark, landing, [("2020", "a", "1"), ("2020", "a", "1"), ("2021", "b", "D")])
    first = run(spark, landing, target, str(tmp_path / "one"))
    assert first == [("2020", "a", "1"), ("2021", "b", "D")]
    land(spark, landing, [("2021", "b", "D"), ("2022", "c", "3")])
    second = run(spark, landing, target, str(tmp_path / "one"))
    assert second == [*first, ("2022", "c", "3")]
    # A new checkpoint reads every file again; stored rows stay as they are.
    assert run(spark, landing, target, str(tmp_path / "two")) == second
    stored = spark.read.parquet(target)
    assert stored.groupBy("source_row_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def test_a_batch_does_not_read_what_its_stream_stored(spark, tmp_path):
    """The keyed state alone tells which rows are new: batches count their own files only."""
    landing, target, checkpoint = (str(tmp_path / name) for name in ("landing", "target", "one"))
    for n in range(3):
        land(spark, landing, [("2020", f"k{i}", "1") for i in range(100 * (n + 1))])
        started = start_ingest(source_stream(spark, landing, COLUMNS), target, checkpoint, "t", ["year", "k"])
        started.awaitTermination()
        rows = {r.batch: r["count"] for r in spark.read.parquet(target).groupBy("batch").count().collect()}
        assert rows == {batch: 100 for batch in range(n + 1)}
        assert started.lastProgress["numInputRows"] == 100 * (n + 1)
        assert started.lastProgress["stateOperators"][0]["numRowsTotal"] == 100 * (n + 1)
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
