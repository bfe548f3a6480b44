"""Connected components of a link table, by union-find in tasks and star contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import freeze, ship


def find(parent: dict, x):
    """Root of ``x``, halving the path on the way; the root is the smallest id."""
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent.setdefault(up, up)
        x = parent[x]
    return x


def union(parent: dict, a, b) -> bool:
    a, b = find(parent, a), find(parent, b)
    parent[max(a, b)] = min(a, b)
    return a != b


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one partition: every node with its root."""
    parent: dict[int, int] = {}
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            union(parent, a, b)
    pairs = [(x, find(parent, x)) for x in list(parent)]
    pairs = [(x, r) for x, r in pairs if x != r]
    for k in range(0, len(pairs), 100_000):
        part = pairs[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["a", "b"])


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest id reachable over ``links`` (a, b), for every linked node.

    Links are contracted by union-find inside each partition, then large-star and
    small-star steps run until the links stop changing; both keep components as they are
    and end in stars on the smallest ids. Each step is checkpointed. Ids of hubs meet only
    in ``min`` aggregates, which combine before the shuffle, and in joins that adaptive
    execution can split. Null ids are ignored; no links give no rows.
    """
    clean = ship(links).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    now = freeze(clean.mapInArrow(_contract, "a long, b long").distinct())
    seen = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        seen, now = state, freeze(_stars(now))
