"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

Every item starts as a partial partition: its size in one shard, nothing in the others. The
two partial partitions with the largest spread are combined in opposite orders, the largest
shard of one with the smallest of the other, until one is left.

Items are groups of rows that must stay together. Groups above a fixed share of all bytes
are items of their own; there can be at most ``shards * grains`` of these. The rest is dealt
by the group's hash over as many bundles, so the differencing sees a number of items that
the settings bound, whatever the table's size, and each bundle is a small share of a shard.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import freeze, numbered, ship, utf8_length


@dataclass(frozen=True)
class Settings:
    shards: int = 16
    grains: int = 1024


def differencing(sizes: list[int], shards: int) -> list[int]:
    """The shard of every item; ties go by position, so the result is one for one input."""
    if not sizes:
        return []
    # A heap entry: minus the spread, an order number, sums from large to small with the slots
    # they stand for. merges[k] tells how node k joins two nodes slot by slot.
    heap = [(-size, k, ([size] + [0] * (shards - 1), list(range(shards)))) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    merges: dict[int, tuple[int, int, list[int]]] = {}
    count = len(sizes)
    while len(heap) > 1:
        _, a, (large, slots) = heapq.heappop(heap)
        _, b, (other, there) = heapq.heappop(heap)
        facing = [0] * shards
        sums = []
        for k in range(shards):
            facing[slots[k]] = there[shards - 1 - k]
            sums.append((large[k] + other[shards - 1 - k], slots[k]))
        sums.sort(key=lambda x: (-x[0], x[1]))
        least = sums[-1][0]  # only differences matter
        merges[count] = (a, b, facing)
        heapq.heappush(heap, (least - sums[0][0], count, ([x - least for x, _ in sums], [s for _, s in sums])))
        count += 1
    out = [0] * len(sizes)
    todo = [(heap[0][1], list(range(shards)))]
    while todo:
        node, names = todo.pop()  # names[slot of the node] = shard
        if node < len(sizes):
            out[node] = names[0]
            continue
        a, b, facing = merges.pop(node)
        theirs = [0] * shards
        for slot, match in enumerate(facing):
            theirs[match] = names[slot]
        todo += [(a, names), (b, theirs)]
    return out


def _deal(shards: int):
    def deal(key: tuple[pa.Scalar, ...], items: pa.Table) -> pa.Table:
        names, sizes = items["item"].to_pylist(), items["bytes"].to_pylist()
        order = sorted(range(len(names)), key=lambda k: (-sizes[k], names[k]))
        dealt = differencing([sizes[k] for k in order], shards)
        return pa.table({"item": pa.array([names[k] for k in order], pa.string()), "shard": pa.array(dealt, pa.int32())})

    return deal


def balanced_shards(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``.

    ``size`` is the text's UTF-8 bytes plus 1. Rows with equal texts form a group and share
    a shard, so a shard holds at least the largest group; beyond that sizes are near equal
    (law ``bytes``). ``slot`` numbers the rows of a shard from 0 without gaps;
    ``grown_shard`` is null, as the law gives none. Null texts are one group of their own
    (size 1, checksum 0, that of no bytes), apart from empty texts. Repeated rows, also with
    one doc_id, are rows of their own. Other columns of ``docs`` are ignored. An empty table
    gives an empty table.
    """
    key, item = "group_key", "item"
    text = F.col("text").cast("string").cast("binary")
    rows = ship(docs).select(
        "doc_id",
        (utf8_length(text) + 1).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.sha2(text, 256), F.lit("null")).alias(key),
    )
    rows = freeze(rows)
    groups = freeze(rows.groupBy(key).agg(F.sum("size").alias("bytes")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    most = settings.shards * settings.grains
    bundle = F.concat(F.lit("bundle-"), F.pmod(F.xxhash64(key), F.lit(most)).cast("string"))
    alone = F.col("bytes") * most >= total  # at most ``most`` groups
    own = groups.filter(alone).select(F.col(key).alias(item))
    items = groups.select(F.when(alone, F.col(key)).otherwise(bundle).alias("item"), "bytes").groupBy("item").agg(F.sum("bytes").alias("bytes"))
    shards = freeze(items.groupBy(F.lit(0).alias("all_items")).applyInArrow(_deal(settings.shards), "item string, shard int"))
    placed = rows.join(F.broadcast(own), F.col(key) == F.col(item), "left").withColumn(item, F.coalesce(F.col(item), bundle))
    named = placed.join(F.broadcast(shards.withColumnRenamed("item", item)), item).drop(item, key)
    slots = numbered(named, "shard", ["doc_id", "text_crc32", "size"], "slot", count)
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def spread(sizes: np.ndarray, dealt: np.ndarray, shards: int) -> int:
    """Largest minus smallest shard, in bytes."""
    sums = np.bincount(dealt, sizes, shards)
    return int(sums.max() - sums.min())
