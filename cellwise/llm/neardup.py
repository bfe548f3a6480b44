"""Near-duplicates by SuperMinHash: signatures, banding, verification on full sets, grouping.

SuperMinHash draws, for every element, one random permutation of the signature positions;
the element's value at its j-th position is j plus a uniform fraction. A position keeps the
least value. As values of step j are at least j, a document is finished once all positions
hold a value of an earlier step: the early stop. The steps run here over all elements of
many documents at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.llm import text as X
from cellwise.llm.common import freeze, ship
from cellwise.llm.components import components
from cellwise.session import broadcast_checked

_UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Settings:
    """``words`` a shingle; ``percent`` least similarity; ``bands`` of ``rows`` positions.

    A pair at exactly 0.85 misses all bands with probability (1 - 0.85**5)**24 = 8e-7.
    """

    words: int = 5
    percent: int = 85
    bands: int = 24
    rows: int = 5
    hubs: int = 4  # rounds of pairing with a bucket's hub, at most


def superminhash(elements: np.ndarray, owner: np.ndarray, owners: int, size: int) -> np.ndarray:
    """Signatures (owners x size) of sets given as distinct 64-bit elements with their owner."""
    signature = np.full(owners * size, _UNSET)
    live, owner = elements, owner.astype(np.int64)
    order: np.ndarray | None = None
    for step in range(size):
        if not len(live):
            break
        drawn = X.mix(live + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = step + (((drawn & np.uint64(0xFFFFFF)) * np.uint64(size - step)) >> np.uint64(24)).astype(np.int64)
        value = (np.uint64(step) << np.uint64(40)) | (drawn >> np.uint64(24))
        row = np.arange(len(live))
        position = pick if order is None else order[row, pick].astype(np.int64)
        np.minimum.at(signature, owner * size + position, value)
        done = signature.reshape(owners, size).max(axis=1) < (np.uint64(step + 1) << np.uint64(40))
        keep = np.flatnonzero(~done[owner])
        live, owner, pick = live[keep], owner[keep], pick[keep]
        if order is None:
            order = np.tile(np.arange(size, dtype=np.uint16 if size > 256 else np.uint8), (len(keep), 1))
        else:
            order = order[keep]
        order[np.arange(len(keep)), pick] = order[:, step]
    return signature.reshape(owners, size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    hashes, counts = X.hash_words(data, offsets, X.BLANK_WORDS)
    ends = np.cumsum(counts)
    grams = X.gram_hashes(hashes, words)
    sets = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= words:
            found = np.sort(grams[end - n : end - words + 1])
            sets.append(found[np.append(True, found[1:] != found[:-1])])
        elif n:
            sets.append(X.gram_hashes(hashes[end - n : end], n) ^ np.uint64(n))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _signing(settings: Settings):
    size = settings.bands * settings.rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch["text"])
            for a, b in X.runs(offsets):
                sets = shingle_sets(data, offsets[a : b + 1], settings.words)
                sizes = np.array([len(s) for s in sets])
                owner = np.repeat(np.arange(b - a), sizes)
                signature = superminhash(np.concatenate(sets), owner, b - a, size)
                keys = np.empty((b - a, settings.bands), np.uint64)
                for k in range(settings.bands):
                    part = signature[:, k * settings.rows : (k + 1) * settings.rows]
                    keys[:, k] = X.gram_hashes(X.mix(part.ravel() + np.uint64(k)), settings.rows)[:: settings.rows]
                flat = pa.array(keys.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(a, b - a),
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * settings.bands, pa.int32()), flat),
                    ],
                    ["doc_id", "n_shingles", "set_digest", "bands"],
                )

    return sign


def signatures(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, set_digest (of the full set) and bands (one key a band)."""
    schema = "doc_id long, n_shingles long, set_digest binary, bands array<long>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_signing(settings), schema)


def _sets_of(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch["text"])
            for a, b in X.runs(offsets):
                found = shingle_sets(data, offsets[a : b + 1], words)
                at = np.append(0, np.cumsum([len(s) for s in found]))
                values = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)],
                    ["id", "shingles"],
                )

    return sets


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, shingles) of the documents listed in ``ids`` (id), each set once."""
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(
        broadcast_checked(ids.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi"
    )
    return chosen.mapInArrow(_sets_of(words), "id long, shingles array<long>").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("left_set")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("right_set")), "b")
        .withColumn("shared", F.size(F.array_intersect("left_set", "right_set")))
        .withColumn("whole", F.size("left_set") + F.size("right_set") - F.col("shared"))
    )
    return both.filter(100 * F.col("shared") >= percent * F.col("whole")).select("a", "b")


def _fitting(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) whose set sizes (n, other_n) alone do not rule out the similarity."""
    return pairs.filter(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _labelled(met: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, n, component) of the buckets that still hold several components, with the largest of them."""
    rows = met.join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    counts = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
    several = counts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("members"), F.max(F.struct("k", "component")).alias("main")).filter("parts > 1")
    return rows.join(several.select("bucket", "members", F.col("main.component").alias("main")), "bucket")


def _hubs(rows: DataFrame) -> DataFrame:
    """Of each bucket the member that shares most with others: (bucket, hub, hub_n, hub_component).

    A text that many others were made from meets them in its largest buckets, so it has the
    largest sum of bucket sizes; ties go to the smaller id.
    """
    shared = rows.groupBy("id").agg(F.sum("members").alias("shared"))
    best = rows.join(shared, "id").groupBy("bucket").agg(F.max(F.struct("shared", F.negative("id").alias("back"), "n", "component")).alias("hub"))
    return best.select("bucket", F.negative("hub.back").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.component").alias("hub_component"))


def _rest(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components among the members of ``rows`` that can be similar enough.

    The shingles of a set are put in one order, rare ones first. Sets of n and m shingles that
    are similar enough share one among the first n - ceil(t n) + 1 of each; after the first
    they share, enough must be left of both. Shingles that one set alone has take up places
    there and meet nothing, so of many copies with changes of their own those that are too
    far from each other hardly meet.
    """
    members = rows.select("id", "n", "component").distinct()
    shingles = sets.join(members, "id").select("id", "n", "component", F.explode("shingles").alias("shingle"))
    counts = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("id").orderBy("df", "shingle")
    placed = shingles.join(counts, "shingle").withColumn("place", F.row_number().over(order))
    first = freeze(placed.filter(f"df > 1 AND place <= n - ceil({percent} * n / 100) + 1").select("shingle", "id", "n", "component", (F.col("n") - F.col("place") + 1).alias("left")))
    other = first.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "component", "left")])
    enough = f"(100 + {percent}) * least(left, other_left) >= {percent} * (n + other_n) AND 100 * least(n, other_n) >= {percent} * greatest(n, other_n)"
    pairs = first.join(other, (first["shingle"] == other["shingle"]) & F.expr(f"id < other_id AND component <> other_component AND {enough}"))
    return pairs.select(F.col("id").alias("a"), F.col("other_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    1. Sign every document; documents with equal shingle sets form a class, whose least
       doc_id stands for it (aggregated before the shuffle, so groups of copies are cheap).
    2. In each bucket of a band, every member is paired with the bucket's least id, and the
       pairs are verified on full sets. Verified links give components.
    3. In buckets that still hold several components, every member is paired with the hub,
       the member that shares most with others, if that is in another component. This is
       repeated, each time without the hubs used so far, while it joins components.
    4. Among the members of buckets that still hold several components, all pairs of different
       components are verified that share a shingle where similar sets must share one.
    Skipped pairs are connected already, were verified before, or cannot be similar enough.
    The rows of steps 2 and 3 follow the members of buckets, those of step 4 their shingles
    and the pairs that rare shingles bring together.

    Null or empty texts: no shingles, own component. Repeated rows with one doc_id are
    listed as often as they occur; a doc_id names one text. A null doc_id: component_id null, kept true. Other
    columns of ``docs`` are ignored.
    """
    signed = freeze(signatures(ship(docs), settings))
    filled = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = freeze(filled.groupBy("set_digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("members")))
    buckets = classes.select("id", "n", F.explode("bands").alias("bucket"))
    crowded = buckets.groupBy("bucket").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    met = freeze(buckets.join(crowded, "bucket").select("bucket", "id", "n", "least"))

    sizes = classes.select(F.col("id").alias("least"), F.col("n").alias("least_n"))
    pairs = met.filter("id <> least").select(F.col("least"), "id", "n").distinct().join(sizes, "least")
    pairs = freeze(pairs.filter(f"100 * least(n, least_n) >= {settings.percent} * greatest(n, least_n)").select(F.col("least").alias("a"), F.col("id").alias("b")))
    sets = freeze(full_sets(docs, met.select("id").distinct(), settings.words))
    links = freeze(verified(pairs, sets, settings.percent))
    first = components(links)

    every, left = first, met.filter("id <> least").select("bucket", "id", "n")
    for _ in range(settings.hubs):
        rows = freeze(_labelled(left, every))
        hubs = freeze(_hubs(rows))
        pairs = rows.join(hubs, "bucket").filter("component <> hub_component").select(F.col("hub").alias("a"), F.col("id").alias("b"), "n", F.col("hub_n").alias("other_n"))
        fresh = freeze(verified(freeze(_fitting(pairs, settings.percent)), sets, settings.percent))
        left = freeze(rows.join(hubs, "bucket").filter("id <> hub").select("bucket", "id", "n"))
        if not fresh.limit(1).count():
            break
        every = components(every.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh))
    last = freeze(verified(freeze(_rest(_labelled(left, every), sets, settings.percent)), sets, settings.percent))
    if last.limit(1).count():
        every = components(every.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(last))

    final = every.withColumnRenamed("node", "id")
    shared = classes.filter("members > 1").select("set_digest", "id")
    named = signed.join(shared, "set_digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("id", "doc_id")).alias("id"))
    return named.join(final, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
