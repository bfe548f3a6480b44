"""Nearest neighbours by multi-index hashing of learned binary codes.

Codes: vectors are centred, turned by principal axes and by a rotation that brings them
close to the corners of the cube (iterative quantisation), and cut to signs. A code is split
into substrings and every shard of rows indexes each of them. Two codes within Hamming
radius r agree in some substring up to r // substrings bits, so probing those values finds
every code within r (the first such substring reports it). Found codes within r are ranked
by the exact inner product of the original vectors.

The radius and the number of substrings are measured, not guessed: the radius is the
``cover`` quantile of the code distances between sampled queries and their true neighbours;
the split is the one with the least expected cost of probes and candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.llm.common import freeze, ship
from cellwise.session import broadcast_checked


_QUERIES_AT_ONCE = 256


@dataclass(frozen=True)
class Settings:
    """``sample`` vectors (least hash of vec_id) fit the rotation, ``probes`` queries the radius."""

    neighbours: int = 20
    sample: int = 20_000
    probes: int = 256
    cover: float = 0.97
    rounds: int = 30
    shard_rows: int = 16_384
    query_rows: int = 16_384
    seed: int = 7


@dataclass(frozen=True)
class Codes:
    centre: np.ndarray
    turn: np.ndarray

    @staticmethod
    def fit(vectors: np.ndarray, settings: Settings) -> Codes:
        size = vectors.shape[1]
        bits = min(size, 64)
        if not len(vectors):
            return Codes(np.zeros(size), np.eye(size, bits))
        centre = vectors.mean(axis=0)
        around = vectors - centre
        _, axes = np.linalg.eigh(around.T @ around)
        axes = axes[:, ::-1][:, :bits]
        flat = around @ axes
        rotation = np.linalg.qr(np.random.default_rng(settings.seed).normal(size=(bits, bits)))[0]
        for _ in range(settings.rounds):
            corners = np.where(flat @ rotation >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(corners.T @ flat)
            rotation = (u @ v).T
        return Codes(centre, axes @ rotation)

    @property
    def bits(self) -> int:
        return self.turn.shape[1]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.centre) @ self.turn >= 0
        return (signs.astype(np.uint64) << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def split_of(bits: int, parts: int) -> list[tuple[int, int]]:
    """(shift, width) of the substrings, as even as can be."""
    edges = [round(k * bits / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def best_split(bits: int, radius: int, rows: int) -> int:
    """The number of substrings with the fewest probes and expected candidates a query."""
    costs = {}
    for parts in range(1, bits + 1):
        cost = 0.0
        for _, width in split_of(bits, parts):
            if width > 16:
                cost = math.inf
                break
            probes = sum(math.comb(width, k) for k in range(min(radius // parts, width) + 1))
            cost += probes * (1 + rows / 2**width)
        costs[parts] = cost
    return min(costs, key=lambda p: (costs[p], p))


def flips(width: int, most: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``most`` ones."""
    found = [sum(1 << b for b in c) for k in range(min(most, width) + 1) for c in combinations(range(width), k)]
    return np.array(found, np.int64)


class ShardIndex:
    """Every substring of a shard's codes, sorted, with where each value begins."""

    def __init__(self, codes: np.ndarray, bits: int, parts: int, radius: int):
        self.codes, self.radius, self.tables = codes, radius, []
        for shift, width in split_of(bits, parts):
            value = ((codes >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(value, kind="stable")
            begin = np.append(0, np.cumsum(np.bincount(value, minlength=1 << width)))
            self.tables.append((shift, width, order, begin, flips(width, radius // parts)))

    def within(self, code: np.uint64) -> np.ndarray:
        """Rows whose code is within the radius."""
        met = np.zeros(len(self.codes), bool)
        for shift, width, order, begin, flip in self.tables:
            value = int((code >> np.uint64(shift)) & np.uint64((1 << width) - 1)) ^ flip
            start, size = begin[value], begin[value + 1] - begin[value]
            some = size > 0
            start, size = start[some], size[some]
            at = np.repeat(start - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()) if len(size) else start
            met[order[at]] = True
        rows = np.flatnonzero(met)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= self.radius]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of vectors that are neither null, empty nor zero and wholly finite."""
    wide = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter("vec_id IS NOT NULL AND size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return wide.filter(finite).filter(F.exists("embedding", lambda x: x != 0))


def _matrix(column) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: np.ndarray, count: int) -> np.ndarray:
    """Places of the best ``count``, nearest first, ties to the smaller id."""
    if len(scores) > count:
        edge = np.partition(scores, len(scores) - count)[len(scores) - count]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:count]


def _scores(vectors: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """Inner products, each summed in the same order wherever its row stands: equal rows score equal."""
    return (vectors * vector).sum(axis=1)


def _nearest(vectors: np.ndarray, norms: np.ndarray, ids: np.ndarray, vector: np.ndarray, rough: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best ``count``; ``rough`` scores only choose, with a margin above their rounding."""
    keep = np.arange(len(rough))
    if len(rough) > count:
        edge = np.partition(rough, len(rough) - count)[len(rough) - count]
        keep = np.flatnonzero(~(rough < edge - 1e-9 * np.linalg.norm(vector) * norms.max()))
    scores = _scores(vectors[keep], vector)
    best = _best(scores, ids[keep], count)
    return keep[best], scores[best]


_FOUND = "query_id long, vec_id long, score double, query_code long, code long"


def _table(found: list) -> pa.Table:
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [[]] * 5
    return pa.table({n: pa.array(c, k) for n, c, k in zip(["query_id", "vec_id", "score", "query_code", "code"], columns, kinds)})


def _entries(query: int, ids, scores, query_code, codes, keep):
    n = len(keep)
    return np.full(n, query, np.int64), ids[keep], scores, np.full(n, query_code, np.uint64).view(np.int64), codes[keep].view(np.int64)


def _exactly(queries: list[tuple[int, list[float]]], codes: Codes, count: int):
    """The best of each batch for a bounded list of queries, by looking at every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not queries:
            return
        wanted = np.array([q[1] for q in queries])
        own = codes.of(wanted)
        for batch in batches:
            ids, vectors = batch["vec_id"].to_numpy(), _matrix(batch["embedding"])
            if not len(ids):
                continue
            there, norms, found = codes.of(vectors), np.linalg.norm(vectors, axis=1), []
            for a in range(0, len(queries), _QUERIES_AT_ONCE):
                rough = wanted[a : a + _QUERIES_AT_ONCE] @ vectors.T
                for k, (query, _) in enumerate(queries[a : a + _QUERIES_AT_ONCE], a):
                    others = np.flatnonzero(ids != query)
                    if len(others):
                        keep, scores = _nearest(vectors[others], norms[others], ids[others], wanted[k], rough[k - a, others], count)
                        found.append(_entries(query, ids, scores, own[k], there, others[keep]))
            yield from _table(found).combine_chunks().to_batches()

    return scan


def _search(codes: Codes, parts: int, radius: int, count: int):
    def search(key: tuple[pa.Scalar, ...], rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return _table([])
        ids, vectors = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
        there, norms = codes.of(vectors), np.linalg.norm(vectors, axis=1)
        index = ShardIndex(there, codes.bits, parts, radius)
        wanted = _matrix(queries["embedding"])
        found = []
        for query, vector, code in zip(queries["vec_id"].to_pylist(), wanted, codes.of(wanted)):
            near = index.within(code)
            near = near[ids[near] != query]
            if len(near):
                keep, scores = _nearest(vectors[near], norms[near], ids[near], vector, vectors[near] @ vector, count)
                found.append(_entries(query, ids, scores, code, there, near[keep]))
        return _table(found)

    return search


def _ranked(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


def neighbours(vectors: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest rows of ``vectors`` to each row of ``queries``.

    Both have vec_id and embedding; a query never finds its own vec_id. Shards of rows and
    blocks of queries are bounded and meet once each; a task holds one of each. Queries that
    found fewer than ``neighbours`` rows within the radius, while more rows exist, are
    answered by looking at every row. Vectors that are null, zero or not wholly finite take
    no part, nor do those of another length than the most frequent one. Rows that repeat a
    vec_id are candidates as often as they occur; as queries they count once. Empty tables
    give an empty table.
    """
    rows = usable(ship(vectors))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.col("count").desc(), "n").limit(1).collect()
    size = lengths[0][0] if lengths else 1
    rows = rows.filter(F.size("embedding") == size)
    asked = usable(queries).filter(F.size("embedding") == size).dropDuplicates(["vec_id"])
    count, wanted = rows.count(), asked.count()

    def sampled(table: DataFrame, most: int) -> list:
        return table.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).collect()

    codes = Codes.fit(np.array([r[1] for r in sampled(rows, settings.sample)]).reshape(-1, size), settings)
    probes = [(r[0], list(r[1])) for r in sampled(asked, settings.probes)]
    truth = _ranked(rows.mapInArrow(_exactly(probes, codes, settings.neighbours), _FOUND), settings.neighbours)
    apart = truth.select(F.bit_count(F.col("query_code").bitwiseXOR(F.col("code"))).alias("apart"))
    radius = int(apart.agg(F.coalesce(F.percentile("apart", settings.cover), F.lit(0.0))).first()[0])
    shards, blocks = max(1, math.ceil(count / settings.shard_rows)), max(1, math.ceil(wanted / settings.query_rows))
    parts = best_split(codes.bits, radius, min(count, settings.shard_rows))

    shard, block = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("shard", shard).withColumn("block", every(blocks))
    right = asked.withColumn("block", block).withColumn("shard", every(shards))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_search(codes, parts, radius, settings.neighbours), _FOUND)
    best = freeze(_ranked(found, settings.neighbours))

    least = min(settings.neighbours, count - 1)
    full = best.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    for part in _blocks_of(short, settings.query_rows):
        exact = freeze(_ranked(rows.mapInArrow(_exactly(part, codes, settings.neighbours), _FOUND), settings.neighbours))
        done = exact.select("query_id").distinct()
        best = best.join(broadcast_checked(done), "query_id", "left_anti").unionByName(exact)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _blocks_of(queries: DataFrame, most: int) -> Iterator[list]:
    held: list = []
    for row in queries.toLocalIterator():
        held.append((row["vec_id"], list(row["embedding"])))
        if len(held) == most:
            yield held
            held = []
    if held:
        yield held
