"""Hard negatives by a GNAT-style tree: split points with distance ranges to all sibling subtrees.

A node of the tree has a few split points; every other row belongs to the nearest of them.
For each split point i and subtree j the node stores the least and the largest distance from
i to the rows of j. A search looks for scores inside windows. With the norms of a subtree's
rows a window of scores becomes a ring of distances around the anchor, and the triangle
inequality over any split point says whether a subtree can reach into that ring; if not, the
subtree is left out. Leaves are scored exactly in integers.

The root is global: its split points come from a bounded sample, its subtrees are the cells
over which the rows are dealt, and anchors are sent only to cells their rings reach. The
cells of one anchor are searched in two rounds, its own cell first, so that the other cells
start from the scores already found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.llm.common import freeze, ship

_LOW, _HIGH = -(1 << 62), 1 << 62


@dataclass(frozen=True)
class Settings:
    """``positives`` of an anchor, ``negatives`` of a positive, their window in percent of its score.

    Components are multiplied by ``scale`` and floored. A node has ``arity`` split points, a
    leaf at most ``leaf_rows`` rows; the root has a cell for every ``cell_rows`` rows, at most
    ``most_cells``, and larger cells are dealt into parts of ``cell_rows``. Anchors meet a
    part in blocks of ``anchor_rows``.
    """

    positives: int = 5
    negatives: int = 3
    least_percent: int = 50
    most_percent: int = 95
    scale: int = 256
    arity: int = 16
    leaf_rows: int = 256
    cell_rows: int = 16_384
    most_cells: int = 64
    anchor_rows: int = 16_384


# ---- exact products and distances ---------------------------------------------------


def _largest(matrix: np.ndarray) -> int:
    return max(int(matrix.max()), -int(matrix.min())) if matrix.size else 0


def _doubles_suffice(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sums of products and squared distances stay below 2**53, where doubles are exact."""
    most = max(_largest(a), _largest(b))
    return 4 * most * most * max(1, a.shape[1]) < 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; an error where one passes 64 bits."""
    if _doubles_suffice(a, b):
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object) if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.array([[int(x) for x in row] for row in wide.tolist()], np.int64).reshape(len(a), len(b))


def _squares(matrix: np.ndarray) -> np.ndarray:
    doubles = matrix.astype(np.float64)
    return (doubles * doubles).sum(axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    doubles = a.astype(np.float64) @ b.T.astype(np.float64)
    return np.sqrt(np.maximum(_squares(a)[:, None] + _squares(b)[None, :] - 2 * doubles, 0))


# ---- the tree -----------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """Split points; ``least``/``most`` distance from point i to subtree j, squared norms of j."""

    points: np.ndarray
    least: np.ndarray
    most: np.ndarray
    norm_least: np.ndarray
    norm_most: np.ndarray

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every anchor and subtree: how near and how far its rows can be."""
        to = _distances(anchors, self.points)
        low, high = np.zeros((len(anchors), len(self.points))), np.full((len(anchors), len(self.points)), np.inf)
        for i in range(len(self.points)):
            d = to[:, i : i + 1]
            low = np.maximum(low, np.maximum(d - self.most[i], self.least[i] - d))
            high = np.minimum(high, d + self.most[i])
        return low, high

    def reached(self, low: np.ndarray, high: np.ndarray, child, square: np.ndarray, least_score: np.ndarray, most_score: np.ndarray) -> np.ndarray:
        """Whether rows ``low`` to ``high`` away can score between the two; all by anchor.

        A row of norm x and score s is sqrt(x + |anchor|**2 - 2 s) away. The margin covers
        the rounding of the roots.
        """
        outer = self.norm_most[child] + square - 2.0 * least_score
        inner = self.norm_least[child] + square - 2.0 * most_score
        margin = 1e-6 * (1 + np.sqrt(self.norm_most[child] + square))
        possible = outer >= 0
        return possible & (low <= np.sqrt(np.maximum(outer, 0)) + margin) & (high >= np.sqrt(np.maximum(inner, 0)) - margin)


def spread_points(vectors: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows far from each other (each the farthest from those before), fewer if rows are equal."""
    chosen = [0]
    apart = _distances(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(count, len(vectors)):
        best = int(apart.argmax())
        if apart[best] <= 0:
            break
        chosen.append(best)
        apart = np.minimum(apart, _distances(vectors, vectors[best : best + 1])[:, 0])
    return vectors[chosen]


def make_node(points: np.ndarray, vectors: np.ndarray) -> tuple[Node, np.ndarray]:
    """A node over ``vectors`` and the subtree of each row."""
    to = _distances(vectors, points)
    child = to.argmin(axis=1)
    count = len(points)
    least, most = np.full((count, count), np.inf), np.full((count, count), -np.inf)
    norm_least, norm_most = np.full(count, np.inf), np.full(count, -np.inf)
    squares = _squares(vectors)
    for j in np.unique(child):
        own = child == j
        least[:, j], most[:, j] = to[own].min(axis=0), to[own].max(axis=0)
        norm_least[j], norm_most[j] = squares[own].min(), squares[own].max()
    return Node(points, least, most, norm_least, norm_most), child


class Windows:
    """The searches of a block of anchors: score windows, each with its best rows so far."""

    def __init__(self, ids, labels, vectors, owner, low, high, count: int, same: bool):
        self.ids, self.labels, self.vectors, self.count, self.same = ids, labels, vectors, count, same
        self.owner, self.low, self.high = owner, low.copy(), high  # owner: place of the anchor, ascending
        self.begin = np.searchsorted(owner, np.arange(len(ids) + 1))
        self.squares = _squares(vectors)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(owner)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)] * len(owner)
        self.anchor_low, self.anchor_high = np.full(len(ids), _HIGH), np.full(len(ids), _LOW)
        np.minimum.at(self.anchor_low, owner, self.low)
        np.maximum.at(self.anchor_high, owner, self.high)

    def meet(self, anchors: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        """Score rows against ``anchors`` (places) and keep the best of every window."""
        scores = products(self.vectors[anchors], vectors)
        allowed = (labels[None, :] == self.labels[anchors][:, None]) == self.same
        allowed &= ids[None, :] != self.ids[anchors][:, None]
        sizes = self.begin[anchors + 1] - self.begin[anchors]
        window = np.repeat(self.begin[anchors] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        at = np.repeat(np.arange(len(anchors)), sizes)
        fits = allowed[at] & (scores[at] >= self.low[window][:, None]) & (scores[at] <= self.high[window][:, None])
        touched = np.flatnonzero(fits.any(axis=1))
        for k in touched.tolist():
            w, rows = window[k], np.flatnonzero(fits[k])
            got, names = np.append(self.scores[w], scores[at[k], rows]), np.append(self.found[w], ids[rows])
            best = np.lexsort((names, -got))[: self.count]
            self.scores[w], self.found[w] = got[best], names[best]
            if len(best) == self.count:
                self.low[w] = got[best[-1]]  # an equal score with a smaller id may still come
        changed = np.unique(self.owner[window[touched]])
        for a in changed.tolist():
            self.anchor_low[a] = self.low[self.begin[a] : self.begin[a + 1]].min()


def search(windows: Windows, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, settings: Settings) -> None:
    """Run all windows over a tree of these rows."""
    pruning = _doubles_suffice(vectors, windows.vectors)

    def scan(rows: np.ndarray, alive: np.ndarray) -> None:
        for a in range(0, len(rows), settings.leaf_rows):
            part = rows[a : a + settings.leaf_rows]
            for b in range(0, len(alive), 1024):
                windows.meet(alive[b : b + 1024], ids[part], labels[part], vectors[part])

    def visit(rows: np.ndarray, alive: np.ndarray) -> None:
        if len(rows) <= settings.leaf_rows or not pruning:
            return scan(rows, alive)
        some = rows[np.unique(np.linspace(0, len(rows) - 1, 3 * settings.arity).astype(np.int64))]
        node, child = make_node(spread_points(vectors[some], settings.arity), vectors[rows])
        children = np.unique(child)
        if len(children) == 1:
            return scan(rows, alive)
        low, high = node.bounds(windows.vectors[alive])
        for j in children[np.argsort(low[:, children].mean(axis=0), kind="stable")].tolist():
            reached = node.reached(low[:, j], high[:, j], j, windows.squares[alive], windows.anchor_low[alive], windows.anchor_high[alive])
            if reached.any():
                visit(rows[child == j], alive[reached])

    if len(rows := np.arange(len(ids))) and len(windows.ids):
        visit(rows, np.arange(len(windows.ids)))


# ---- on tables ----------------------------------------------------------------------


def _matrix(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """Integer rows, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False) if len(lists) else np.zeros(0, np.int64)
    out = np.zeros((len(lengths), size), np.int64)
    out[np.arange(size)[None, :] < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, vector): floor(scale * component) of the rows that take part, one a vec_id."""
    wide = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    named = wide.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    finite = named.filter(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    whole = finite.select("vec_id", "label", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale)))).alias("vector"))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def _root(rows: DataFrame, count: int, size: int, settings: Settings) -> tuple[np.ndarray, DataFrame]:
    """The global split points and the rows with their cell."""
    cells = min(settings.most_cells, max(1, math.ceil(count / settings.cell_rows)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(3 * cells).select("vector").toArrow()["vector"]
    points = spread_points(_matrix(sample, size), cells) if count else np.zeros((1, size), np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _distances(_matrix(batch["vector"], size), points).argmin(axis=1) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "label", "vector", "cell"])

    return points, freeze(rows.select("vec_id", "label", "vector").mapInArrow(assign, "vec_id long, label long, vector array<long>, cell int"))


def _root_node(points: np.ndarray, placed: DataFrame, size: int) -> tuple[Node, bool]:
    """Distance ranges and norms of the cells, from partial ranges of every partition."""
    count = len(points)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, cell = _matrix(batch["vector"], size), batch["cell"].to_numpy()
            to, squares, largest = _distances(vectors, points), _squares(vectors), _largest(vectors)
            for j in np.unique(cell).tolist():
                own = cell == j
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(count, j, np.int32)), pa.array(np.arange(count, dtype=np.int32)),
                        pa.array(to[own].min(axis=0)), pa.array(to[own].max(axis=0)),
                        pa.array(np.full(count, squares[own].min())), pa.array(np.full(count, squares[own].max())),
                        pa.array(np.full(count, float(largest))),
                    ],
                    ["cell", "point", "least", "most", "norm_least", "norm_most", "largest"],
                )

    kinds = "cell int, point int, least double, most double, norm_least double, norm_most double, largest double"
    sums = placed.select("vector", "cell").mapInArrow(ranges, kinds).groupBy("cell", "point").agg(
        F.min("least"), F.max("most"), F.min("norm_least"), F.max("norm_most"), F.max("largest")
    )
    node = Node(points, np.full((count, count), np.inf), np.full((count, count), -np.inf), np.full(count, np.inf), np.full(count, -np.inf))
    most = 0.0
    for j, i, least, far, norm_least, norm_most, largest in sums.collect():
        node.least[i, j], node.most[i, j], node.norm_least[j], node.norm_most[j] = least, far, norm_least, norm_most
        most = max(most, largest)
    return node, 4 * most * most * max(1, size) < 1 << 53


_ASKED = "anchor_id long, label long, vector array<long>, windows array<struct<positive_id: long, low: long, high: long>>"
_FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def _block(table: pa.Table, size: int, count: int, same: bool) -> tuple[Windows, np.ndarray]:
    lists = table["windows"].combine_chunks()
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    low, high, positive = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("low", "high", "positive_id"))
    return Windows(table["anchor_id"].to_numpy(), table["label"].to_numpy(), _matrix(table["vector"], size), owner, low, high, count, same), positive


class _Search:
    """Searches over the cells of one table."""

    def __init__(self, rows: DataFrame, settings: Settings):
        count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        self.size, self.settings, self.count = size, settings, count
        points, placed = _root(rows, count, size, settings)
        self.node, self.pruning = _root_node(points, placed, size)
        self.parts = {r["cell"]: math.ceil(r["count"] / settings.cell_rows) for r in placed.groupBy("cell").count().collect()}
        parts = F.element_at(F.create_map(*[F.lit(v) for pair in (self.parts or {0: 1}).items() for v in pair]), F.col("cell"))
        self.placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))

    def _sent(self, own: bool):
        """Anchors with each part of their own cell, or of the other cells their windows reach."""
        node, size, pruning, parts = self.node, self.size, self.pruning, self.parts

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = _matrix(batch["vector"], size)
                windows, _ = _block(pa.Table.from_batches([batch]), size, 1, True)
                home = _distances(vectors, node.points).argmin(axis=1)
                low, high = node.bounds(vectors)
                for j, count in parts.items():
                    goes = home == j if own else home != j
                    if not own and pruning:
                        goes &= node.reached(low[:, j], high[:, j], j, windows.squares, windows.anchor_low, windows.anchor_high)
                    at = np.flatnonzero(goes)
                    for part in range(count if len(at) else 0):
                        chosen = batch.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [*chosen.columns, pa.array(np.full(len(at), j, np.int32)), pa.array(np.full(len(at), part, np.int32))], [*batch.schema.names, "cell", "part"]
                        )

        return send

    def round(self, asked: DataFrame, anchors: int, own: bool, count: int, same: bool) -> DataFrame:
        """(anchor_id, positive_id, vec_id, score): the best ``count`` of every window and cell part."""
        size, settings = self.size, self.settings
        blocks = max(1, math.ceil(anchors / settings.anchor_rows))
        sent = asked.mapInArrow(self._sent(own), f"{_ASKED}, cell int, part int").withColumn("block", F.pmod(F.xxhash64("anchor_id"), F.lit(blocks)).cast("int"))
        rows = self.placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def run(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[], [], [], []]
            if rows.num_rows and asked.num_rows:
                ids = rows["vec_id"].to_numpy()
                order = np.argsort(ids)
                windows, positive = _block(asked, size, count, same)
                search(windows, ids[order], rows["label"].to_numpy()[order], _matrix(rows["vector"], size)[order], settings)
                lengths = [len(f) for f in windows.found]
                out = [[np.repeat(windows.ids[windows.owner], lengths)], [np.repeat(positive, lengths)], windows.found, windows.scores]
            return pa.table({n: pa.array(np.concatenate(c) if c else [], pa.int64()) for n, c in zip(("anchor_id", "positive_id", "vec_id", "score"), out)})

        return rows.groupBy("cell", "part", "block").cogroup(sent.groupBy("cell", "part", "block")).applyInArrow(run, _FOUND)

    def best(self, asked: DataFrame, anchors: int, count: int, same: bool) -> DataFrame:
        """The best ``count`` rows of every window, ``rank`` from 1."""
        near = freeze(self.round(asked, anchors, True, count, same))
        full = near.groupBy("anchor_id", "positive_id").agg(F.sort_array(F.collect_list("score"), asc=False).alias("scores"))
        full = full.filter(F.size("scores") >= count).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("positive_id", F.col("scores")[count - 1]))).alias("floor"))
        raised = F.transform(
            "windows",
            lambda w: F.struct(w["positive_id"].alias("positive_id"), F.coalesce(F.greatest(w["low"], F.try_element_at("floor", w["positive_id"])), w["low"]).alias("low"), w["high"].alias("high")),
        )
        rest = asked.join(full, "anchor_id", "left").select("anchor_id", "label", "vector", raised.alias("windows"))
        far = self.round(rest, anchors, False, count, same)
        order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("score").desc(), "vec_id")
        return freeze(near.unionByName(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vectors``: vec_id, embedding, label; ``anchors``: the vec_id of rows among them. A score
    is the inner product of the floored, scaled vectors; higher comes first, ties by smaller
    vec_id. The positives of an anchor are its first rows of the same label, itself aside.
    For each of them come the first rows of another label whose score lies within the given
    percents of the positive's (none if that score is negative).

    Rows with a null vec_id, label or vector, or any null or non-finite component take no
    part. Of rows that repeat a vec_id one counts (least label, then least vector). Vectors
    shorter than the longest count as filled up with zeros. Scores must fit 64 bits. Anchors
    that are not usable rows, or have no positive or no negative in a window, give no rows;
    other columns are ignored; empty tables give an empty table.
    """
    search_ = _Search(freeze(quantised(ship(vectors), settings.scale)), settings)
    chosen = anchors.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()
    asked = freeze(search_.placed.join(chosen, "vec_id", "left_semi").select(F.col("vec_id").alias("anchor_id"), "label", "vector"))
    count = asked.count()

    def window(low, high):
        return F.struct(F.lit(0).cast("long").alias("positive_id"), F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

    positives = search_.best(asked.withColumn("windows", F.array(window(_LOW, _HIGH))), count, settings.positives, True)
    positives = positives.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))

    score = F.col("positive_score").cast("decimal(20,0)")
    # least * p <= 100 * s <= most * p over integers: s from ceil(least * p / 100) to floor(most * p / 100)
    low, high = F.ceil(score * settings.least_percent / 100).cast("long"), F.floor(score * settings.most_percent / 100).cast("long")
    ringed = positives.select("anchor_id", F.struct("positive_id", low.alias("low"), high.alias("high")).alias("w")).filter("w.low <= w.high")
    wanted = freeze(asked.join(ringed.groupBy("anchor_id").agg(F.sort_array(F.collect_list("w")).alias("windows")), "anchor_id"))
    found = search_.best(wanted, count, settings.negatives, False)
    return found.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
