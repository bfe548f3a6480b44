"""Gradient boosting of binary labels on histograms that Spark aggregates.

Features are cut into at most ``bins`` bins once. A tree grows best first: the leaf with the
largest gain is split until ``leaves`` are reached. What a split needs are sums of gradients
and hessians per (node, feature, bin); tasks add them up over their rows and only those sums
reach the driver, whose size follows leaves, features and bins. One pass serves all nodes
the growth is waiting for, and only the smaller child of each split is summed: its sibling is
the parent less the child. Missing values have a bin of their own and go to the side that
gains more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators.ordered import quantiles
from cellwise.session import freeze


@dataclass(frozen=True)
class Settings:
    """``rounds`` trees of at most ``leaves``; the rest as usual for boosting on histograms.

    ``refresh``: after so many trees the running scores are stored, so passes walk few trees.
    """

    rounds: int = 100
    rate: float = 0.1
    leaves: int = 31
    least_rows: int = 20
    least_hessian: float = 1e-3
    l2: float = 0.0
    bins: int = 255
    refresh: int = 10


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. ``left`` holds bins up to ``cut``; children follow each other."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [True])
    child: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, cut: int, missing_left: bool) -> int:
        self.feature[node], self.cut[node], self.missing_left[node], self.child[node] = feature, cut, missing_left, len(self.feature)
        for column, start in ((self.feature, -1), (self.cut, 0), (self.missing_left, True), (self.child, -1), (self.value, 0.0)):
            column.extend([start, start])
        return self.child[node]

    def node_of(self, codes: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of every row of bin codes; code ``missing`` marks a missing value."""
        feature, cut, left, child = (np.array(x) for x in (self.feature, self.cut, self.missing_left, self.child))
        node = np.zeros(len(codes), np.int64)
        while (inner := np.flatnonzero(feature[node] >= 0)).size:
            at = node[inner]
            code = codes[inner, feature[at]]
            goes_left = np.where(code == missing, left[at], code <= cut[at])
            node[inner] = child[at] + ~goes_left
        return node


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    missing_left: bool
    left_rows: int
    right_rows: int


def best_split(sums: np.ndarray, settings: Settings) -> Split | None:
    """The split with the largest gain of a node from (feature, bin, gradient/hessian/rows) sums.

    The last bin holds missing values. Ties go to the smaller feature, then missing to the
    right, then the smaller cut.
    """
    found = None
    for k, own in enumerate(sums):
        total, gone = own.sum(axis=0), own[-1]
        for missing_left in (False, True) if gone[2] > 0 else (False,):
            left = np.cumsum(own[:-1], axis=0) + (gone if missing_left else 0)
            right = total - left
            allowed = (np.minimum(left[:, 2], right[:, 2]) >= settings.least_rows) & (np.minimum(left[:, 1], right[:, 1]) >= settings.least_hessian)
            if not allowed.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                part = lambda x: x[..., 0] ** 2 / (x[..., 1] + settings.l2)
                gain = np.where(allowed, part(left) + part(right) - part(total), -np.inf)
            cut = int(gain.argmax())
            if gain[cut] > 1e-12 and (found is None or gain[cut] > found.gain):
                found = Split(float(gain[cut]), k, cut, missing_left, int(left[cut, 2]), int(right[cut, 2]))
    return found


class Growth:
    """One tree while it grows: what is known of its nodes and which sums it waits for."""

    def __init__(self, root: np.ndarray, settings: Settings):
        self.settings, self.tree = settings, Tree()
        self.sums = {0: root}
        self.splits = {0: best_split(root, settings)}

    def waiting(self) -> list[int]:
        """Split the known leaves best first as far as that order is settled.

        Returns the smaller children whose sums are needed before the next choice; none when
        the tree is complete. Splitting a leaf can uncover better ones below it, so the order
        is replayed from the root each time.
        """
        frontier, leaves, needed = [0], 1, []
        while frontier and leaves < self.settings.leaves:
            known = [n for n in frontier if self.splits.get(n) is not None]
            if not known:
                break
            node = max(known, key=lambda n: (self.splits[n].gain, -n))
            frontier.remove(node)
            leaves += 1
            split = self.splits[node]
            if self.tree.child[node] < 0:
                self.tree.split(node, split.feature, split.cut, split.missing_left)
            left = self.tree.child[node]
            if left in self.sums:
                frontier += [left, left + 1]
            else:
                needed.append(left if split.left_rows <= split.right_rows else left + 1)
        self.kept = leaves
        return needed

    def learn(self, found: dict[int, np.ndarray]) -> None:
        for node, sums in found.items():
            parent = self.tree.child.index(node if node in self.tree.child else node - 1)
            left = self.tree.child[parent]
            other = left + 1 if node == left else left
            self.sums[node], self.sums[other] = sums, self.sums[parent] - sums
            for n in (node, other):
                self.splits[n] = best_split(self.sums[n], self.settings)

    def finish(self, rate: float) -> Tree:
        """The tree of the settled splits, with leaf values."""
        done, nodes = Tree(), [(0, 0)]
        frontier, leaves = {0}, 1
        chosen = set()
        while leaves < self.settings.leaves:
            known = [n for n in frontier if self.splits.get(n) is not None]
            if not known:
                break
            node = max(known, key=lambda n: (self.splits[n].gain, -n))
            chosen.add(node)
            frontier.remove(node)
            frontier |= {self.tree.child[node], self.tree.child[node] + 1}
            leaves += 1
        while nodes:
            old, new = nodes.pop()
            if old in chosen:
                split = self.splits[old]
                left = done.split(new, split.feature, split.cut, split.missing_left)
                nodes += [(self.tree.child[old], left), (self.tree.child[old] + 1, left + 1)]
            else:
                gradient, hessian, _ = self.sums[old][0].sum(axis=0)
                done.value[new] = -rate * gradient / (hessian + self.settings.l2) if hessian + self.settings.l2 > 0 else 0.0
        return done


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-raw))


def raw_scores(codes: np.ndarray, start: np.ndarray | float, trees: Sequence[Tree], missing: int) -> np.ndarray:
    raw = np.zeros(len(codes)) + start
    for tree in trees:
        raw += np.array(tree.value)[tree.node_of(codes, missing)]
    return raw


def node_sums(codes: np.ndarray, labels: np.ndarray, raw: np.ndarray, node: np.ndarray, wanted: Sequence[int], bins: int) -> dict[int, np.ndarray]:
    """(feature, bin, gradient/hessian/rows) sums of the wanted nodes."""
    chance = _logistic(raw)
    weights = (chance - labels, chance * (1 - chance), np.ones(len(raw)))
    found = {}
    for n in wanted:
        own = np.flatnonzero(node == n)
        out = np.zeros((codes.shape[1], bins + 1, 3))
        for k in range(codes.shape[1]):
            for w, weight in enumerate(weights):
                out[k, :, w] = np.bincount(codes[own, k], weight[own], bins + 1)
        found[n] = out
    return found


@dataclass
class Boosted:
    features: tuple[str, ...]
    edges: list[np.ndarray]
    start: float
    settings: Settings
    trees: list[Tree] = field(default_factory=list)


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature: between values if there are few, else exact quantiles.

    A value belongs to the first bin whose edge is not below it; the last bin has no edge.
    """
    edges = []
    for name in features:
        present = rows.filter(F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))).select(F.col(name).cast("double").alias("v"))
        few = [r[0] for r in present.distinct().limit(bins + 1).collect()]
        if len(few) <= bins:
            values = np.sort(np.array(few, float))
            edges.append((values[1:] + values[:-1]) / 2)
        else:
            cut = quantiles(present, [], "v", {f"q{k}": k / bins for k in range(1, bins)}).first()
            edges.append(np.unique(np.array([cut[f"q{k}"] for k in range(1, bins)], float)))
    return edges


def _codes(batch: pa.RecordBatch, names: Sequence[str], edges: list[np.ndarray], missing: int) -> np.ndarray:
    out = np.empty((batch.num_rows, len(names)), np.int16)
    for k, (name, edge) in enumerate(zip(names, edges)):
        values = batch[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[:, k] = np.where(np.isnan(values), missing, np.searchsorted(edge, values, side="left"))
    return out


def _stored(model: Boosted, held: int):
    """Bin codes, label and the score of the first ``held`` trees of every row."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = model.settings.bins
        for batch in batches:
            codes = _codes(batch, model.features, model.edges, missing)
            raw = raw_scores(codes, model.start, model.trees[:held], missing)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([lists, batch["label"].cast(pa.float64()), pa.array(raw)], ["codes", "label", "raw"])

    return code


_STORED = "codes array<smallint>, label double, raw double"


def _unpack(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = batch["codes"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return codes, batch["label"].to_numpy(), batch["raw"].to_numpy()


def _summing(trees: list[Tree], growing: Tree, wanted: list[int], width: int, bins: int):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {n: np.zeros((width, bins + 1, 3)) for n in wanted}
        for batch in batches:
            codes, labels, raw = _unpack(batch, width)
            raw = raw_scores(codes, raw, trees, bins)
            for n, part in node_sums(codes, labels, raw, growing.node_of(codes, bins), wanted, bins).items():
                held[n] += part
        for n, part in held.items():
            feature, code = np.nonzero(part[:, :, 2])
            if len(feature):
                own = part[feature, code]
                columns = [np.full(len(feature), n), feature, code, own[:, 0], own[:, 1], own[:, 2]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.float64()] * 3)], ["node", "feature", "bin", "g", "h", "n"])

    return sums


def _sums_of(stored: DataFrame, trees: list[Tree], growing: Tree, wanted: list[int], model: Boosted) -> dict[int, np.ndarray]:
    bins, width = model.settings.bins, len(model.features)
    partial = stored.mapInArrow(_summing(trees, growing, wanted, width, bins), "node int, feature int, bin int, g double, h double, n double")
    found = {n: np.zeros((width, bins + 1, 3)) for n in wanted}
    for node, feature, code, g, h, n in partial.groupBy("node", "feature", "bin").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect():
        found[node][feature, code] = g, h, n
    return found


def _advanced(trees: list[Tree], width: int, bins: int):
    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, _, raw = _unpack(batch, width)
            yield pa.RecordBatch.from_arrays([batch["codes"], batch["label"], pa.array(raw_scores(codes, raw, trees, bins))], ["codes", "label", "raw"])

    return advance


def fit(rows: DataFrame, features: Sequence[str], label: str, settings: Settings = Settings()) -> Boosted:
    """Boosted trees for a 0/1 ``label``; NULL and NaN features are missing values.

    Rows without a label are left out. Rows repeat with their weight; both classes must occur.
    """
    known = rows.filter(F.col(label).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias("label"))
    low, high, mean = known.agg(F.min("label"), F.max("label"), F.avg("label")).first()
    if low != 0 or high != 1:
        raise ValueError("Training rows must hold both classes")
    model = Boosted(tuple(features), bin_edges(known, features, settings.bins), float(np.log(mean / (1 - mean))), settings)
    stored = freeze(known.mapInArrow(_stored(model, 0), _STORED))
    since: list[Tree] = []
    for _ in range(settings.rounds):
        growth = Growth(_sums_of(stored, since, Tree(), [0], model)[0], settings)
        while needed := growth.waiting():
            growth.learn(_sums_of(stored, since, growth.tree, needed, model))
        model.trees.append(growth.finish(settings.rate))
        since.append(model.trees[-1])
        if len(since) == settings.refresh:
            stored, since = freeze(stored.mapInArrow(_advanced(since, len(features), settings.bins), _STORED)), []
    return model


def score(model: Boosted, rows: DataFrame, name: str = "probability") -> DataFrame:
    """``rows`` with the probability of label 1."""
    inputs = [f"_b{k}" for k in range(len(model.features))]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_scores(_codes(batch, inputs, model.edges, model.settings.bins), model.start, model.trees, model.settings.bins)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kinds)], pa.array(_logistic(raw))], [*batch.schema.names[: len(kinds)], name])

    ready = rows.select(*rows.columns, *[F.col(c).cast("double").alias(i) for c, i in zip(model.features, inputs)])
    return ready.mapInArrow(add, ", ".join([*kinds, f"`{name}` double"]))
