"""Hard negatives against looking at every pair in Python integers."""

import math

import numpy as np
import pytest

from cellwise.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, part int, cell string"


def brute(rows, anchors, settings):
    usable = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        own = (label, [math.floor(settings.scale * x) for x in vector])
        usable[i] = min(usable.get(i, own), own)
    out = []
    for a in sorted(set(anchors) & set(usable)):
        label, vector = usable[a]
        scored = sorted((-sum(x * y for x, y in zip(vector, w)), i, m) for i, (m, w) in usable.items() if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][: settings.positives]:
            ring = [s for s in scored if s[2] != label and settings.least_percent * -p <= 100 * -s[0] <= settings.most_percent * -p]
            out += [(a, positive, rank, i, -p, -s) for rank, (s, i, _) in enumerate(ring[: settings.negatives], 1)]
    return sorted(out)


def some_rows():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[rng.integers(12)] / 2 + rng.normal(size=8) * 0.3], int(rng.integers(4))) for i in range(900)]
    rows += [(5000 + i, rows[0][1], i % 3) for i in range(400)]  # one vector held by a third
    return rows + [
        (9001, None, 1), (9002, [1.0] * 8, None), (9003, [1.0, None] + [0.0] * 6, 1), (9004, [float("nan")] * 8, 1), (9005, [], 1), (9006, [0.5], 2),
        (9007, [0.0] * 8, 2), (9008, [float("inf")] * 8, 2), (7, rows[7][1], 9), (8, rows[8][1], rows[8][2]), (None, [1.0] * 8, 1),
    ]


@pytest.mark.parametrize(
    "settings",
    [N.Settings(), N.Settings(cell_rows=200, leaf_rows=20, arity=5, anchor_rows=20, most_cells=6), N.Settings(scale=1 << 24, cell_rows=500, leaf_rows=50, least_percent=-30)],
    ids=["as dealt", "small tree", "integers past doubles"],
)
def test_against_every_pair(spark, settings):
    rows = some_rows()
    vectors = spark.createDataFrame([(*r, 0, "c") for r in rows], SCHEMA).repartition(4)
    anchors = [i for i, _, _ in rows if i is not None and i % 25 == 0] + [9002, 9004, 9005, 9007, 123_456]
    named = spark.createDataFrame([(i,) for i in anchors], "vec_id long")
    got = N.hard_negatives(vectors, named, settings)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, anchors, settings)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert N.hard_negatives(none, none).collect() == []


def test_ranges_leave_out_only_what_cannot_score():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 6))
    around = 1000 * centres / np.linalg.norm(centres, axis=1)[:, None]
    rows = np.floor(np.repeat(around, 100, axis=0) + rng.normal(size=(3000, 6)) * 20).astype(np.int64)
    anchors = rows[::100]
    node, child = N.make_node(N.spread_points(rows[::20], 12), rows)
    low, high = node.bounds(anchors)
    squares, scores = N._squares(anchors), N.products(anchors, rows)
    skipped = 0
    for least, most in ((-(1 << 62), 1 << 62), (0, 50_000), (950_000, 2_000_000), (-5000, -4000)):
        for j in np.unique(child):
            bounds = np.full(len(anchors), least), np.full(len(anchors), most)
            reached = node.reached(low[:, j], high[:, j], j, squares, *bounds)
            own = scores[:, child == j]
            hit = ((own >= least) & (own <= most)).any(axis=1)
            assert not (hit & ~reached).any()
            skipped += int((~reached).sum())
    assert skipped > 200


def test_products_are_exact():
    wide = np.array([[2**31 - 1, 5], [-(2**31), 3]], np.int64)
    assert N.products(wide, wide).tolist() == [[sum(x * y for x, y in zip(a, b)) for b in wide.tolist()] for a in wide.tolist()]
