"""Boosting on histograms and Huber regression against NumPy."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from cellwise.operators import boosting, modeling, robust
from cellwise.operators.ordered import select_quantile


def sample(n=2000, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 1] = np.round(x[:, 1] * 2)  # few values
    x[rng.random(n) < 0.15, 2] = np.nan
    logit = 1.5 * (x[:, 0] > 0.3) - np.where(np.isnan(x[:, 2]), 1.0, x[:, 2] ** 2 / 3) + 0.4 * x[:, 1]
    return x, (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int)


def grow_by_hand(codes, g, h, s):
    """Best-first growth that looks at all rows of every leaf: [(rows, value)]."""

    def best(rows):
        top = (1e-12, None)
        for k in range(codes.shape[1]):
            c = codes[rows, k]
            for gone_left in (False, True) if (c == s.bins).any() else (False,):
                for cut in range(s.bins):
                    left = (c <= cut) & (c != s.bins) | ((c == s.bins) & gone_left)
                    a, b = rows[left], rows[~left]
                    if min(len(a), len(b)) < s.least_rows or min(h[a].sum(), h[b].sum()) < s.least_hessian:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)
                    gain = part(a) + part(b) - part(rows)
                    if gain > top[0] * (1 + 1e-9):
                        top = (gain, (a, b))
        return top

    leaves = [(np.arange(len(g)), best(np.arange(len(g))))]
    while len(leaves) < s.leaves:
        k = max(range(len(leaves)), key=lambda i: leaves[i][1][0] if leaves[i][1][1] else -1)
        if leaves[k][1][1] is None:
            break
        _, (_, (a, b)) = leaves.pop(k)
        leaves += [(a, best(a)), (b, best(b))]
    return [(rows, -s.rate * g[rows].sum() / (h[rows].sum() + s.l2)) for rows, _ in leaves]


def test_same_trees_as_by_hand(spark):
    x, y = sample()
    settings = boosting.Settings(rounds=3, leaves=8, bins=16, l2=0.5, refresh=2)
    names = ["a", "b", "c", "d"]
    rows = spark.createDataFrame([(*[None if np.isnan(v) else float(v) for v in r], int(t)) for r, t in zip(x, y)], "a double, b double, c double, d double, y int").repartition(5)
    model = boosting.fit(rows, names, "y", settings)
    codes = np.stack([np.where(np.isnan(x[:, k]), 16, np.searchsorted(model.edges[k], x[:, k])) for k in range(4)], axis=1)
    assert all(len(e) <= 15 for e in model.edges)
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-raw))
        by_hand = grow_by_hand(codes, p - y, p * (1 - p), settings)
        place = tree.node_of(codes, 16)
        assert len(by_hand) == len(set(place.tolist())) == 8
        for leaf, value in by_hand:
            assert len(set(place[leaf].tolist())) == 1
            assert tree.value[place[leaf[0]]] == pytest.approx(value, rel=1e-9)
        raw += np.array(tree.value)[place]
    got = boosting.score(model, rows.withColumn("_b0", F.lit("x")).drop("_b0"), "p").select("p").toPandas()["p"]
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-raw))), atol=1e-12)


def test_best_first_order_is_settled_before_a_tree_ends():
    """A weak first split over strong ones: speculation must not keep what best-first would not."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 4, (600, 3))
    g = np.where((codes[:, 0] < 2) ^ (codes[:, 1] < 2), 1.0, -1.0) + rng.normal(size=600) * 0.05
    h = np.ones(600)
    for leaves in (2, 3, 4, 5):
        s = boosting.Settings(leaves=leaves, bins=4, least_rows=5, rate=1.0)

        def sums(node, wanted):
            out = {}
            for n in wanted:
                own = node == n
                out[n] = np.zeros((3, 5, 3))
                for k in range(3):
                    np.add.at(out[n][k], codes[own, k], np.stack([g[own], h[own], np.ones(own.sum())], axis=1))
            return out

        growth = boosting.Growth(sums(np.zeros(600), [0])[0], s)
        while needed := growth.waiting():
            growth.learn(sums(growth.tree.node_of(codes, 4), needed))
        place = growth.finish(1.0).node_of(codes, 4)
        want = {tuple(r.tolist()) for r, _ in ((np.sort(rows), v) for rows, v in grow_by_hand(codes, g, h, s))}
        assert {tuple(np.flatnonzero(place == n).tolist()) for n in set(place.tolist())} == want


def test_boosting_refuses_one_class_and_scores_missing(spark):
    one = spark.createDataFrame([(1.0, 1), (2.0, 1)], "a double, y int")
    with pytest.raises(ValueError):
        boosting.fit(one, ["a"], "y")
    x, y = sample(400)
    rows = spark.createDataFrame([(float(r[0]), int(t)) for r, t in zip(x, y)], "a double, y int")
    fitted = modeling.fit_classifier(rows, "y", modeling.Spec(("a",)), "boosted", {"rounds": 5, "leaves": 4})
    scored = modeling.predict_probability(fitted, rows).toPandas()
    assert scored[scored.a > 0.5].probability.mean() > scored[scored.a < 0].probability.mean() + 0.05
    model = boosting.fit(rows, ["a"], "y", boosting.Settings(rounds=2))
    got = boosting.score(model, spark.createDataFrame([(None, "k"), (float("nan"), "k"), (1e300, "k")], "a double, other string")).collect()
    assert len(got) == 3 and all(0 < r.probability < 1 for r in got)


def by_hand_huber(x, y, t=1.345):
    design = np.column_stack([np.ones(len(y)), x])
    beta, w = np.linalg.lstsq(design, y, rcond=None)[0], None
    for _ in range(49):
        off = np.abs(y - design @ beta)
        scale = np.median(off) / robust.NORMAL_Q3
        w = np.where(off <= t * scale, 1.0, t * scale / np.maximum(off, 1e-300))
        before, beta = beta, np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * y))
        if np.abs(before - beta).max() <= 1e-8:
            break
    return beta


def test_huber_by_reweighting(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    y = 2 + x @ [1.5, -0.7] + rng.normal(size=300) * 0.3
    y[::15] += 25  # outliers
    rows = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, weight double")
    ready = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows).repartition(4)
    fitted = robust.huber(ready, "weight", "p")
    assert np.allclose([fitted.intercept, *fitted.coefficients], by_hand_huber(x, y), atol=1e-8)
    assert abs(fitted.intercept - 2) < 0.2  # least squares is off by more than 1


def test_huber_ends_on_a_perfect_line(spark):
    rows = spark.createDataFrame([(float(k), 3.0 * k + 1) for k in range(20)], "a double, y double")
    fitted = robust.huber(VectorAssembler(inputCols=["a"], outputCol="features").transform(rows), "y", "p")
    assert fitted.coefficients[0] == pytest.approx(3) and fitted.intercept == pytest.approx(1)


@pytest.mark.parametrize("most", [50_000, 40])
def test_quantile_by_selection(spark, most):
    rng = np.random.default_rng(2)
    tables = [rng.normal(size=3001), np.round(rng.normal(size=2000)), np.repeat(5.0, 500), np.array([1.0]), np.append(np.zeros(900), rng.normal(size=100))]
    for values in tables:
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
        for p in (0.0, 0.31, 0.5, 1.0):
            assert select_quantile(df, "v", p, most) == pytest.approx(float(np.quantile(values, p)), abs=1e-12)
    assert select_quantile(spark.createDataFrame([], "v double"), "v", 0.5) is None
