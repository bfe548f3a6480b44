"""Distributed order statistics against pandas, in one slice and in many."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.operators import ordered, ranking, relations


@pytest.fixture(params=["one_slice", "many_slices"])
def slicing(spark, request):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "true" if request.param == "one_slice" else "false")
    yield request.param
    spark.conf.set(key, "true")


def skewed(n=4000, seed=1):
    """Two thirds of the rows share one key and a third share one value."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.33, 0.5, rng.normal(size=n).round(3))
    return pd.DataFrame({"id": np.arange(n), "k": key, "v": value, "y": rng.integers(0, 2, n)})


def test_slices_are_really_many(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(skewed())
    assert not ordered.is_one_slice(ordered.order_slices(df, [], [F.col("v").asc(), F.col("id").asc()]))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_quantiles(spark, slicing):
    pdf = skewed()
    got = ordered.quantiles(spark.createDataFrame(pdf), ["k"], "v", {"p1": 0.01, "m": 0.5, "p9": 0.93}).toPandas()
    for _, row in got.iterrows():
        values = pdf.loc[pdf.k == row.k, "v"]
        assert np.allclose([row.p1, row.m, row.p9], values.quantile([0.01, 0.5, 0.93]))


def test_global_quantile(spark, slicing):
    pdf = skewed()
    got = ordered.quantiles(spark.createDataFrame(pdf), [], "v", {"q": 0.2}).first()["q"]
    assert got == pytest.approx(pdf.v.quantile(0.2))


def test_row_numbers_split_a_hot_key(spark, slicing):
    pdf = skewed()
    df = spark.createDataFrame(pdf)
    got = ordered.row_numbers(df, ["k"], [F.col("v").desc(), F.col("id").asc()], "place").toPandas()
    want = pdf.sort_values(["v", "id"], ascending=[False, True]).assign(
        place=lambda d: d.groupby("k").cumcount() + 1
    )
    merged = got.merge(want, on="id")
    assert (merged.place_x == merged.place_y).all()
    assert (got.groupby("k").place.max() == got.groupby("k").place_of.max()).all()


def test_null_key_is_a_group(spark, slicing):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "k string, v double")
    got = {r.k: r.m for r in ordered.quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert got == {None: 2.0, "a": 2.0}


def test_average_ranks(spark, slicing):
    pdf = skewed()
    got = ordered.average_ranks(spark.createDataFrame(pdf), ["k"], "v").toPandas()
    want = pdf.assign(rank=pdf.groupby("k").v.rank("average"))[["k", "v", "rank"]].drop_duplicates()
    merged = got.merge(want, on=["k", "v"])
    assert len(merged) == len(want) and np.allclose(merged.rank_x, merged.rank_y)


def test_spearman(spark, slicing):
    pdf = skewed()
    pdf["w"] = pdf.v * 2 + np.random.default_rng(3).normal(size=len(pdf)).round(1)
    got = relations.spearman(spark.createDataFrame(pdf), ["k"], "v", "w").toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.k == row.k]
        assert row.spearman == pytest.approx(np.corrcoef(part.v.rank(), part.w.rank())[0, 1])


def brute_metrics(y, p):
    order = np.unique(p)[::-1]
    positives = y.sum()
    ap = sum(
        y[p == s].sum() / positives * y[p >= s].sum() / (p >= s).sum() for s in order
    )
    ranks = pd.Series(p).rank().to_numpy()
    negatives = len(y) - positives
    auc = (ranks[y == 1].sum() - positives * (positives + 1) / 2) / (positives * negatives)
    return ap, auc, np.mean((p - y) ** 2)


def test_ranking_metrics(spark, slicing):
    pdf = skewed().assign(p=lambda d: 1 / (1 + np.exp(-d.v)))
    got = ranking.performance(spark.createDataFrame(pdf), ["k"], "y", "p").toPandas()
    for _, row in got.iterrows():
        part = pdf[pdf.k == row.k]
        want = brute_metrics(part.y.to_numpy(), part.p.to_numpy())
        assert np.allclose([row.average_precision, row.roc_auc, row.brier], want)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 4)), min_size=4, max_size=40))
def test_ranking_metrics_with_ties(spark, rows):
    y = np.array([r[0] for r in rows])
    if y.sum() in (0, len(y)):
        return
    p = np.array([r[1] for r in rows]) / 4
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p}))
    got = ranking.performance(df, [], "y", "p", {"half": 0.5}).first()
    assert np.allclose([got.average_precision, got.roc_auc, got.brier], brute_metrics(y, p))
    size = int(np.ceil(len(y) * 0.5))
    boundary = np.sort(p)[::-1][size - 1]
    above, tied = y[p > boundary], y[p == boundary]
    assert got.half_prevalence == pytest.approx((above.sum() + (size - len(above)) / len(tied) * tied.sum()) / size)


def test_constant_score(spark):
    df = spark.createDataFrame([(1, 0.4), (0, 0.4), (0, 0.4), (1, 0.4)], "y int, p double")
    got = ranking.performance(df, [], "y", "p").first()
    assert got.average_precision == 0.5 and got.roc_auc == 0.5 and got.top10_lift == 1.0
    assert ranking.calibration(df, [], "y", "p").count() == 1


def test_calibration_matches_quantile_cut(spark, slicing):
    pdf = skewed().assign(p=lambda d: (1 / (1 + np.exp(-d.v))).round(2))
    got = ranking.calibration(spark.createDataFrame(pdf), [], "y", "p").toPandas().sort_values("risk_bin")
    want = pdf.groupby(pd.qcut(pdf.p, 10, labels=False, duplicates="drop") + 1).agg(n=("y", "size"), rate=("y", "mean"))
    assert got.n.tolist() == want.n.tolist() and np.allclose(got.observed_rate, want.rate)


def test_top_fraction_breaks_ties_by_key(spark, slicing):
    df = spark.createDataFrame([(k, 0.5) for k in "dcba"] + [("e", 0.9)], "k string, p double")
    chosen = ranking.ranked_rows(df, "p", ["k"]).filter(ranking.selected(0.45)).toPandas()
    assert chosen.sort_values("selection_rank").k.tolist() == ["e", "a", "b"]


def test_curve_starts_at_origin(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.4)], "y int, p double")
    points = {(r.recall, r.precision, r.false_positive_rate) for r in ranking.ranking_curve(df, [], "y", "p").collect()}
    assert points == {(0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (1.0, 0.5, 1.0)}
