"""Evaluation, bootstrap, sampling and model behaviour."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.operators import bootstrap, ranking, sampling
from cellwise.operators import evaluation as E
from cellwise.operators import modeling as H


def test_bootstrap_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"c": rng.choice(list("abcdefg"), 300), "y": rng.integers(0, 2, 300), "p": rng.integers(0, 20, 300) / 20})
    for coalesce in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
        got = bootstrap.replicate_precision(spark.createDataFrame(pdf), "c", "y", "p", 12, 7).toPandas()
        got = got.set_index("replicate").average_precision
        weights = bootstrap.draw_weights(7, 0, 12, 7)
        for r in range(12):
            w = pdf.c.map(dict(zip("abcdefg", weights[r]))).to_numpy()
            positives = (w * pdf.y).sum()
            ap = sum(
                (w * pdf.y)[pdf.p == s].sum() / positives * (w * pdf.y)[pdf.p >= s].sum() / w[pdf.p >= s].sum()
                for s in pdf.p.unique() if w[pdf.p >= s].sum()
            )
            assert got[r] == pytest.approx(ap)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_draws_are_addressable_and_whole():
    every = bootstrap.draw_weights(5, 0, 300, 1000)
    assert (every.sum(axis=1) == 1000).all() and every.min() >= 0
    some = np.array([0, 3, 64, 500, 501, 999])
    assert np.array_equal(bootstrap.cluster_draws(5, 1, 1000, some), every[128:256][:, some])
    assert np.array_equal(bootstrap.draw_weights(5, 130, 133, 1000), every[130:133])
    # as many zeros, ones and twos as draws with replacement have
    assert np.allclose([(every == k).mean() for k in range(3)], [np.exp(-1), np.exp(-1), np.exp(-1) / 2], atol=0.01)
    assert abs(np.corrcoef(every[:, 10], every[:, 700])[0, 1]) < 0.2
    huge = bootstrap.cluster_draws(5, 0, 10**8, np.array([7, 10**8 - 1]))
    assert huge.shape == (128, 2) and huge.max() < 12


def test_a_score_of_all_clusters_spreads_over_slices(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"c": np.arange(600) % 150, "y": rng.integers(0, 2, 600), "p": np.where(np.arange(600) < 450, 0.5, np.round(rng.random(600), 1))})
    monkeypatch.setattr(bootstrap, "BLOCK_CELLS", 128 * 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.createDataFrame(pdf)
    cells = df.groupBy(F.col("p").alias("score"), "c").count()
    sliced = bootstrap.order_slices(cells, [], [F.col("score").desc(), F.col("c").asc()])
    assert sliced.filter("score = 0.5").select(bootstrap.SLICE).distinct().count() > 2
    got = bootstrap.replicate_precision(df, "c", "y", "p", 6, 9).toPandas().set_index("replicate").average_precision
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for r, w in enumerate(bootstrap.draw_weights(9, 0, 6, 150)):
        w = w[pdf.c.to_numpy()]
        y = w * pdf.y
        ap = sum(y[pdf.p == s].sum() / y.sum() * y[pdf.p >= s].sum() / w[pdf.p >= s].sum() for s in pdf.p.unique() if w[pdf.p >= s].sum())
        assert got[r] == pytest.approx(ap)


def test_one_class_replicates_are_dropped(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("b", 0, 0.1)], "c string, y int, p double")
    got = bootstrap.replicate_precision(df, "c", "y", "p", 40, 1).count()
    weights = bootstrap.draw_weights(1, 0, 40, 2)
    assert got == int((weights == 1).all(axis=1).sum()) < 40


def test_paired_bootstrap_is_repeatable(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(
        pd.DataFrame({"c": rng.integers(0, 9, 200), "y": rng.integers(0, 2, 200), "a": rng.random(200), "b": rng.random(200)})
    )
    run = lambda d: bootstrap.paired_bootstrap(d, "c", "y", {"a": "a", "b": "b"}, ("a", "b"), 10, 3).orderBy("replicate").toPandas()
    first, second = run(df), run(df.repartition(5))
    pd.testing.assert_frame_equal(first, second)
    assert np.allclose(first.a_minus_b, first.a - first.b)
    with pytest.raises(ValueError):
        bootstrap.paired_bootstrap(df, "c", "y", {"a": "a"}, ("a", "b"))


def test_standardisation(spark):
    ref = spark.createDataFrame([("s", 0), ("s", 0), ("t", 1), ("u", 1)][:3], "k string, y int")
    comp = spark.createDataFrame([("s", 1), ("s", 0), ("t", 1)], "k string, y int")
    got = E.standardized_prevalence(ref, comp, ["k"], "y").first()
    assert got.standardized_prevalence == pytest.approx(2 / 3 * 0.5 + 1 / 3)
    with pytest.raises(Exception, match="stratum"):
        E.standardized_prevalence(ref, comp.filter("k = 's'"), ["k"], "y").collect()


def test_unseen_group_fails_closed(spark):
    rates = E.prevalence_scores(spark.createDataFrame([("s", 1), ("s", 0)], "k string, y int"), "k", "y")
    rows = spark.createDataFrame([("s",), ("t",)], "k string")
    with pytest.raises(Exception, match="Unseen group: t"):
        E.score_by_group(rows, rates, "k", "p").collect()
    got = {r.k: r.p for r in E.score_by_group(rows, rates, "k", "p", 0.1).collect()}
    assert got == {"s": 0.5, "t": 0.1}


def test_mean_difference_variants(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 1.0), (False, 2.0), (False, 2.0)], "i boolean, v double")
    assert E.mean_differences(df, "i", ["v"]).first().smd is None
    assert E.mean_differences(df, "i", ["v"], "limit").first().smd == float("inf")


def test_label_agreement(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "a int, b int")
    got = E.label_agreement(df, [], "a", "b").first()
    assert (got.agreement, got.positive_jaccard) == (0.75, 0.5) and got.cohen_kappa == pytest.approx(0.5)


def test_exclusion_reasons_overlap(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0), (float("inf"), 1.0)], "t double, p double")
    marked = E.eligibility(df, ["t"], ["p"])
    got = {r.reason: r.excluded_n for r in E.exclusion_reasons(marked, ["t"], ["p"]).collect()}
    assert got["target inputs incomplete"] == 2 and got["predictor inputs incomplete"] == 2 and got["both incomplete"] == 1
    assert got["missing p"] == 2


def test_confusion_with_row_thresholds(spark):
    df = spark.createDataFrame([(1, 0.3, 0.2), (0, 0.3, 0.4), (1, 0.1, 0.2), (0, 0.9, 0.2)], "y int, p double, t double")
    got = ranking.confusion(df, [], "y", "p", F.col("t")).first()
    assert (got.true_positive, got.false_positive, got.true_negative, got.false_negative) == (1, 1, 1, 1)


def test_split_is_stable_and_disjoint(spark):
    df = spark.createDataFrame([(str(i),) for i in range(200)], "g string")
    split = sampling.group_split(df.unionAll(df), "g")
    assert split.count() == 200 and sampling.overlapping_groups(split, "g").isEmpty()
    sample = sampling.seeded_sample(df, ["g"], 20, 9).toPandas().g.tolist()
    assert sample == sampling.seeded_sample(df.repartition(7), ["g"], 20, 9).toPandas().g.tolist()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(8)
    n = 1200
    pdf = pd.DataFrame({
        "id": np.arange(n), "yr": rng.integers(2010, 2016, n), "ind": rng.choice(["a", "b", "c"], n),
        "x": rng.normal(size=n), "z": rng.normal(size=n),
    })
    pdf["rate"] = 5 + 2 * pdf.x + (pdf.ind == "b") * 1.5 + (pdf.yr - 2010) * 0.3 + rng.normal(size=n) * 0.1
    pdf["gap"] = (rng.random(n) < 1 / (1 + np.exp(-pdf.x * 2 + 1))).astype(int)
    return spark.createDataFrame(pdf)


SPEC = H.Spec(("x", "z"), ("ind",), "yr")


def test_expected_rate_matches_least_squares(spark, panel):
    model = H.fit_expected(panel.filter("yr <= 2013"), "rate", SPEC, 2013, "yr")
    got = H.predict_expected(model, panel).toPandas().sort_values("id")
    train = got[got.yr <= 2013]

    def design(d):
        years = [np.minimum(d.yr, 2013) == y for y in (2011, 2012, 2013)]
        return np.column_stack([np.ones(len(d)), d.x, d.z, d.ind == "b", d.ind == "c", *years]).astype(float)

    beta, *_ = np.linalg.lstsq(design(train), train.rate, rcond=None)
    assert np.allclose(got.expected_rate, design(got) @ beta, atol=1e-8)
    assert np.allclose(got.residual, got.rate - got.expected_rate)
    with pytest.raises(ValueError, match="after the cutoff"):
        H.fit_expected(panel, "rate", SPEC, 2013, "yr")


def test_classifier_state_comes_from_training_only(spark, panel):
    training = panel.filter("yr <= 2013")
    fitted = H.fit_classifier(training, "gap", SPEC)
    later = panel.filter("yr > 2013")
    shifted = later.withColumn("gap", 1 - F.col("gap"))
    a = H.predict_probability(fitted, later).select("id", "probability").toPandas().sort_values("id")
    b = H.predict_probability(fitted, shifted).select("id", "probability").toPandas().sort_values("id")
    assert np.allclose(a.probability, b.probability) and a.probability.between(0, 1).all()
    unseen = H.predict_probability(fitted, later.withColumn("ind", F.lit("new"))).toPandas()
    base = H.predict_probability(fitted, later.withColumn("ind", F.lit("a"))).toPandas()
    assert np.allclose(unseen.sort_values("id").probability, base.sort_values("id").probability)
    with pytest.raises(ValueError, match="both classes"):
        H.fit_classifier(training.filter("gap = 1"), "gap", SPEC)
    metrics = ranking.performance(H.predict_probability(fitted, later), [], "gap", "probability").first()
    assert metrics.roc_auc > 0.75


def test_inner_split_is_forward(panel):
    fit, check = H.inner_split(panel, "yr")
    assert fit.agg(F.max("yr")).first()[0] < check.agg(F.min("yr")).first()[0]
    with pytest.raises(ValueError):
        H.inner_split(panel.filter("yr = 2010"), "yr")


def test_permutation_moves_one_column(panel):
    moved = H.permuted(panel, "x", ["id"], 3).toPandas().sort_values("id").reset_index(drop=True)
    base = panel.toPandas().sort_values("id").reset_index(drop=True)
    assert sorted(moved.x) == sorted(base.x) and not np.allclose(moved.x, base.x)
    assert np.allclose(moved.z, base.z) and (moved.ind == base.ind).all()


def test_winsorize_uses_training_bounds(spark):
    train = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    rows = spark.createDataFrame([(-5.0,), (50.0,), (500.0,), (None,)], "v double")
    assert [r.c for r in H.winsorize(train, rows, "v", "c").collect()] == [1.0, 50.0, 99.0, None]


def test_spec_variants():
    assert SPEC.without("x").numeric == ("z",)
    assert SPEC.replacing("x", "x", "w").numeric == ("x", "w", "z")
    with pytest.raises(ValueError):
        H.Spec(("x",)).without("x")
