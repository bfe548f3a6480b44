"""Models and their diagnostics against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.operators import modeling as H


def sample(n=500, seed=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(3, 2, n), "k": rng.choice(["u", "v", "w"], n), "year": rng.integers(2000, 2004, n)})
    logit = 0.8 * (pdf.a - 3) + pdf.k.map({"u": 0.0, "v": 1.0, "w": -1.0}) - 0.3
    return pdf.assign(y=(rng.random(n) < 1 / (1 + np.exp(-logit))).astype(int))


def newton(pdf, ridge=1e-5):
    """Logistic regression with an unpenalised intercept: mean loss + ridge / 2 of the squares."""
    x = np.column_stack([np.ones(len(pdf)), (pdf.a - pdf.a.mean()) / pdf.a.std(ddof=0), pdf.k == "v", pdf.k == "w"]).astype(float)
    penalty = np.diag([0.0, ridge, ridge, ridge])
    beta = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (p - pdf.y) / len(pdf) + penalty @ beta
        beta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(pdf) + penalty, gradient)
    return beta, x


@pytest.fixture(scope="module")
def fitted(spark):
    pdf = sample()
    rows = spark.createDataFrame(pdf).repartition(3)
    return pdf, rows, H.fit_classifier(rows, "y", H.Spec(("a",), ("k",)))


def test_logistic_is_the_ridge_optimum(spark, fitted):
    pdf, rows, model = fitted
    beta, x = newton(pdf)
    got = {r.term: r.coefficient for r in H.logistic_coefficients(model, spark).collect()}
    assert np.allclose([got["const"], got["a"], got["k=v"], got["k=w"]], beta, atol=1e-4)
    scored = H.predict_probability(model, rows).toPandas().sort_values("id")
    assert np.allclose(scored.probability, 1 / (1 + np.exp(-x @ beta)), atol=1e-4)
    unseen = H.predict_probability(model, spark.createDataFrame([(3.0, "zz")], "a double, k string")).first().probability
    assert unseen == pytest.approx(1 / (1 + np.exp(-(beta[0] + beta[1] * (3 - pdf.a.mean()) / pdf.a.std(ddof=0)))), abs=1e-4)


def test_partial_dependence(spark, fitted):
    pdf, rows, model = fitted
    got = H.partial_dependence(model, rows, ["a"], ["id"], grid_size=4, sample_rows=500).toPandas().sort_values("feature_value")
    grid = np.quantile(pdf.a, np.linspace(0.05, 0.95, 4))
    beta, x = newton(pdf)
    want = []
    for value in grid:
        x[:, 1] = (value - pdf.a.mean()) / pdf.a.std(ddof=0)
        want.append((1 / (1 + np.exp(-x @ beta))).mean())
    assert np.allclose(got.feature_value, grid) and np.allclose(got.mean_probability, want, atol=1e-4)


def test_leave_one_out_scores_the_other_levels(spark):
    pdf = sample()
    rows = spark.createDataFrame(pdf.assign(fold="f", split_role=np.where(pdf.year < 2003, "training", "validation")))
    got = H.leave_one_out(rows, "k", ["f"], "y", H.Spec(("a",), ("k",))).toPandas()
    checked = pdf[pdf.year == 2003]
    counts = sorted(int((checked.k != level).sum()) for level in "uvw")
    assert sorted(got.n.astype(int)) == counts


def test_out_of_fold_trains_on_training_rows_only(spark):
    pdf = sample()
    training = pdf.year < 2003
    rows = spark.createDataFrame(pdf.assign(fold="f", split_role=np.where(training, "training", "validation")))
    got = H.out_of_fold(rows, ["f"], "y", H.Spec(("a",), ("k",))).toPandas().sort_values("id")
    alone = H.predict_probability(H.fit_classifier(spark.createDataFrame(pdf[training]), "y", H.Spec(("a",), ("k",))), spark.createDataFrame(pdf[~training])).toPandas().sort_values("id")
    assert got.id.tolist() == pdf[~training].id.tolist() and np.allclose(got.probability, alone.probability, atol=1e-9)


def test_tuning_takes_the_first_of_equal_candidates(spark):
    pdf = sample()
    rows = spark.createDataFrame(pdf.assign(year=pdf.year))
    grid = [{"regParam": 1.0}, {"regParam": 1e-5}, {"regParam": 1e-5}]
    best, table = H.tune(rows, "y", H.Spec(("a",), ("k",)), "logistic", grid, "year")
    found = {r.candidate_id: r.inner_ap for r in table.collect()}
    assert found[2] == found[3] and best is grid[max(found, key=lambda k: (found[k], -k)) - 1]


def test_permuting_keeps_rows_and_values(spark):
    pdf = sample()
    got = H.permuted(spark.createDataFrame(pdf), "a", ["id"], 3).toPandas().sort_values("id")
    assert sorted(got.a) == sorted(pdf.a) and (got.a.to_numpy() != pdf.a.to_numpy()).mean() > 0.9
    assert got.drop(columns="a").reset_index(drop=True).equals(pdf.drop(columns="a"))
    assert H.permuted(spark.createDataFrame(pdf), "a", ["id"], 3).filter(F.col("a").isNull()).isEmpty()
