"""Absorbed fixed effects against the form with dummies in NumPy."""

import numpy as np
import pandas as pd
import pytest

from cellwise.operators import absorb


def dummies(values):
    levels = sorted(set(values))
    return np.array([[float(v == level) for level in levels] for v in values])


def sample(n=400, seed=3):
    rng = np.random.default_rng(seed)
    f, g = rng.integers(0, 12, n), rng.integers(0, 4, n)
    x = rng.normal(size=(n, 2)) + 0.2 * f[:, None]
    y = x @ [2.0, -1.0] + 0.5 * f - g + rng.normal(size=n)
    return pd.DataFrame({"f": [f"l{v}" for v in f], "g": g, "a": x[:, 0], "b": x[:, 1], "y": y})


@pytest.mark.parametrize("factors", [["f"], ["g", "f"]])
def test_same_as_with_dummies(spark, factors):
    pdf = sample()
    design = np.column_stack([pdf[["a", "b"]].to_numpy(), *[dummies(pdf[f]) for f in factors]])
    beta = np.linalg.lstsq(design, pdf.y, rcond=None)[0]
    rows = spark.createDataFrame(pdf).repartition(4)
    model = absorb.fit(rows, "y", ["a", "b"], factors, tolerance=1e-9)
    assert np.allclose([model.coefficients[c] for c in "ab"], beta[:2], atol=1e-8)
    got = absorb.predict(model, rows).toPandas().sort_values(["a"])
    assert np.allclose(got.expected_rate, (design @ beta)[np.argsort(pdf.a)], atol=1e-7)
    assert (model.rounds == 1) == (len(factors) == 1)


def test_many_levels_do_not_enter_the_plan(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"f": np.arange(15_000) % 5000, "a": rng.normal(size=15_000)})
    pdf["y"] = 3 * pdf.a + np.sin(pdf.f) + rng.normal(size=15_000) * 0.01
    model = absorb.fit(spark.createDataFrame(pdf), "y", ["a"], ["f"])
    centred = pdf[["y", "a"]] - pdf.groupby("f")[["y", "a"]].transform("mean")
    assert model.coefficients["a"] == pytest.approx((centred.y * centred.a).sum() / (centred.a**2).sum(), abs=1e-9)
    assert model.effects["f"].count() == 5000


def test_rows_that_cannot_be_used(spark):
    rows = [("k", 1.0, 2.0), ("k", 2.0, 3.5), ("m", 1.0, 5.0), ("m", 3.0, 9.0), (None, 1.0, 1.0), ("k", None, 1.0), ("k", float("nan"), 1.0), ("m", 4.0, None)]
    df = spark.createDataFrame(rows, "f string, a double, y double")
    model = absorb.fit(df, "y", ["a"], ["f"])
    assert model.coefficients["a"] == pytest.approx((0.75 + 4) / (0.5 + 2))  # products and squares inside k and m
    new = spark.createDataFrame([("k", 1.0), ("z", 1.0), ("k", None), (None, 1.0)], "f string, a double")
    assert [r.f for r in absorb.predict(model, new).collect()] == ["k"]
    with pytest.raises(ValueError, match="collinear"):
        absorb.fit(df.selectExpr("f", "a", "2 * a AS b", "y"), "y", ["a", "b"], ["f"])
    with pytest.raises(ValueError, match="complete"):
        absorb.fit(df.filter("f IS NULL"), "y", ["a"], ["f"])
