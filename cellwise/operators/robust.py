"""Huber regression by iteratively reweighted least squares."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.operators.ordered import select_quantile
from cellwise.session import freeze

# Fixed value: the third quartile of the standard normal distribution.
NORMAL_Q3 = 0.6744897501960817


def huber(
    rows: DataFrame, outcome: str, prediction: str, threshold: float = 1.345, tolerance: float = 1e-8, rounds: int = 50
) -> LinearRegressionModel:
    """The fitted model of ``rows`` (features, ``outcome``); it predicts into ``prediction``.

    Starts from least squares. Each round takes the scale (exact median of the absolute
    residuals over the normal quartile), gives a row the weight min(1, threshold / |residual
    / scale|) and fits again, until no coefficient moves by more than ``tolerance``. A round
    is one weighted normal-equation pass and the selection of a median; nothing but sums and
    the values around the median leaves the tasks. A perfect fit (scale 0) ends the rounds.
    """
    stored = freeze(rows.select("features", F.col(outcome).cast("double").alias(outcome)))
    weight = "weight"
    while weight in (outcome, prediction):
        weight = f"_{weight}"

    def line(weighted: DataFrame, **extra) -> LinearRegressionModel:
        return LinearRegression(labelCol=outcome, solver="normal", regParam=0.0, predictionCol=prediction, **extra).fit(weighted)

    fitted = line(stored)
    for _ in range(rounds - 1):
        missed = fitted.transform(stored).select("features", outcome, F.abs(F.col(outcome) - F.col(prediction)).alias("off"))
        scale = select_quantile(missed, "off", 0.5) / NORMAL_Q3
        if scale == 0:
            break
        ratio = F.lit(threshold * scale) / F.col("off")
        before, fitted = fitted, line(missed.withColumn(weight, F.when(F.col("off") <= threshold * scale, F.lit(1.0)).otherwise(ratio)), weightCol=weight)
        moved = max([abs(a - b) for a, b in zip([*before.coefficients, before.intercept], [*fitted.coefficients, fitted.intercept])])
        if moved <= tolerance:
            break
    return fitted
