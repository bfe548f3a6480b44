"""Least squares with fixed effects of any number of levels, absorbed instead of dummied.

Outcome and regressors lose the means of each factor's levels in turn until no mean is left
(with one factor once is enough). Regressing what remains gives the coefficients of the form
with dummies; the removed means, combined with the coefficients, are the effects. A round
is one aggregation and one join a factor, and the plan does not grow with the levels, which
stay tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.session import broadcast_checked, freeze


@dataclass
class Absorbed:
    """``coefficients`` by regressor; ``effects`` by factor: a table (factor, effect)."""

    outcome: str
    numeric: tuple[str, ...]
    coefficients: dict[str, float]
    effects: dict[str, DataFrame]
    rounds: int


def _dot(columns: Sequence[str], weights: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for c in columns:
        total = total + F.col(c) * F.lit(weights[c])
    return total


def fit(rows: DataFrame, outcome: str, numeric: Sequence[str], factors: Sequence[str], tolerance: float = 1e-10, most_rounds: int = 500) -> Absorbed:
    """Fit complete rows: those with a finite outcome and regressors and no NULL factor.

    ``tolerance`` is the largest level mean, in units of the column's deviation, that may be
    left. Collinear regressors (also those that the factors determine) are an error, as is a
    factor structure that does not settle within ``most_rounds``.
    """
    if not factors or not numeric:
        raise ValueError("Absorbing needs a factor and a regressor")
    values = [outcome, *numeric]
    names = {c: f"_v{k}" for k, c in enumerate(values)}
    levels = {f: f"_f{k}" for k, f in enumerate(factors)}
    held = list(names.values())
    clean = rows.select(*[M.finite(F.col(c).cast("double")).alias(n) for c, n in names.items()], *[F.col(f).alias(n) for f, n in levels.items()]).dropna()
    left = freeze(clean)
    start = left.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(c).alias(c) for c in held]).first()
    if not start["n"]:
        raise ValueError("No complete training rows")
    spread = {c: start[c] or 1.0 for c in held}

    removed: dict[str, list[DataFrame]] = {n: [] for n in levels.values()}
    for number in range(1, most_rounds + 1):
        largest = 0.0
        for level in levels.values():
            means = freeze(left.groupBy(level).agg(*[F.avg(c).alias(f"{c}_mean") for c in held]))
            if len(levels) > 1:
                off = means.agg(*[F.max(F.abs(F.col(f"{c}_mean"))).alias(c) for c in held]).first()
                largest = max(largest, *[off[c] / spread[c] for c in held])
            removed[level].append(means)
            left = left.join(broadcast_checked(means), level).select(*levels.values(), *[(F.col(c) - F.col(f"{c}_mean")).alias(c) for c in held])
        left = freeze(left)
        if len(levels) == 1 or largest <= tolerance:
            break
    else:
        raise ValueError(f"Fixed effects did not settle within {most_rounds} rounds")

    pairs = [(a, b) for k, a in enumerate(held) for b in held[k:]]
    sums = left.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for a, b in pairs]).first()
    gram = np.zeros((len(held), len(held)))
    for a, b in pairs:
        i, j = held.index(a), held.index(b)
        gram[i, j] = gram[j, i] = sums[f"{a}{b}"]
    scale = np.array([spread[c] for c in held]) * np.sqrt(start["n"])
    design = gram[1:, 1:] / np.outer(scale[1:], scale[1:])
    if np.linalg.eigvalsh(design)[0] < 1e-12:
        raise ValueError("Regressors are collinear once the factors are taken out")
    slopes = np.linalg.solve(design, gram[1:, 0] / (scale[1:] * scale[0])) * scale[0] / scale[1:]
    coefficients = dict(zip(numeric, slopes.tolist()))
    by_name = {f"{names[c]}_mean": b for c, b in coefficients.items()}
    effects = {}
    for factor, level in levels.items():
        every = removed[level][0]
        for means in removed[level][1:]:
            every = every.unionByName(means)
        total = every.groupBy(level).agg(*[F.sum(f"{c}_mean").alias(f"{c}_mean") for c in held])
        effects[factor] = freeze(total.select(F.col(level).alias(factor), (F.col(f"{names[outcome]}_mean") - _dot(list(by_name), by_name)).alias("effect")))
    return Absorbed(outcome, tuple(numeric), coefficients, effects, number)


def predict(model: Absorbed, rows: DataFrame, name: str = "expected_rate") -> DataFrame:
    """``rows`` whose regressors are finite and whose levels were all trained, with the fitted value."""
    marks = {f: f"_effect{k}" for k, f in enumerate(model.effects)}
    out = rows.filter(" AND ".join(f"`{c}` IS NOT NULL" for c in model.numeric)).filter(F.forall(F.array(*[F.col(c).cast("double") for c in model.numeric]), lambda x: M.finite(x).isNotNull()))
    for factor, effect in model.effects.items():
        out = out.join(broadcast_checked(effect.withColumnRenamed("effect", marks[factor])), factor)
    total = _dot(model.numeric, model.coefficients)
    for mark in marks.values():
        total = total + F.col(mark)
    return out.select(*rows.columns, total.alias(name))
