"""Residual thresholds, labels, temporal folds and label summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators.ordered import quantiles
from cellwise.operators.profile import medians

# Label columns per threshold definition.
LABELS = {"p10": "gap_p10", "p20": "gap_p20", "p25": "gap_p25", "mean_minus_1sd": "gap_minus_1sd"}
THRESHOLD_QUANTILES = {"residual_p10": 0.10, "residual_p20": 0.20, "residual_p25": 0.25}


@dataclass(frozen=True)
class Fold:
    """Expanding fold: train on predictor years first..train_last, then evaluate."""

    name: str
    first: int
    train_last: int
    eval_first: int
    eval_last: int
    horizon: int
    holdout: bool = False

    @property
    def fit_last(self) -> int:
        return self.train_last + self.horizon

    def validate(self) -> None:
        if self.first > self.train_last or self.eval_first > self.eval_last:
            raise ValueError(f"{self.name}: empty year range")
        if self.train_last >= self.eval_first:
            raise ValueError(f"{self.name}: training predictors overlap evaluation predictors")
        if self.fit_last >= self.eval_first + self.horizon:
            raise ValueError(f"{self.name}: training outcomes overlap evaluation targets")


def validate_folds(folds: Sequence[Fold]) -> None:
    """One holdout, last; evaluation target periods advance without overlap."""
    if not folds or not folds[-1].holdout or sum(f.holdout for f in folds) != 1:
        raise ValueError("Exactly one holdout is required and it must be the last fold")
    previous = None
    for fold in folds:
        fold.validate()
        if previous is not None and fold.eval_first <= previous:
            raise ValueError("Evaluation periods must advance without overlap")
        if not fold.holdout:
            previous = fold.eval_last


def expanding_folds(first: int, development_last: int, holdout_last: int, horizon: int, start: int = 2) -> list[Fold]:
    """One fold per evaluation year after ``start`` training years, then the holdout.

    Training outcomes of a fold must be known before its evaluation targets, which
    holds because every training predictor year is before the evaluation year.
    """
    folds = [
        Fold(f"fold_{i}", first, year - 1, year, year, horizon)
        for i, year in enumerate(range(first + start, development_last + 1), start=1)
    ]
    folds.append(Fold("final_holdout", first, development_last, development_last + 1, holdout_last, horizon, True))
    validate_folds(folds)
    return folds


def fold_table(spark, folds: Sequence[Fold]) -> DataFrame:
    return spark.createDataFrame(
        [(f.name, f.first, f.train_last, f.eval_first, f.eval_last, f.fit_last, f.holdout) for f in folds],
        "fold string, first int, train_last int, eval_first int, eval_last int, fit_last int, holdout boolean",
    )


def assign_folds(pairs: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    """(row x fold x role): roles come from literal ranges, so no join is needed."""
    year = F.col("predictor_year")
    roles = F.array(
        *[
            F.when(
                year.between(f.first, f.train_last),
                F.struct(F.lit(f.name).alias("fold"), F.lit("training").alias("split_role")),
            ).when(
                year.between(f.eval_first, f.eval_last),
                F.struct(F.lit(f.name).alias("fold"), F.lit("validation").alias("split_role")),
            )
            for f in folds
        ]
    )
    return pairs.withColumn("_role", F.explode(F.array_compact(roles))).select("*", "_role.*").drop("_role")


def fold_counts(pairs: DataFrame, folds: Sequence[Fold]) -> DataFrame:
    return assign_folds(pairs, folds).groupBy("fold").agg(
        F.count_if(F.col("split_role") == "training").alias("train_pairs"),
        F.count_if(F.col("split_role") == "validation").alias("validation_pairs"),
    )


def thresholds(residuals: DataFrame, keys: Sequence[str], residual: str = "residual") -> DataFrame:
    """Cutoffs of the finite training residuals per fold, linear interpolation."""
    clean = residuals.select(*keys, M.finite(F.col(residual)).alias("_r")).filter(F.col("_r").isNotNull())
    moments = clean.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("train_n"),
        F.avg("_r").alias("residual_mean"),
        F.coalesce(F.stddev_samp("_r"), F.lit(0.0)).alias("residual_sd"),
    )
    cuts = quantiles(clean, keys, "_r", THRESHOLD_QUANTILES)
    if not keys:
        moments, cuts, keys = moments.withColumn("_g", F.lit(1)), cuts.withColumn("_g", F.lit(1)), ["_g"]
    both = moments.join(cuts, list(keys)).drop("_g")
    return both.withColumn("residual_minus_1sd", F.col("residual_mean") - F.col("residual_sd")).withColumn(
        "primary_threshold", F.col("residual_p20")
    )


def frozen_cutoff(residuals: DataFrame, residual: str, p: float = 0.2) -> float:
    """The single number a later holdout run must reproduce."""
    return quantiles(residuals, [], residual, {"c": p}).first()["c"]


def with_labels(rows: DataFrame, cutoffs: DataFrame, keys: Sequence[str], residual: str) -> DataFrame:
    """Inclusive labels and the margin to the primary cutoff; rows without residual drop out.

    ``cutoffs`` has one row per fold of the design, so its broadcast is bounded by
    the number of folds.
    """
    columns = {"p10": "residual_p10", "p20": "residual_p20", "p25": "residual_p25", "mean_minus_1sd": "residual_minus_1sd"}
    small = cutoffs.select(*keys, *columns.values())
    joined = rows.filter(F.col(residual).isNotNull()).join(F.broadcast(small), list(keys))
    labelled = joined.withColumns({LABELS[d]: (F.col(residual) <= F.col(c)).cast("int") for d, c in columns.items()})
    return (
        labelled.withColumn("primary_threshold", F.col("residual_p20"))
        .withColumn("gap_margin", F.col(residual) - F.col("residual_p20"))
        .drop(*columns.values())
    )


def threshold_changes(cutoffs: DataFrame, fold: str = "fold", value: str = "primary_threshold") -> DataFrame:
    """Change against the previous fold; one row per fold, so one window task is bounded."""
    before = F.lag(value).over(Window.orderBy(fold))
    change = F.abs(F.col(value) - before)
    return cutoffs.select(
        fold,
        value,
        change.alias("abs_change"),
        M.divide(change, F.abs(before)).alias("relative_change"),
        F.coalesce((F.col(value) < 0) == (before < 0), F.lit(True)).alias("direction_stable"),
    )


def prevalence(rows: DataFrame, keys: Sequence[str], labels: Mapping[str, str] = LABELS) -> DataFrame:
    """Eligible, positive and share per label definition and group, in one pass."""
    cells = F.array(
        *[F.struct(F.lit(d).alias("threshold_definition"), F.col(c).alias("_y")) for d, c in labels.items()]
    )
    counts = (
        rows.select(*keys, F.inline(cells))
        .groupBy("threshold_definition", *keys)
        .agg(F.count("_y").alias("eligible_n"), F.sum("_y").alias("gap_n"))
    )
    return counts.select(
        "threshold_definition",
        *keys,
        "eligible_n",
        "gap_n",
        (F.col("eligible_n") - F.col("gap_n")).alias("non_gap_n"),
        M.divide(F.col("gap_n"), F.col("eligible_n")).alias("gap_prevalence"),
    )


def label_summary(rows: DataFrame, group: str, label: str, residual: str, threshold: str, min_n: int = 30) -> DataFrame:
    base = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("eligible_n"),
        F.sum(label).alias("gap_n"),
        F.avg(threshold).alias("mean_threshold"),
        F.avg(label).alias("gap_prevalence"),
    )
    middle = medians(rows, [group], {residual: "median_residual", threshold: "median_threshold"})
    return (
        base.join(middle, group)
        .withColumn("non_gap_n", F.col("eligible_n") - F.col("gap_n"))
        .withColumn("median_margin", F.col("median_residual") - F.col("median_threshold"))
        .withColumn("included", F.col("eligible_n") >= min_n)
    )


def contingency(rows: DataFrame, first: str, second: str) -> DataFrame:
    """Counts of two binary labels and each cell's share of either positive class."""
    counts = rows.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy()
    positives = lambda c: F.greatest(F.lit(1), F.sum(F.when(F.col(c) == 1, F.col("n")).otherwise(0)).over(whole))
    return counts.select(
        first,
        second,
        "n",
        F.when(F.col(second) == 1, F.col("n") / positives(second)).alias("share_of_second"),
        F.when(F.col(first) == 1, F.col("n") / positives(first)).alias("share_of_first"),
    )


def rate_by_group(rows: DataFrame, group: str, label: str, value: str) -> DataFrame:
    return rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("eligible_n"),
        F.sum(label).alias("gap_n"),
        F.min(value).alias("value_min"),
        F.max(value).alias("value_max"),
        F.avg(label).alias("gap_prevalence"),
    )


def outcome_by_label(rows: DataFrame, label: str, value: str) -> DataFrame:
    """Mean, median, upper quartile and share above the pooled median, per label."""
    pooled = quantiles(rows, [], value, {"m": 0.5}).select("m").scalar()
    base = rows.withColumn("_above", (F.col(value) > pooled).cast("double")).groupBy(label).agg(
        F.count(F.lit(1)).alias("eligible_n"),
        F.avg(value).alias("mean_value"),
        F.avg(F.coalesce("_above", F.lit(0.0))).alias("share_above_median"),
    )
    return base.join(quantiles(rows, [label], value, {"median_value": 0.5, "p75_value": 0.75}), label)


def selection_audit(pairs: DataFrame, complete: str, dimensions: Mapping[str, str], variables: Sequence[str]) -> DataFrame:
    """Included and excluded pairs with variable means, overall and per dimension value."""
    unfolded = F.array(
        F.struct(F.lit("all").alias("group_type"), F.lit("all").alias("group_value")),
        *[F.struct(F.lit(n).alias("group_type"), F.col(c).cast("string").alias("group_value")) for n, c in dimensions.items()],
    )
    stats: list[Column] = []
    for v in variables:
        for status, test in (("included", F.col(complete)), ("excluded", ~F.col(complete))):
            stats.append(F.count(F.when(test, F.col(v))).alias(f"{v}_{status}_n"))
            stats.append(F.avg(F.when(test, F.col(v))).alias(f"{v}_{status}_mean"))
    return (
        pairs.select(complete, *variables, F.inline(unfolded))
        .groupBy("group_type", "group_value")
        .agg(
            F.count(F.lit(1)).alias("exact_pairs"),
            F.count_if(F.col(complete)).alias("complete_pairs"),
            F.count_if(~F.col(complete)).alias("excluded_pairs"),
            F.avg(F.col(complete).cast("double")).alias("inclusion_rate"),
            *stats,
        )
    )


def negative_expected(rows: DataFrame, keys: Sequence[str], expected: str, label: str) -> DataFrame:
    below = F.col(expected) < 0
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(below).alias("negative_n"),
        F.coalesce(F.sum(F.when(below, F.col(label))), F.lit(0).cast("bigint")).alias("negative_gap_n"),
        F.avg(below.cast("double")).alias("negative_share"),
    )


def label_flips(rows: DataFrame, residual: str, primary: DataFrame, alternative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels that change when the cutoff is taken from an alternative residual sample."""
    cuts = primary.select(*keys, F.col("primary_threshold").alias("_p")).join(
        alternative.select(*keys, F.col("primary_threshold").alias("_a")), list(keys)
    )
    r = F.col(residual)
    return (
        rows.filter(r.isNotNull())
        .join(F.broadcast(cuts), list(keys))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("validation_n"),
            F.count_if((r <= F.col("_p")) != (r <= F.col("_a"))).alias("label_flips"),
            F.max(F.col("_a") - F.col("_p")).alias("threshold_change"),
        )
    )


def extreme_rows(rows: DataFrame, value: str, keys: Sequence[str], n: int = 15) -> DataFrame:
    ties = [F.col(k) for k in keys]
    low = rows.orderBy(F.col(value).asc_nulls_last(), *ties).limit(n).withColumn("extreme_tail", F.lit("most_negative"))
    high = rows.orderBy(F.col(value).desc_nulls_last(), *ties).limit(n).withColumn("extreme_tail", F.lit("most_positive"))
    return low.unionByName(high)
