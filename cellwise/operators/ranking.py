"""Tie-aware evaluation of ranked binary predictions.

Every metric starts from score cells (one row per group and distinct score with n
and positives), so ties are exact and hot scores collapse before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators.ordered import attach_per_group, quantiles_of, row_numbers, running_totals


def score_cells(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Descending running counts per distinct score."""
    cells = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos")
    )
    return running_totals(cells, keys, [F.col("score").desc()], ["n", "pos"])


def metric_columns() -> dict[str, Column]:
    """Average precision, ROC AUC and Brier score from score cells."""
    n, pos, neg = F.col("n"), F.col("pos"), F.col("n") - F.col("pos")
    positives, rows = F.max("total_pos"), F.max("total_n")
    negatives = rows - positives
    below = (F.col("total_n") - F.col("total_pos")) - (F.col("cum_n") - F.col("cum_pos"))
    hits = F.sum(pos * (below + neg / 2))
    steps = F.sum(pos * F.col("cum_pos") / F.col("cum_n"))
    squares = F.sum(pos * F.pow(F.col("score") - 1, 2) + neg * F.pow(F.col("score"), 2))
    return {
        "n": rows,
        "positives": positives,
        "prevalence": positives / rows,
        "average_precision": F.when(positives > 0, steps / positives),
        "roc_auc": F.when((positives > 0) & (negatives > 0), hits / (positives * negatives)),
        "brier": squares / F.sum(n),
    }


def lift_columns(cuts: Mapping[str, float]) -> dict[str, Column]:
    """Lift in the top share of rows, fractional credit for rows tied at the boundary."""
    result = {}
    for name, cut in cuts.items():
        size = F.greatest(F.lit(1), F.ceil(F.col("total_n") * F.lit(float(cut))))
        before = F.col("cum_n") - F.col("n")
        boundary = (before < size) & (size <= F.col("cum_n"))
        credit = F.col("cum_pos") - F.col("pos") + (size - before) / F.col("n") * F.col("pos")
        found = F.max(F.when(boundary, credit / size))
        overall = F.max("total_pos") / F.max("total_n")
        result[f"{name}_n"] = F.max(size)
        result[f"{name}_prevalence"] = found
        result[f"{name}_lift"] = F.when(overall > 0, found / overall)
    return result


DEFAULT_CUTS = {"top10": 0.10, "top20": 0.20, "top25": 0.25}


def performance(
    df: DataFrame, keys: Sequence[str], label: str, score: str, cuts: Mapping[str, float] = DEFAULT_CUTS
) -> DataFrame:
    """Ranking metrics and lifts per group from one ordered pass."""
    cells = score_cells(df, keys, label, score)
    columns = {**metric_columns(), **lift_columns(cuts)}
    return cells.groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()])


def guarded_performance(df: DataFrame, keys: Sequence[str], label: str, score: str, min_positives: int = 30) -> DataFrame:
    """Per-group metrics; groups with few events or one class keep counts only."""
    result = performance(df, keys, label, score, {"top10": 0.10})
    enough = (F.col("positives") >= min_positives) & (F.col("positives") < F.col("n"))
    kept = {m: F.when(enough, F.col(m)) for m in ("average_precision", "roc_auc", "brier")}
    return result.withColumn("sufficient", enough).withColumns(kept)


def ranking_curve(df: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """PR and ROC coordinates at every distinct score; an origin row has no score."""
    cells = score_cells(df, keys, label, score)
    tp, fp = F.col("cum_pos"), F.col("cum_n") - F.col("cum_pos")
    positives = F.greatest(F.lit(1), F.col("total_pos"))
    negatives = F.greatest(F.lit(1), F.col("total_n") - F.col("total_pos"))
    points = cells.select(
        *keys, "score", (tp / positives).alias("recall"), (tp / (tp + fp)).alias("precision"),
        (fp / negatives).alias("false_positive_rate"),
    )
    origin = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(
        *keys, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("false_positive_rate"),
    )
    return points.unionByName(origin)


def confusion(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: Column) -> DataFrame:
    """Counts and rates at a threshold, which may be a column (each row its own fold's)."""
    flagged = F.col(score) >= threshold
    y = F.col(label) == 1
    counts = df.groupBy(*keys).agg(
        F.count_if(flagged & y).alias("true_positive"),
        F.count_if(flagged & ~y).alias("false_positive"),
        F.count_if(~flagged & ~y).alias("true_negative"),
        F.count_if(~flagged & y).alias("false_negative"),
    )
    tp, fp = F.col("true_positive"), F.col("false_positive")
    tn, fn = F.col("true_negative"), F.col("false_negative")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    recall, precision = F.col("recall"), F.col("precision")
    return (
        counts.withColumn("recall", ratio(tp, tp + fn))
        .withColumn("precision", ratio(tp, tp + fp))
        .withColumn("f1", ratio(2 * precision * recall, precision + recall))
        .withColumn("balanced_accuracy", (recall + ratio(tn, tn + fp)) / 2)
    )


def calibration(df: DataFrame, keys: Sequence[str], label: str, score: str, bins: int = 10) -> DataFrame:
    """Quantile bins, right-closed, equal edges merged, one bin for a constant score.

    The bin of a score is its rank among the distinct edges, found per distinct
    score, not per row.
    """
    cells = df.groupBy(*keys, F.col(score).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
    run = running_totals(cells, keys, [F.col("score").asc()], ["n"])
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles_of(run, keys, "score", names).select(
        *keys, F.array_sort(F.array_distinct(F.array(*names))).alias("_edges")
    )
    marked = attach_per_group(run, edges, keys, ["_edges"])
    below = F.size(F.filter("_edges", lambda e: e < F.col("score")))
    return (
        marked.withColumn("risk_bin", F.greatest(F.lit(1), below))
        .groupBy(*keys, "risk_bin")
        .agg(
            F.sum("n").alias("n"),
            (F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("mean_score"),
            (F.sum("pos") / F.sum("n")).alias("observed_rate"),
        )
    )


def equal_count_bins(df: DataFrame, keys: Sequence[str], label: str, score: str, ties: Sequence[str], bins: int = 10) -> DataFrame:
    """Equal-count bins in a stable order of score, then tie keys."""
    order = [F.col(score).asc(), *[F.col(t).asc() for t in ties]]
    ranked = row_numbers(df, keys, order, "_place")
    index = F.least(F.lit(bins), F.floor((F.col("_place") - 1) * bins / F.col("_place_of")) + 1)
    return (
        ranked.withColumn("risk_bin", index.cast("int"))
        .groupBy(*keys, "risk_bin")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("observed_rate"))
    )


def ranked_rows(df: DataFrame, score: str, ties: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``selection_rank`` by score descending, then tie keys ascending."""
    order = [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    return row_numbers(df, keys, order, "selection_rank")


def selected(fraction: Column | float) -> Column:
    share = F.lit(float(fraction)) if not isinstance(fraction, Column) else fraction
    return F.col("selection_rank") <= F.ceil(F.col("selection_rank_of") * share)


def decision_metrics(rows: DataFrame, rules: Mapping[str, Column], label: str, score: str) -> DataFrame:
    """Workload, yield and burden of each rule, all rules in one pass over the rows."""
    y = F.col(label) == 1
    wide = rows.agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(y).alias("_positives"),
        *[
            F.struct(
                F.count_if(test).alias("flagged"),
                F.count_if(test & y).alias("hits"),
                F.min(F.when(test, F.col(score))).alias("cutoff"),
            ).alias(f"r{i}")
            for i, test in enumerate(rules.values())
        ],
    )
    cells = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("s")) for i, name in enumerate(rules)])
    long = wide.select("_rows", "_positives", F.inline(cells))
    flagged, hits = F.col("s.flagged"), F.col("s.hits")
    precision, recall = hits / flagged, hits / F.col("_positives")
    prevalence = F.col("_positives") / F.col("_rows")
    return long.filter(flagged > 0).select(
        "rule",
        flagged.alias("flagged_n"),
        hits.alias("true_positive_n"),
        (flagged - hits).alias("false_positive_n"),
        (F.col("_positives") - hits).alias("false_negative_n"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        (precision / prevalence).alias("lift"),
        M.divide(flagged - hits, hits).alias("false_positives_per_true_positive"),
        (flagged / F.col("_rows")).alias("selection_fraction"),
        F.col("s.cutoff").alias("score_cutoff"),
    )


def top_table(df: DataFrame, score: str, ties: Sequence[str], n: int) -> DataFrame:
    """The n highest rows with a display rank; only n rows reach the ranking window."""
    from pyspark.sql import Window

    order = [F.col(score).desc(), *[F.col(t).asc() for t in ties]]
    top = df.orderBy(*order).limit(n)
    return top.withColumn("display_rank", F.row_number().over(Window.orderBy(*order)))
