"""Comparisons around a scored sample: concentration, drift, standardisation, agreement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.operators.ordered import quantiles
from cellwise.session import broadcast_checked


def prevalence_scores(development: DataFrame, group: str, label: str) -> DataFrame:
    return development.groupBy(group).agg(
        F.count(F.lit(1)).alias("development_n"),
        F.sum(label).alias("development_gap_n"),
        F.avg(label).alias("development_prevalence"),
    )


def score_by_group(rows: DataFrame, rates: DataFrame, group: str, name: str, fallback: float | None = None) -> DataFrame:
    """Development rate as score; an unseen group fails unless a fallback is given."""
    joined = rows.join(broadcast_checked(rates.select(group, "development_prevalence")), group, "left")
    rate = F.col("development_prevalence")
    if fallback is None:
        unseen = F.raise_error(F.concat(F.lit("Unseen group: "), F.col(group).cast("string"))).cast("double")
    else:
        if not 0 <= fallback <= 1:
            raise ValueError("The fallback must be a probability")
        unseen = F.lit(float(fallback))
    return joined.withColumn(name, F.when(rate.isNotNull(), rate).otherwise(unseen)).drop("development_prevalence")


def concentration(rows: DataFrame, group: str, flagged: str, label: str) -> DataFrame:
    """How flagged rows spread over a grouping, against the spread of all rows."""
    hit = F.col(flagged)
    counts = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows_n"),
        F.count_if(hit).alias("flagged_n"),
        F.count_if(hit & (F.col(label) == 1)).alias("flagged_gap_n"),
    )
    whole = counts.select(F.struct(F.sum("flagged_n").alias("flagged"), F.sum("rows_n").alias("rows")).alias("t")).scalar()
    share_flagged = F.col("flagged_n") / whole["flagged"]
    share_rows = F.col("rows_n") / whole["rows"]
    return counts.select(
        group, "rows_n", "flagged_n", "flagged_gap_n",
        share_flagged.alias("share_of_flagged"),
        share_rows.alias("share_of_rows"),
        (F.col("flagged_n") / F.col("rows_n")).alias("flag_rate"),
        (share_flagged / share_rows).alias("representation_ratio"),
        M.divide(F.col("flagged_gap_n"), F.col("flagged_n")).alias("precision"),
    )


def standardized_prevalence(reference: DataFrame, comparison: DataFrame, strata: Sequence[str], label: str) -> DataFrame:
    """Reference composition applied to comparison rates; a missing stratum fails."""
    weights = reference.groupBy(*strata).agg(F.count(F.lit(1)).alias("_n"))
    rates = comparison.groupBy(*strata).agg(F.avg(label).alias("_rate"))
    joined = weights.join(rates, list(strata), "left")
    rate = F.when(F.col("_rate").isNotNull(), F.col("_rate")).otherwise(
        F.raise_error(F.lit("Comparison data lack a reference stratum")).cast("double")
    )
    return joined.agg(
        (F.sum(F.col("_n") * rate) / F.sum("_n")).alias("standardized_prevalence"),
        F.count(F.lit(1)).alias("strata_n"),
    )


def eligibility(rows: DataFrame, target_fields: Sequence[str], predictor_fields: Sequence[str]) -> DataFrame:
    """Which side is complete; infinities count as missing."""

    def complete(fields: Sequence[str]) -> Column:
        usable = [
            M.finite(F.col(f)).isNotNull() if dict(rows.dtypes)[f] in ("double", "float") else F.col(f).isNotNull()
            for f in fields
        ]
        return F.forall(F.array(*usable), lambda x: x)

    return (
        rows.withColumn("target_eligible", complete(target_fields))
        .withColumn("predictor_complete", complete(predictor_fields))
        .withColumn("eligible", F.col("target_eligible") & F.col("predictor_complete"))
    )


def exclusion_reasons(classified: DataFrame, target_fields: Sequence[str], predictor_fields: Sequence[str]) -> DataFrame:
    """Overlapping reasons among excluded rows, one pass, shares of all and of excluded."""
    out = ~F.col("eligible")
    tests = {
        "broad|target inputs incomplete": ~F.col("target_eligible"),
        "broad|predictor inputs incomplete": ~F.col("predictor_complete"),
        "broad|both incomplete": ~F.col("target_eligible") & ~F.col("predictor_complete"),
        **{f"target_field|missing {c}": out & F.col(c).isNull() for c in target_fields},
        **{f"predictor_field|missing {c}": out & F.col(c).isNull() for c in predictor_fields},
    }
    wide = classified.agg(
        F.count(F.lit(1)).alias("_all"),
        F.count_if(out).alias("_out"),
        *[F.count_if(t).alias(n) for n, t in tests.items()],
    )
    long = wide.unpivot(["_all", "_out"], [f"`{n}`" for n in tests], "name", "excluded_n")
    return long.select(
        F.split("name", r"\|")[0].alias("scope"),
        F.split("name", r"\|")[1].alias("reason"),
        "excluded_n",
        M.divide(F.col("excluded_n"), F.col("_all")).alias("pct_all"),
        M.divide(F.col("excluded_n"), F.col("_out")).alias("pct_excluded"),
    )


def eligibility_summary(classified: DataFrame, place: str, category: str, label: str) -> DataFrame:
    ok = F.col("eligible")
    return classified.agg(
        F.count(F.lit(1)).alias("candidate_pairs"),
        F.count_if(F.col("target_eligible")).alias("label_eligible_pairs"),
        F.count_if(ok).alias("eligible_pairs"),
        F.count_if(~ok).alias("excluded_pairs"),
        F.avg((~ok).cast("double")).alias("exclusion_share"),
        F.count_distinct(F.when(ok, F.col(place))).alias("place_n"),
        F.count_distinct(F.when(ok, F.col(category))).alias("category_n"),
        F.avg(F.when(ok, F.col(label))).alias("prevalence"),
    )


def exclusion_rate(classified: DataFrame, group: str) -> DataFrame:
    counts = classified.groupBy(group).agg(
        F.count(F.lit(1)).alias("candidates_n"), F.count_if(~F.col("eligible")).alias("excluded_n")
    )
    whole = counts.select(F.sum("excluded_n").alias("t")).scalar()
    return counts.select(
        group, "candidates_n", "excluded_n",
        (F.col("excluded_n") / F.col("candidates_n")).alias("exclusion_rate"),
        M.divide(F.col("excluded_n"), whole).alias("share_of_excluded"),
    )


def mean_differences(rows: DataFrame, flag: str, columns: Sequence[str], zero_spread: str = "null") -> DataFrame:
    """Standardised mean difference of flagged against other rows.

    ``zero_spread``: "null" needs two rows on both sides and yields NULL without
    spread; "limit" yields 0 for equal means and infinity otherwise.
    """
    if zero_spread not in {"null", "limit"}:
        raise ValueError("zero_spread must be 'null' or 'limit'")
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("v")) for c in columns])
    long = rows.select(F.col(flag).alias("_in"), F.inline(cells))
    a, b = F.when(F.col("_in"), F.col("v")), F.when(~F.col("_in"), F.col("v"))
    stats = long.groupBy("variable").agg(
        F.count(a).alias("included_n"), F.count(b).alias("excluded_n"),
        F.avg(a).alias("included_mean"), F.avg(b).alias("excluded_mean"),
        F.var_samp(a).alias("_va"), F.var_samp(b).alias("_vb"),
    )
    spread = F.sqrt((F.col("_va") + F.col("_vb")) / 2)
    gap = F.col("included_mean") - F.col("excluded_mean")
    both = (F.col("included_n") >= 2) & (F.col("excluded_n") >= 2)
    smd = F.when(both & (spread > 0), gap / spread)
    if zero_spread == "limit":
        smd = F.when((F.col("included_n") == 0) | (F.col("excluded_n") == 0), None).when(
            ~both | (spread == 0), F.when(gap == 0, 0.0).otherwise(float("inf"))
        ).otherwise(gap / spread)
    return stats.withColumn("smd", smd).drop("_va", "_vb")


def period_summary(rows: DataFrame, period: str, label: str, observed: str, expected: str, residual: str, cutoff: float) -> DataFrame:
    """Moments and quantiles of outcome, expectation and residual per period."""
    base = rows.groupBy(period).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(label).alias("gap_prevalence"),
        F.avg(observed).alias("observed_mean"),
        F.avg(expected).alias("expected_mean"),
        F.avg(residual).alias("residual_mean"),
        F.stddev_samp(residual).alias("residual_sd"),
        F.avg((F.col(residual) <= cutoff).cast("double")).alias("share_below_cutoff"),
    )
    keys = [period]
    return (
        base.join(quantiles(rows, keys, observed, {"observed_median": 0.5}), keys, "left")
        .join(quantiles(rows, keys, expected, {"expected_median": 0.5}), keys, "left")
        .join(
            quantiles(rows, keys, residual, {"residual_p10": 0.1, "residual_p20": 0.2, "residual_p25": 0.25, "residual_median": 0.5}),
            keys, "left",
        )
    )


def label_agreement(rows: DataFrame, keys: Sequence[str], first: str, second: str) -> DataFrame:
    """Agreement, positive Jaccard and Cohen's kappa of two binary labels."""
    a, b = F.col(first) == 1, F.col(second) == 1
    c = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(a & b).alias("_both"),
        F.count_if(a | b).alias("_any"),
        F.count_if(a == b).alias("_same"),
        F.count_if(a).alias("first_positive_n"),
        F.count_if(b).alias("second_positive_n"),
    )
    n = F.col("n")
    pa, pb = F.col("first_positive_n") / n, F.col("second_positive_n") / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    same = F.col("_same") / n
    return c.select(
        *keys, "n", same.alias("agreement"),
        F.when(F.col("_any") > 0, F.col("_both") / F.col("_any")).otherwise(1.0).alias("positive_jaccard"),
        F.when(chance < 1, (same - chance) / (1 - chance)).alias("cohen_kappa"),
        "first_positive_n", "second_positive_n",
    )


def regression_metrics(rows: DataFrame, keys: Sequence[str], observed: str, predicted: str, center: Column | None = None) -> DataFrame:
    """Error metrics; R squared around the group mean or a given (training) centre."""
    r = F.col(observed) - F.col(predicted)
    work = rows.withColumn("_r", r).withColumn("_c", center if center is not None else F.lit(0.0))
    y = F.col(observed)
    spread = (
        F.sum(F.pow(y - F.col("_c"), 2)) if center is not None else F.var_pop(y) * F.count(y)
    )
    base = work.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("_r")).alias("mae"),
        F.sqrt(F.avg(F.pow("_r", F.lit(2)))).alias("rmse"),
        F.when(spread > 0, 1 - F.sum(F.pow("_r", F.lit(2))) / spread).alias("r_squared"),
        F.avg("_r").alias("mean_residual"),
        F.when(F.count("_r") > 1, F.stddev_samp("_r")).alias("residual_sd"),
        F.count_if(F.col(predicted) < 0).alias("negative_expected_n"),
    )
    cuts = quantiles(work, keys, "_r", {"residual_p05": 0.05, "median_residual": 0.5, "residual_p95": 0.95})
    if keys:
        return base.join(cuts, list(keys), "left")
    row = cuts.select(F.struct("*").alias("c")).scalar()
    return base.withColumns({c: row[c] for c in ("residual_p05", "median_residual", "residual_p95")})


def coefficient_stability(coefficients: DataFrame, keys: Sequence[str], value: str = "coefficient") -> DataFrame:
    """Spread and sign consistency of a coefficient over folds."""
    v = F.col(value)
    return coefficients.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fold_n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.count_distinct(F.signum(v)) == 1).alias("sign_consistent"),
    )


def model_coverage(places: DataFrame, predictions: DataFrame, place: str) -> DataFrame:
    """Predicted rows per place and whether a place can be modelled at all."""
    counts = predictions.groupBy(place).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("bigint"))
    return places.join(counts, place, "left").withColumn("prediction_rows", n).withColumn(
        "modeling_eligible", n > 0
    ).drop("_n")


def scorecard(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Long union of check tables, each tagged with its family."""
    result = None
    for name, df in parts.items():
        tagged = df.withColumn("check_family", F.lit(name))
        result = tagged if result is None else result.unionByName(tagged, allowMissingColumns=True)
    return result


def distribution_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, median, standard error and 95 % range of replicate values."""
    base = rows.groupBy(*keys).agg(
        F.count(value).alias("replications"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("se"),
        F.avg((F.col(value) > 0).cast("double")).alias("share_positive"),
        F.avg((F.col(value) < 0).cast("double")).alias("share_negative"),
    )
    return base.join(quantiles(rows, keys, value, {"median": 0.5, "ci_low": 0.025, "ci_high": 0.975}), list(keys))


def fold_stability(metrics: DataFrame, fold: str, model: str, value: str, higher: str, lower: str) -> DataFrame:
    """Per-fold difference of two models and who wins."""
    wide = metrics.groupBy(fold).agg(
        F.max(F.when(F.col(model) == higher, F.col(value))).alias("_high"),
        F.max(F.when(F.col(model) == lower, F.col(value))).alias("_low"),
    )
    gap = F.col("_high") - F.col("_low")
    return wide.select(
        fold, F.col("_high").alias(higher), F.col("_low").alias(lower), gap.alias("difference"), (gap > 0).alias("higher_wins")
    )


def size_groups(training: DataFrame, rows: DataFrame, place: str, size: str, name: str = "size_group") -> DataFrame:
    """Small, middle and large by thirds of training place medians; missing stays explicit.

    The two cutpoints arrive as one scalar subquery.
    """
    per_place = quantiles(training, [place], size, {"_m": 0.5})
    cuts = quantiles(per_place, [], "_m", {"low": 1 / 3, "high": 2 / 3}).select(F.struct("low", "high").alias("c")).scalar()
    v = F.col(size)
    group = (
        F.when(v.isNull(), "unclassified_missing_population")
        .when(v <= cuts["low"], "small")
        .when(v <= cuts["high"], "middle")
        .otherwise("large")
    )
    return rows.withColumn(name, group)


def size_groups_frozen(rows: DataFrame, size: str, low: float, high: float, name: str = "size_group") -> DataFrame:
    v = F.col(size)
    group = (
        F.when(v.isNull(), "unclassified_missing_population").when(v <= low, "small").when(v <= high, "middle").otherwise("large")
    )
    return rows.withColumn(name, group)
