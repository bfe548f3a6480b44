"""Association between panel measures: correlations, quadrants, clustered OLS."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.functions import measures as M
from cellwise.functions.tails import normal_p, student_p
from cellwise.operators.ordered import running_totals
from cellwise.operators.profile import medians


def pearson(x: Column, y: Column, min_n: int = 3) -> Column:
    """Correlation over complete pairs; NULL for few rows or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    varied = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when((F.count(a) >= min_n) & varied, F.try_divide(F.covar_pop(a, b), spread))


def pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], keep: Sequence[str] = ()) -> DataFrame:
    """One row per listed pair and complete observation."""
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("x_name"), F.lit(b).alias("y_name"),
                M.finite(F.col(a)).alias("x"), M.finite(F.col(b)).alias("y"),
            )
            for a, b in pairs
        ]
    )
    return df.select(*keep, F.inline(cells)).filter(F.col("x").isNotNull() & F.col("y").isNotNull())


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, min_n: int = 3) -> DataFrame:
    """Rank correlation per key from average ranks.

    Equal (x, y) pairs collapse to one weighted row first. The mean rank is known,
    so the sums are taken around it and need no second pass.
    """
    keys = list(keys)
    pairs = (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("n"))
    )

    def ranks(value: str, name: str) -> DataFrame:
        cells = pairs.groupBy(*keys, value).agg(F.sum("n").alias("n"))
        run = running_totals(cells, keys, [F.col(value).asc()], ["n"])
        centre = (F.col("total_n") + 1) / 2
        place = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
        return run.select(*keys, value, (place - centre).alias(name), F.col("total_n").alias(f"{name}_total"))

    joined = pairs.join(ranks(x, "_rx"), [*keys, x]).join(ranks(y, "_ry"), [*keys, y])
    w, rx, ry = F.col("n"), F.col("_rx"), F.col("_ry")
    size = F.sqrt(F.sum(w * rx * rx)) * F.sqrt(F.sum(w * ry * ry))
    return joined.groupBy(*keys).agg(
        F.sum(w).alias("n_pairs"),
        F.when((F.sum(w) >= min_n) & (size > 0), F.sum(w * rx * ry) / size).alias("spearman"),
    )


def correlations(rows: DataFrame, keys: Sequence[str], methods: Sequence[str] = ("pearson", "spearman")) -> DataFrame:
    """Coefficient, n and t statistic per key and method, from ``x`` and ``y`` columns."""
    parts = []
    if "pearson" in methods:
        parts.append(
            rows.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("n"), pearson(F.col("x"), F.col("y")).alias("coefficient")
            ).withColumn("method", F.lit("pearson"))
        )
    if "spearman" in methods:
        parts.append(
            spearman(rows, keys, "x", "y")
            .withColumnsRenamed({"n_pairs": "n", "spearman": "coefficient"})
            .withColumn("method", F.lit("spearman"))
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("t_statistic", t_statistic(F.col("coefficient"), F.col("n")))


def t_statistic(r: Column, n: Column) -> Column:
    return F.when((n > 2) & (F.abs(r) < 1), r * F.sqrt((n - 2) / (1 - r * r)))


def with_p_value(result: DataFrame) -> DataFrame:
    """Student p-values for a table of coefficients (one row per pair)."""
    return result.withColumn("p_value", student_p(F.col("t_statistic"), (F.col("n") - 2).cast("double")))


def correlation_matrix(df: DataFrame, columns: Sequence[str], min_n: int = 3) -> DataFrame:
    """Pairwise-complete Pearson matrix, all pairs in one aggregation pass."""
    clean = df.select(*[M.finite(F.col(c)).alias(c) for c in columns])
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = clean.agg(
        *[
            F.struct(
                F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"),
                pearson(F.col(a), F.col(b), min_n).alias("coefficient"),
            ).alias(f"p{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    cells = []
    for i, (a, b) in enumerate(pairs):
        for x, y in {(a, b), (b, a)}:
            cells.append(
                F.struct(
                    F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"p{i}.n").alias("n"),
                    F.col(f"p{i}.coefficient").alias("coefficient"),
                )
            )
    return wide.select(F.inline(F.array(*cells)))


def group_relationships(df: DataFrame, group: str, x: str, y: str, min_n: int = 10) -> DataFrame:
    """Correlations and the OLS slope of y on x in every group."""
    rows = df.select(group, M.finite(F.col(x)).alias("x"), M.finite(F.col(y)).alias("y")).filter(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    linear = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("x"), F.col("y")).alias("pearson"),
        F.when(F.count(F.lit(1)) >= min_n, F.regr_slope("y", "x")).alias("slope"),
    )
    rank = spearman(rows, [group], "x", "y").select(group, "spearman")
    return linear.join(rank, group, "left").withColumn("slope_eligible", F.col("n") >= min_n)


def with_quadrants(df: DataFrame, by: Sequence[str], rate: str, growth: str) -> DataFrame:
    """Rows with both measures, classed against their group medians; ties are high.

    Cutoffs come from all rows of the group, before rows with the other measure
    missing are dropped.
    """
    cuts = medians(df, by, {rate: "_rate_cut", growth: "_growth_cut"})
    level = lambda c, cut: F.when(F.col(c) >= F.col(cut), "high").otherwise("low")
    return (
        df.join(cuts, list(by))
        .filter(F.col(rate).isNotNull() & F.col(growth).isNotNull())
        .withColumn(
            "quadrant",
            F.concat(level(growth, "_growth_cut"), F.lit("_growth_"), level(rate, "_rate_cut"), F.lit("_startup")),
        )
        .drop("_rate_cut", "_growth_cut")
    )


def group_shares(df: DataFrame, within: Sequence[str], by: Sequence[str], name: str, distinct: str | None = None) -> DataFrame:
    """Counts per (within, by) and their percentage of the ``within`` total."""
    extra = [F.count_distinct(distinct).alias(f"{distinct}_count")] if distinct else []
    counts = df.groupBy(*dict.fromkeys([*within, *by])).agg(F.count(F.lit(1)).alias("observation_count"), *extra)
    whole = F.sum("observation_count").over(Window.partitionBy(*within))
    return counts.withColumn(name, F.col("observation_count") / whole * 100)


def quadrant_context(rows: DataFrame, place: str, year: str, measures: Sequence[str], medians_of: Sequence[str]) -> DataFrame:
    """Place-year means first, then mean and median of those means per quadrant."""
    coarse = rows.groupBy(place, year, "quadrant").agg(*[F.avg(m).alias(m) for m in measures])
    means = coarse.groupBy("quadrant").agg(
        F.count(F.lit(1)).alias("place_year_count"),
        F.count_distinct(place).alias("place_count"),
        *[F.avg(m).alias(f"{m}_mean") for m in measures],
    )
    return means.join(medians(coarse, ["quadrant"], {m: f"{m}_median" for m in medians_of}), "quadrant")


def sample_variants(df: DataFrame, samples: Mapping[str, Column]) -> DataFrame:
    """Rows repeated once per sample they belong to, labelled ``sample``."""
    labels = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in samples.items()]))
    return df.withColumn("sample", F.explode(labels))


def trimmed(df: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows inside the inclusive quantile range of ``value``."""
    from cellwise.operators.ordered import quantiles

    bounds = quantiles(df, [], value, {"lo": low, "hi": high}).select(F.struct("lo", "hi").alias("b")).scalar()
    return df.filter(F.col(value).between(bounds["lo"], bounds["hi"]))


def demeaned(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``<c>_within``: deviation from the panel mean; a panel is bounded by its years."""
    window = Window.partitionBy(*keys)
    return df.withColumns({f"{c}_within": F.col(c) - F.avg(c).over(window) for c in columns})


def agreement(df: DataFrame, dimensions: Mapping[str, str], a: str, b: str, scale: float = 1.0) -> DataFrame:
    """Agreement of measure ``b`` with ``a`` overall and inside every dimension value."""
    from cellwise.operators.ordered import quantiles

    unfolded = F.array(
        F.struct(F.lit("all").alias("dimension"), F.lit("all").alias("dimension_value")),
        *[
            F.struct(F.lit(n).alias("dimension"), F.col(c).cast("string").alias("dimension_value"))
            for n, c in dimensions.items()
        ],
    )
    base, other = F.col(a), F.col(b) * scale
    rows = (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
        .select(base.alias("a"), other.alias("b"), F.inline(unfolded))
        .withColumn("ratio", M.divide(F.col("b"), F.col("a")))
        .withColumn("apd", M.divide(F.abs(F.col("b") - F.col("a")), F.abs(F.col("a"))))
    )
    by = ["dimension", "dimension_value"]
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count("ratio").alias("nonzero_base"),
        pearson(F.col("a"), F.col("b"), 2).alias("correlation"),
        F.count_if(F.col("apd") > 1).alias("over_100pct"),
    )
    ratio = quantiles(rows, by, "ratio", {"median_ratio": 0.5})
    apd = quantiles(rows, by, "apd", {"median_apd": 0.5})
    return counts.join(ratio, by, "left").join(apd, by, "left")


# --- clustered OLS


def _design(columns: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(c) for c in columns]]


def _cross_products(df: DataFrame, terms: Sequence[Column]) -> np.ndarray:
    """Sum of outer products of the terms: one aggregation, a k x k matrix to the driver."""
    k = len(terms)
    wide = df.select(*[t.cast("double").alias(f"t{i}") for i, t in enumerate(terms)])
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    row = wide.agg(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in cells]).first()
    matrix = np.zeros((k, k))
    for (i, j), value in zip(cells, row):
        matrix[i, j] = matrix[j, i] = 0.0 if value is None else value
    return matrix


def with_dummies(df: DataFrame, categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Indicator columns for all but the smallest level; levels are bounded by the dimension."""
    names: list[str] = []
    for c in categorical:
        levels = [r[0] for r in df.select(F.col(c).cast("string")).distinct().orderBy(c).collect()]
        for level in levels[1:]:
            name = f"{c}_{level}"
            df = df.withColumn(name, (F.col(c).cast("string") == level).cast("double"))
            names.append(name)
    return df, names


def clustered_ols(
    df: DataFrame,
    outcome: str,
    predictors: Sequence[str],
    categorical: Sequence[str] = (),
    clusters: Sequence[str] = (),
    model: str = "exploratory",
) -> DataFrame:
    """OLS with cluster-robust or, without clusters, HC3 covariance.

    Only k x k matrices and the k coefficients reach the driver; residuals, leverages
    and the per-cluster score sums stay in Spark.
    """
    fields = [outcome, *predictors]
    clean = df.select(
        *dict.fromkeys([*categorical, *clusters]), *[M.finite(F.col(c)).alias(c) for c in fields]
    ).dropna(subset=[*fields, *categorical])
    clean, dummies = with_dummies(clean, categorical)
    names = [*predictors, *dummies]
    terms = _design(names)
    gram = _cross_products(clean, [*terms, F.col(outcome)])
    k = len(terms)
    xtx, xty, yty, n = gram[:k, :k], gram[:k, k], gram[k, k], gram[0, 0]
    if n <= k or n < 3:
        raise ValueError(f"Insufficient observations for {model}: {int(n)}")
    bread = np.linalg.inv(xtx)
    beta = bread @ xty
    fitted = sum((F.lit(float(b)) * t for b, t in zip(beta, terms)), F.lit(0.0))
    scored = clean.withColumn("_e", F.col(outcome) - fitted)
    if clusters:
        sums = scored.groupBy(*clusters).agg(*[F.sum(t * F.col("_e")).alias(f"_s{i}") for i, t in enumerate(terms)])
        meat = _cross_products(sums, [F.col(f"_s{i}") for i in range(k)])
        groups = sums.count()
        meat *= groups / (groups - 1) * (n - 1) / (n - k)
    else:
        leverage = sum(
            (F.lit(float(bread[i, j])) * a * b for i, a in enumerate(terms) for j, b in enumerate(terms)), F.lit(0.0)
        )
        weighted = scored.withColumn("_w", F.col("_e") / (1 - leverage))
        meat = _cross_products(weighted, [t * F.col("_w") for t in terms])
    errors = np.sqrt(np.diag(bread @ meat @ bread))
    rss = yty - beta @ xty
    tss = yty - xty[0] ** 2 / n
    rows = [
        (model, term, float(b), float(s), float(b - 1.959963984540054 * s), float(b + 1.959963984540054 * s),
         int(n), float(1 - rss / tss), "panel_clustered" if clusters else "HC3")
        for term, b, s in zip(["const", *names], beta, errors)
    ]
    result = df.sparkSession.createDataFrame(
        rows,
        "model string, term string, coefficient double, std_error double, ci_lower double, ci_upper double, "
        "n bigint, r_squared double, covariance string",
    )
    return result.withColumn("p_value", normal_p(F.col("coefficient") / F.col("std_error")))
