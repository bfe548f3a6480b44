"""Published marts: filters, summaries, option lists and labelled long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.ordered import attach_per_group, quantiles
from cellwise.operators.profile import medians


def apply_filters(
    df: DataFrame,
    place: str | None = None,
    categories: Sequence[str] | None = None,
    year: int | None = None,
    label: int | None = None,
    known_years: Sequence[int] | None = None,
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Optional filters in any combination; a year the mart does not hold is an error."""
    column = {"place": "geo", "category": "ind", "year": "yr", "label": "gap", **(names or {})}
    if year is not None and known_years is not None and year not in known_years:
        raise ValueError(f"Year {year} is not in the mart")
    if place is not None:
        df = df.filter(F.col(column["place"]) == place)
    if categories:
        df = df.filter(F.col(column["category"]).isin(list(categories)))
    if year is not None:
        df = df.filter(F.col(column["year"]) == year)
    if label is not None:
        df = df.filter(F.col(column["label"]) == label)
    return df


def filter_predictions(
    df: DataFrame, split_column: str, split: str, splits: Sequence[str], year: int | None = None, **filters
) -> DataFrame:
    """Rows of one known split; a predictor year the split does not hold is an error."""
    if split not in splits:
        raise ValueError(f"Unknown split {split}")
    rows = df.filter(F.col(split_column) == split)
    column = {"year": "yr", **(filters.get("names") or {})}["year"]
    if year is not None and rows.filter(F.col(column) == year).isEmpty():
        raise ValueError(f"Year {year} is unavailable for {split}")
    return apply_filters(rows, year=year, **filters)


def with_predictions_only(panel: DataFrame, predictions: DataFrame, on: Sequence[str]) -> DataFrame:
    return panel.join(predictions.select(*on), list(on), "left_semi")


def selection_summary(df: DataFrame, category: str) -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct(category).alias("category_count"))
    return counts.withColumn(
        "summary", F.format_string("%d rows across %d categories", F.col("row_count"), F.col("category_count"))
    )


def labelled_long(
    wide: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], model_labels: Mapping[str, str], model: str = "model"
) -> DataFrame:
    """One row per metric with its label and display order; unknown models keep their name."""
    long = wide.unpivot(list(keys), list(metrics), "metric", "value")
    names = F.create_map(*[F.lit(x) for pair in metrics.items() for x in pair])
    order = F.create_map(*[x for i, m in enumerate(metrics, start=1) for x in (F.lit(m), F.lit(i))])
    models = F.create_map(*[F.lit(x) for pair in model_labels.items() for x in pair])
    return long.select(
        *keys,
        F.coalesce(models[F.col(model)], F.col(model)).alias("model_label"),
        "metric",
        names[F.col("metric")].alias("metric_label"),
        order[F.col("metric")].alias("display_order"),
        "value",
    )


def harmonised(column: Column, names: Mapping[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(mapping[column], column)


def option_lists(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Distinct values of each listed column with a sorted position.

    The columns are dimensions, so the per-option window is bounded by their domains.
    """
    parts = [
        df.select(F.lit(n).alias("option"), F.col(c).cast("string").alias("value")).distinct() for n, c in columns.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    order = Window.partitionBy("option").orderBy("value")
    return result.withColumn("position", F.row_number().over(order))


def source_registry(sources: Mapping[str, tuple[DataFrame, str]], titles: Mapping[str, str]) -> DataFrame:
    """Years and rows per source beside its title."""
    parts = [
        df.agg(
            F.lit(name).alias("source"), F.lit(titles[name]).alias("title"), F.min(year).alias("first_year"),
            F.max(year).alias("last_year"), F.count(F.lit(1)).alias("row_count"),
        )
        for name, (df, year) in sources.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def binned_medians(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Median of x and y inside quantile bins of x, equal edges merged."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    names = {f"_e{i}": i / bins for i in range(bins + 1)}
    edges = quantiles(rows, [], x, names).select(F.array_sort(F.array_distinct(F.array(*names))).alias("_edges"))
    marked = attach_per_group(rows, edges, [], ["_edges"])
    bin_ = F.greatest(F.lit(1), F.size(F.filter("_edges", lambda e: e < F.col(x))))
    binned = marked.select(bin_.alias("bin"), x, y)
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(medians(binned, ["bin"], {x: f"{x}_median", y: f"{y}_median"}), "bin")


def risk_concentration(performance: DataFrame, cuts: Mapping[str, float]) -> DataFrame:
    """Workload and expected yield of each cut from a performance table."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("cut"),
                F.ceil(F.col("n") * F.lit(float(share))).alias("selected_n"),
                F.col(f"{name}_lift").alias("lift"),
            )
            for name, share in cuts.items()
        ]
    )
    return performance.select("model", "prevalence", F.inline(cells)).withColumn(
        "expected_rate", F.col("lift") * F.col("prevalence")
    )


def union_predictions(parts: Mapping[str, DataFrame], tag: str = "split") -> DataFrame:
    result = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        result = df if result is None else result.unionByName(df, allowMissingColumns=True)
    return result
