"""Running totals, ranks and exact quantiles over ordered data of any size.

A window without a partition, or with one hot key, would sort everything in one
task. Here the rows are range-partitioned over the whole composite order, so a
hot key is spread over many slices; per-slice totals (one row per key and slice)
give every slice its starting value and the rest is local to the slice. Slices
are frozen first, because their numbers must not change between the two passes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwise.session import freeze

SLICE = "_slice"


def order_slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    ranged = df.repartitionByRange(*[F.col(k).asc() for k in keys], *order)
    return freeze(ranged.withColumn(SLICE, F.spark_partition_id()))


def is_one_slice(sliced: DataFrame) -> bool:
    """Whether adaptive coalescing left a single slice, i.e. at most one advisory partition of rows."""
    return sliced.rdd.getNumPartitions() == 1


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Sequence[str]
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive) and ``total_<m>`` for each measure, per key.

    ``order`` must be a total order inside a key.
    """
    keys = list(keys)
    sliced = order_slices(df, keys, order)
    return _totals_in_one_slice(sliced, keys, order, measures) if is_one_slice(sliced) else _totals_over_slices(
        sliced, keys, order, measures
    )


def _totals_in_one_slice(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Sequence[str]
) -> DataFrame:
    """Plain windows: the whole input is one partition of bounded size."""
    running = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    return sliced.select(
        *[c for c in sliced.columns if c != SLICE],
        *[F.sum(m).over(running).alias(f"cum_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )


def _totals_over_slices(
    sliced: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: Sequence[str]
) -> DataFrame:
    """Local totals per slice, shifted by the totals of all earlier slices of the key."""
    sums = sliced.groupBy(*keys, SLICE).agg(*[F.sum(m).alias(f"_sum_{m}") for m in measures])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    starts = sums.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        F.col(SLICE).alias("_key_slice"),
        *[F.coalesce(F.sum(f"_sum_{m}").over(earlier), F.lit(0)).alias(f"_start_{m}") for m in measures],
        *[F.sum(f"_sum_{m}").over(whole).alias(f"total_{m}") for m in measures],
    )
    matches = F.col(SLICE) == F.col("_key_slice")
    for k in keys:
        matches = matches & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    local = (
        Window.partitionBy(SLICE, *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return sliced.join(starts, matches).select(
        *[c for c in sliced.columns if c != SLICE],
        *[(F.sum(m).over(local) + F.col(f"_start_{m}")).alias(f"cum_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "row_number"
) -> DataFrame:
    """Number rows from 1 per key, with the key's row count in ``<name>_of``."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("bigint")), keys, order, ["_one"])
    return numbered.withColumnsRenamed({"cum__one": name, "total__one": f"{name}_of"}).drop("_one")


def value_cells(df: DataFrame, keys: Sequence[str], value: str, **sums: Column) -> DataFrame:
    """One row per key and distinct value; equal values collapse before any shuffle."""
    extra = [F.sum(expr).alias(name) for name, expr in sums.items()]
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Distinct values with their average rank (ties share the mean rank) and counts."""
    run = running_totals(value_cells(df, keys, value), keys, [F.col(value).asc()], ["n"])
    return run.select(
        *keys, value, "n", (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2).alias(name), "total_n"
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact linearly interpolated quantiles per key, one column per name.

    Where all distinct values fit one slice, the built-in exact percentile reads them
    with their counts; otherwise positions come from the running counts.
    """
    keys = list(keys)
    order = [F.col(value).asc()]
    sliced = order_slices(value_cells(df, keys, value), keys, order)
    if is_one_slice(sliced):
        found = F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probabilities.values()]), F.col("n"))
        return sliced.groupBy(*keys).agg(found.alias("_q")).select(
            *keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probabilities)]
        )
    return quantiles_of(_totals_over_slices(sliced, keys, order, ["n"]), keys, value, probabilities)


def select_quantile(df: DataFrame, value: str, probability: float, most: int = 50_000) -> float | None:
    """One exact linearly interpolated quantile without a sort: NULL values aside, None if there are none.

    A mergeable sketch brackets the position; a count tells how many values lie below the
    bracket; the next round looks only inside. At most ``most`` distinct values of the last
    bracket reach the driver. A round shrinks the bracket by three orders of magnitude.
    """
    if not 0 <= probability <= 1:
        raise ValueError("A quantile lies between 0 and 1")
    v, accuracy = F.col(value), 10_000
    inside = df.filter(v.isNotNull())
    count = inside.count()
    if not count:
        return None
    place = (count - 1) * probability
    first, last, below = math.floor(place), math.ceil(place), 0
    while count > most:
        near = [min(1.0, max(0.0, (k - below) / count + side * 2 / accuracy)) for k, side in ((first, -1), (last, 1))]
        low, high = inside.agg(F.percentile_approx(value, near, accuracy)).first()[0]
        under, within = inside.agg(F.count_if(v < low), F.count_if(v.between(low, high))).first()
        if not under <= first - below <= last - below < under + within:
            break  # the sketch missed: the values below are read as cells
        if low == high:
            return float(low)
        if within == count:
            break
        inside, below, count = inside.filter(v.between(low, high)), below + under, within
    cells = inside.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    if count > most and cells.limit(most + 1).count() > most:
        return quantiles(df, [], value, {"q": probability}).first()["q"]
    run, found = below, {}
    for x, n in sorted((float(r[0]), r[1]) for r in cells.collect()):
        found.update({k: x for k in (first, last) if run <= k < run + n})
        run += n
    return found[first] + (place - first) * (found[last] - found[first])


def quantiles_of(
    run: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """The same from value cells that already carry ``cum_n`` and ``total_n``."""

    def at(position: Column) -> Column:
        inside = (F.col("cum_n") - F.col("n") <= position) & (position < F.col("cum_n"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    columns = []
    for name, p in probabilities.items():
        place = (F.col("total_n") - 1) * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place - F.floor(place))
        columns.append((low + share * (high - low)).alias(name))
    return run.groupBy(*keys).agg(*columns)


def attach_per_group(df: DataFrame, small: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Put per-group values on rows: an equi-join, or scalar subqueries for the global group."""
    if keys:
        return df.join(small.select(*keys, *columns), list(keys), "left")
    row = small.select(F.struct(*columns).alias("v")).scalar()
    return df.withColumns({c: row[c] for c in columns})
