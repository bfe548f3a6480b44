"""Paired cluster bootstrap of average precision.

Whole clusters are drawn with replacement. The draws form a tree: a replicate's draws are
split between the halves of the cluster numbers by a binomial draw whose random stream is
addressed by (seed, replicates, half), and so on downwards. The count of any one cluster
follows from the path to it, so a task computes the counts of its own clusters only, and they
do not change with the partitioning.

Rows are collapsed to (score, cluster) cells and range-partitioned by score and cluster, so a
score that all clusters share spreads over slices. Scores on the border of slices are added
up over slices; the others stay inside theirs. Segment totals carry the running counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellwise.operators.ordered import SLICE, order_slices, row_numbers
from cellwise.session import freeze

#: Replicates drawn together, and cluster numbers at which the tree ends in one multinomial draw.
DRAW_BLOCK = 128
LEAF = 64
BLOCK_CELLS = 4_000_000


def cluster_draws(seed: int, block: int, clusters: int, wanted: np.ndarray) -> np.ndarray:
    """How often the ``wanted`` clusters (ascending numbers from 0) are drawn in the replicates of a block.

    One row for each of ``DRAW_BLOCK`` replicates; each replicate draws ``clusters`` in all.
    """
    out = np.empty((DRAW_BLOCK, len(wanted)), np.int64)
    parts = [(0, clusters, 0, len(wanted), np.full(DRAW_BLOCK, clusters, np.int64))]
    while parts:
        low, high, a, b, total = parts.pop()
        if a == b:
            continue
        stream = np.random.Generator(np.random.Philox(key=[seed, block], counter=[0, 0, low, high]))
        if high - low <= LEAF:
            shares = np.full(high - low, 1.0 / (high - low))
            out[:, a:b] = stream.multinomial(total, shares)[:, wanted[a:b] - low]
            continue
        middle = (low + high) // 2
        left = stream.binomial(total, (middle - low) / (high - low))
        c = a + int(np.searchsorted(wanted[a:b], middle))
        parts += [(low, middle, a, c, left), (middle, high, c, b, total - left)]
    return out


def draw_weights(seed: int, first: int, last: int, clusters: int) -> np.ndarray:
    """How often each cluster is drawn, one row per replicate first..last-1."""
    every = np.arange(clusters)
    blocks = range(first // DRAW_BLOCK, -(-last // DRAW_BLOCK))
    drawn = np.concatenate([cluster_draws(seed, k, clusters, every) for k in blocks])
    start = first - first // DRAW_BLOCK * DRAW_BLOCK
    return drawn[start : start + last - first]


def _drawn(numbers: np.ndarray, seed: int, replications: int, clusters: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of (first replicate, draws of a run of cells, cells of the run).

    A run holds so many cells that a block of draws stays near ``BLOCK_CELLS`` entries.
    """
    step = max(1, BLOCK_CELLS // DRAW_BLOCK)
    for block in range(-(-replications // DRAW_BLOCK)):
        count = min(DRAW_BLOCK, replications - block * DRAW_BLOCK)
        for a in range(0, len(numbers), step):
            own = np.arange(a, min(a + step, len(numbers)))
            wanted, back = np.unique(numbers[own] - 1, return_inverse=True)
            yield block * DRAW_BLOCK, cluster_draws(seed, block, clusters, wanted)[:count, back], own


def _totals(key: str, seed: int, replications: int, clusters: int):
    """(key, replicate, n, pos) of the cells of a group."""

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        summed = pdf.groupby("cluster_no", as_index=False)[["n", "pos"]].sum()
        n, pos = np.zeros(replications, np.int64), np.zeros(replications, np.int64)
        for first, drawn, own in _drawn(summed["cluster_no"].to_numpy(), seed, replications, clusters):
            n[first : first + len(drawn)] += drawn @ summed["n"].to_numpy()[own]
            pos[first : first + len(drawn)] += drawn @ summed["pos"].to_numpy()[own]
        return pd.DataFrame({key: pdf[key].iloc[0], "replicate": np.arange(replications), "n": n, "pos": pos})

    return totals


def _inner_steps(seed: int, replications: int, clusters: int):
    """Sums of precision steps over the scores inside a slice, from the counts before it."""

    def steps(cells: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        if cells.empty or starts.empty:
            return pd.DataFrame({"replicate": [], "steps": []})
        cells = cells.sort_values(["score", "cluster_no"], ascending=[False, True])
        starts = starts.sort_values("replicate")
        score, n, pos = (cells[c].to_numpy() for c in ("score", "n", "pos"))
        cum_n, cum_pos = starts["start_n"].to_numpy().copy(), starts["start_pos"].to_numpy().copy()
        found = np.zeros(replications)
        open_n, open_pos = np.zeros(replications, np.int64), np.zeros(replications, np.int64)  # of a score that a run cut
        for first, drawn, own in _drawn(cells["cluster_no"].to_numpy(), seed, replications, clusters):
            rows = slice(first, first + len(drawn))
            edges = np.flatnonzero(np.r_[True, np.diff(score[own]) != 0])
            seen = np.add.reduceat(drawn * n[own], edges, axis=1)
            hits = np.add.reduceat(drawn * pos[own], edges, axis=1)
            seen[:, 0] += open_n[rows]
            hits[:, 0] += open_pos[rows]
            cut = own[-1] + 1 < len(score) and score[own[-1] + 1] == score[own[-1]]
            open_n[rows], open_pos[rows] = (seen[:, -1], hits[:, -1]) if cut else (0, 0)
            if cut:
                seen, hits = seen[:, :-1], hits[:, :-1]
            total_n = cum_n[rows, None] + np.cumsum(seen, axis=1)
            total_pos = cum_pos[rows, None] + np.cumsum(hits, axis=1)
            found[rows] += np.where(hits > 0, hits * total_pos / np.maximum(total_n, 1), 0.0).sum(axis=1)
            cum_n[rows] += seen.sum(axis=1)
            cum_pos[rows] += hits.sum(axis=1)
        return pd.DataFrame({"replicate": np.arange(replications), "steps": found})

    return steps


def replicate_precision(
    df: DataFrame, cluster: str, label: str, score: str, replications: int, seed: int
) -> DataFrame:
    """(replicate, average_precision) for replicates that drew both classes."""
    clusters = row_numbers(df.select(cluster).distinct(), [], [F.col(cluster).asc()], "cluster_no")
    count = clusters.count()
    cells = (
        df.groupBy(F.col(score).alias("score"), cluster)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("pos"))
        .join(clusters.select(cluster, "cluster_no"), cluster)
        .select("score", "cluster_no", "n", "pos")
    )
    sliced = order_slices(cells, [], [F.col("score").desc(), F.col("cluster_no").asc()])
    # at most two border scores a slice, so as many rows as slices
    ends = sliced.groupBy(SLICE).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    borders = freeze(ends.select(F.explode(F.array("low", "high")).alias("score")).distinct())
    kinds = "replicate bigint, n bigint, pos bigint"

    on_border = sliced.join(F.broadcast(borders), "score", "left_semi").withColumn("place", F.col("score").cast("double"))
    partial = on_border.groupBy(SLICE, "place").applyInPandas(_totals("place", seed, replications, count), f"place double, {kinds}")
    shared = partial.groupBy("place", "replicate").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    inside = sliced.join(F.broadcast(borders), "score", "left_anti")
    sums = inside.groupBy(SLICE).applyInPandas(_totals(SLICE, seed, replications, count), f"{SLICE} int, {kinds}")
    tops = inside.groupBy(SLICE).agg(F.max("score").cast("double").alias("place"))
    segments = freeze(
        shared.withColumn(SLICE, F.lit(None).cast("int")).select(SLICE, "place", "replicate", "n", "pos").unionByName(sums.join(F.broadcast(tops), SLICE).select(SLICE, "place", "replicate", "n", "pos"))
    )
    earlier = Window.partitionBy("replicate").orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    run = segments.select(
        "*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start_n"), F.coalesce(F.sum("pos").over(earlier), F.lit(0)).alias("start_pos")
    )
    step = F.when(F.col("pos") > 0, F.col("pos") * (F.col("start_pos") + F.col("pos")) / (F.col("start_n") + F.col("n"))).otherwise(0.0)
    outer = run.filter(F.col(SLICE).isNull()).select("replicate", step.alias("steps"))
    starts = run.filter(F.col(SLICE).isNotNull())
    inner = inside.groupBy(SLICE).cogroup(starts.groupBy(SLICE)).applyInPandas(_inner_steps(seed, replications, count), "replicate bigint, steps double")
    totals = segments.groupBy("replicate").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    return (
        outer.unionByName(inner)
        .groupBy("replicate")
        .agg(F.sum("steps").alias("steps"))
        .join(totals, "replicate")
        .filter("pos > 0 AND pos < n")
        .select("replicate", (F.col("steps") / F.col("pos")).alias("average_precision"))
    )


def paired_bootstrap(
    df: DataFrame,
    cluster: str,
    label: str,
    scores: Mapping[str, str],
    comparison: tuple[str, str],
    replications: int = 5000,
    seed: int = 754,
) -> DataFrame:
    """Replicate rows with one column per model and the paired difference."""
    if replications < 1 or len(scores) < 2 or not set(comparison) <= set(scores):
        raise ValueError("The paired comparison needs replications and two named scores")
    result = None
    for name, column in scores.items():
        part = replicate_precision(df, cluster, label, column, replications, seed).withColumnRenamed(
            "average_precision", name
        )
        result = part if result is None else result.join(part, "replicate")
    higher, lower = comparison
    return result.withColumn(f"{higher}_minus_{lower}", F.col(higher) - F.col(lower))


def bootstrap_summary(replicates: DataFrame, observed: Mapping[str, float]) -> DataFrame:
    """Observed value beside mean, median, standard error and the 95 % interval."""
    from cellwise.operators.evaluation import distribution_summary

    long = replicates.unpivot([], list(observed), "estimand", "value")
    known = F.create_map(*[item for k, v in observed.items() for item in (F.lit(k), F.lit(float(v)))])
    return distribution_summary(long, ["estimand"], "value").withColumn("observed", known[F.col("estimand")])
