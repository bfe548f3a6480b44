"""Packing into batches of bounded tokens by optimal length buckets.

The histogram of piece lengths, whose size the longest sequence bounds, is the only thing
the driver sees of the corpus. Dynamic programming over it chooses the bucket boundaries
with the least padding. Batches of one bucket hold as many rows, padded to its boundary, as
the token budget allows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm.common import freeze, numbered, scalar, ship

_loaded: dict = {}  # tokenizers of this worker, by path


@dataclass(frozen=True)
class Settings:
    """``longest``: tokens of a sequence; longer texts are cut into pieces of it, none is lost.

    ``unit``: bytes (byte-level tokens), words or tokenizer. ``tokenizer``: for the last, the
    path of a tokenizer file (JSON), which every executor must have, as it has its Python.
    ``extra``: tokens added to every text.
    """

    buckets: int = 16
    longest: int = 4096
    budget: int = 65_536
    unit: str = "bytes"
    tokenizer: str | None = None
    extra: int = 1


def _lengths(path: str):
    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        if path not in _loaded:
            _loaded[path] = Tokenizer.from_file(path)
            _loaded[path].encode_special_tokens = True  # their strings in a text are ordinary text
        counts: list[int] = []
        for k in range(0, len(texts), 64):
            part = [t or "" for t in texts.slice(k, 64).to_pylist()]
            counts += [len(e.ids) for e in _loaded[path].encode_batch_fast(part, add_special_tokens=False)]
        return pa.array(counts, pa.int64())

    return lengths


def token_count(text: str | Column, settings: Settings) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    if settings.unit == "words":
        words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return F.when(text.isNull(), F.lit(0)).otherwise(words).cast("long") + settings.extra
    if settings.unit == "tokenizer":
        return _lengths(settings.tokenizer)(text) + settings.extra
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + settings.extra


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least padding in total.

    ``lengths``: distinct and ascending. best[k][j] is the least padded size of the first j
    lengths in k buckets; a bucket that ends at length j costs its rows times that length.
    """
    n = len(lengths)
    if not n:
        return []
    rows = np.append(0, np.cumsum(counts)).astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    back = []
    for _ in range(min(buckets, n)):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        for j in range(1, n + 1):
            costs = best[:j] + (rows[j] - rows[:j]) * lengths[j - 1]
            cut[j] = int(np.argmin(costs))
            now[j] = costs[cut[j]]
        best = now
        back.append(cut)
    ends, j = [], n
    for cut in reversed(back):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return ends[::-1]


def pieces(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each piece of at most ``longest`` tokens: doc_id, piece, n_tokens."""
    whole = ship(docs).select("doc_id", token_count(F.col("text").cast("string"), settings).alias("tokens"))
    last = F.expr(f"greatest((tokens - 1) div {settings.longest}, 0)")
    cut = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return cut.select("doc_id", F.col("piece").cast("int").alias("piece"), F.least(F.lit(settings.longest), F.col("tokens") - F.col("piece") * settings.longest).cast("int").alias("n_tokens"))


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, piece, n_tokens, bucket, padded_tokens, batch and slot for every piece.

    ``bucket`` counts from 0 by length, ``batch`` from 0 inside a bucket; rows of a batch
    stand at slots 0.. and take padded_tokens each, at most ``budget`` together (a longer
    sequence than the budget is a batch alone). Only the last batch of a bucket may be
    short, however many rows a bucket has: positions are counted over slices, not in one
    task. Null and empty texts are pieces of ``extra`` tokens. Rows that repeat a doc_id are
    packed as often as they occur. An empty table gives an empty table.
    """
    cut = freeze(pieces(docs, settings))
    histogram = sorted((r[0], r[1]) for r in cut.groupBy("n_tokens").count().collect())  # at most ``longest`` rows
    lengths = np.array([h[0] for h in histogram], np.int64)
    ends = optimal_boundaries(lengths, np.array([h[1] for h in histogram], np.int64), settings.buckets)
    bound = F.array(*[F.lit(e) for e in ends]) if ends else F.array(F.lit(settings.longest))
    named = cut.withColumn("bucket", F.size(F.filter(bound, lambda e: e < F.col("n_tokens")))).withColumn("padded_tokens", F.element_at(bound, F.col("bucket") + 1))
    placed = numbered(named, "bucket", ["doc_id", "piece", "n_tokens"], "position", sum(h[1] for h in histogram))
    room = F.greatest(F.lit(1), F.expr(f"{settings.budget} div greatest(padded_tokens, 1)"))
    return placed.select(
        "doc_id", "piece", "n_tokens", "bucket", "padded_tokens",
        F.floor(F.col("position") / room).cast("long").alias("batch"), (F.col("position") % room).cast("int").alias("slot"),
    )


def padding(packed: DataFrame) -> float:
    """Share of padding among the tokens of all rows."""
    return scalar(packed.agg(1 - F.sum("n_tokens") / F.sum("padded_tokens")))
