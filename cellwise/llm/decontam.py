"""Benchmark decontamination by winnowing.

Of every ``guarantee - gram + 1`` consecutive hashes of ``gram`` words the least is a
fingerprint, so two texts that share ``guarantee`` words share a fingerprint. Fingerprints
of documents are joined with those of the benchmark, and each meeting is extended over the
windows around it, which are compared word by word. Items shorter than the guarantee are
one window; they are found by the hash of all their words. Words are compared as 64-bit
hashes: two given words are taken for equal by mistake with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm import text as X
from cellwise.llm.common import ship

WINDOW = 13
GRAM = 5
#: Benchmark words held in one task at a time; a larger benchmark is taken in several parts.
PART_WORDS = 2_000_000


def winnow(grams: np.ndarray, span: int) -> np.ndarray:
    """Positions of the least hash (the last of equals) of every ``span`` consecutive ones."""
    if len(grams) < span:
        return np.zeros(0, np.int64)
    least, place, width = grams, np.arange(len(grams), dtype=np.int32), 1

    def step(shift, least, place):
        take = least[:-shift] < least[shift:]
        return np.where(take, least[:-shift], least[shift:]), np.where(take, place[:-shift], place[shift:])

    while width * 2 <= span:
        least, place = step(width, least, place)
        width *= 2
    if width < span:
        least, place = step(span - width, least, place)
    return place[np.append(True, place[1:] != place[:-1])].astype(np.int64)


@dataclass
class Part:
    """A part of the benchmark: word hashes of its items back to back, and their fingerprints."""

    ids: list
    words: np.ndarray
    offsets: np.ndarray
    prints: np.ndarray  # sorted distinct fingerprints
    windows: tuple[np.ndarray, np.ndarray, np.ndarray]  # sorted hashes of whole windows, items, where each stands
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # the same of items shorter than a window, by length

    @staticmethod
    def of(ids: list, texts: list[bytes], window: int = WINDOW, gram: int = GRAM) -> Part:
        data, at = X.utf8(pa.array(texts, pa.large_binary()))
        words, counts = X.hash_words(data, at, X.PLAIN_WORDS)
        offsets = np.append(0, np.cumsum(counts))
        grams = X.gram_hashes(words, gram)
        whole = X.gram_hashes(words, window)
        prints, places, of, short = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
        for k, n in enumerate(counts.tolist()):
            lo = int(offsets[k])
            if n >= window:
                own = grams[lo : lo + n - gram + 1]
                prints.append(own[winnow(own, window - gram + 1)])
                places.append(np.arange(lo, lo + n - window + 1))
                of.append(np.full(n - window + 1, k))
            elif n:
                short.setdefault(n, []).append((lo, k))
        at = np.concatenate(places)
        tables = {n: _sorted_windows(X.gram_hashes(words, n)[[p[0] for p in pairs]], np.array([p[1] for p in pairs]), np.array([p[0] for p in pairs])) for n, pairs in short.items()}
        return Part(ids, words, offsets, np.unique(np.concatenate(prints)), _sorted_windows(whole[at] if len(at) else np.zeros(0, np.uint64), np.concatenate(of), at), tables)


def _sorted_windows(hashes: np.ndarray, items: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, item) pairs in order, each with one of its places."""
    order = np.lexsort((items, hashes))
    hashes, items, places = hashes[order], items[order], places[order]
    first = np.append(True, (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1]))[: len(hashes)]
    return hashes[first], items[first], places[first]


def _meet(words: np.ndarray, part: Part, size: int, table, starts: np.ndarray) -> tuple[list[list[int]], set[int]]:
    """Merged [first word, last word + 1) spans of the ``size``-word windows at ``starts`` that items hold, and the items.

    Work follows the windows, however often items and the document repeat them: each
    distinct window is looked up and compared word by word once.
    """
    known, items, places = table
    hashes = X.gram_hashes(words, size)[starts]
    low = np.searchsorted(known, hashes)
    same = low < len(known)
    same[same] = known[low[same]] == hashes[same]
    same[same] = (words[starts[same][:, None] + np.arange(size)] == part.words[places[low[same]][:, None] + np.arange(size)]).all(axis=1)
    hit = starts[same]
    if not len(hit):
        return [], set()
    begins = np.append(True, hit[1:] > hit[:-1] + size)
    ends = np.append(hit[:-1][begins[1:]], hit[-1]) + size
    found: set[int] = set()
    for value in np.unique(hashes[same]):
        found.update(items[np.searchsorted(known, value) : np.searchsorted(known, value, side="right")].tolist())
    return np.stack([hit[begins], ends], axis=1).tolist(), found


def _screen(part: Part, window: int, gram: int):
    span = window - gram + 1

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = X.utf8(batch["text"])
            for a, b in X.runs(offsets):
                words, counts = X.hash_words(data, offsets[a : b + 1], X.PLAIN_WORDS)
                ends = np.cumsum(counts)
                starts = ends - counts
                spans: list[list[list[int]]] = [[] for _ in range(b - a)]
                items: list[set[int]] = [set() for _ in range(b - a)]

                def look(k: int, size: int, table, at: np.ndarray) -> None:
                    got, named = _meet(words[starts[k] : ends[k]], part, size, table, at)
                    spans[k] += got
                    items[k] |= named

                if len(part.prints) and len(words) >= gram:
                    grams = X.gram_hashes(words, gram)
                    # Grams over two rows only add fingerprints; windows are looked up inside a row.
                    at = winnow(grams, span)
                    near = np.minimum(np.searchsorted(part.prints, grams[at]), len(part.prints) - 1)
                    at = at[part.prints[near] == grams[at]]
                    row = np.searchsorted(ends, at, side="right")
                    for k in np.unique(row).tolist():
                        own = at[row == k] - starts[k]
                        around = np.unique(own[:, None] - np.arange(span))  # windows that hold the gram
                        look(k, window, part.windows, around[(around >= 0) & (around <= counts[k] - window)])
                for n, table in part.short.items():
                    if len(words) < n:
                        continue
                    grams = X.gram_hashes(words, n)
                    near = np.minimum(np.searchsorted(table[0], grams), len(table[0]) - 1)
                    at = np.flatnonzero(table[0][near] == grams)
                    row = np.searchsorted(ends, at, side="right")
                    at, row = at[at + n <= ends[row]], row[at + n <= ends[row]]
                    for k in np.unique(row).tolist():
                        look(k, n, table, at[row == k] - starts[k])
                named = [sorted({part.ids[i] for i in own} - {None}) for own in items]
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].slice(a, b - a) for c in batch.schema.names if c != "text"), pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(named, pa.list_(pa.string()))],
                    [*(c for c in batch.schema.names if c != "text"), "n_words", "spans", "items"],
                )

    return screen


def benchmark_parts(benchmark: DataFrame, part_words: int = PART_WORDS) -> Iterator[Part]:
    """The benchmark in parts of bounded size, read row by row."""
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.encode(F.col("text").cast("string"), "UTF-8")).toLocalIterator():
        if row[1] is None:
            continue
        ids.append(row[0])
        texts.append(bytes(row[1]))
        size += len(row[1]) // 4 + 1
        if size >= part_words:
            yield Part.of(ids, texts)
            ids, texts, size = [], [], 0
    yield Part.of(ids, texts)


def _covered(spans) -> F.Column:
    """Number of positions in the union of [start, end) pairs."""
    step = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct(
            (acc["hit"] + F.greatest(s[1] - F.greatest(s[0], acc["end"]), F.lit(0).cast("long"))).alias("hit"),
            F.greatest(acc["end"], s[1]).alias("end"),
        ),
        lambda acc: acc["hit"],
    )
    return step


def contamination(docs: DataFrame, benchmark: DataFrame, part_words: int = PART_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_hit, items, contaminated.

    A benchmark within ``part_words`` is one pass over the documents, each row on its own,
    without a shuffle. A larger one is taken part by part and the parts' spans of a document
    are merged; the parts are bounded, so no task or driver holds the whole benchmark.

    Null or empty texts have no words and are clean. An empty benchmark, items without
    text or words hit nothing. Ids are strings; an item with a null id hits words as others do
    but is not named in ``items``. Rows that repeat a doc_id are judged on their own (in several
    parts: numbered by a hash of the text, equal rows kept apart by a counter).
    """
    rows = ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = benchmark_parts(benchmark, part_words)
    first = next(parts)
    schema = "doc_id long, n_words long, spans array<array<long>>, items array<string>"
    found = rows.mapInArrow(_screen(first, WINDOW, GRAM), schema)
    rest = [rows.withColumn("mark", F.xxhash64("text")).mapInArrow(_screen(p, WINDOW, GRAM), schema.replace("n_words", "mark long, n_words")) for p in parts]
    if rest:
        found = rows.withColumn("mark", F.xxhash64("text")).mapInArrow(_screen(first, WINDOW, GRAM), schema.replace("n_words", "mark long, n_words"))
        for more in rest:
            found = found.unionByName(more)
        merged = found.groupBy("doc_id", "mark").agg(
            F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count(F.lit(1)) / (len(rest) + 1)).cast("int").alias("copies"),
        )
        found = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("mark", "copies", "copy")
    hit = found.withColumn("n_hit", _covered(F.col("spans"))).withColumn("items", F.array_sort("items"))
    return hit.select("doc_id", "n_words", "n_hit", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def digest(found: DataFrame) -> DataFrame:
    """The items of ``contamination`` as a count and a SHA-256 of their comma-joined ids."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )
