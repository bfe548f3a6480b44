"""Phrase collocations by Toivonen mining: a sample proposes, full passes count exactly.

A phrase can only be frequent if the two phrases one word shorter inside it are. The sample
proposes the phrases it finds often enough. A full pass then counts, in all texts, every
phrase whose two shorter parts are proposed: the proposals themselves and their negative
border. Where a border phrase turns out frequent, longer phrases over it may be frequent
too and are not counted yet; another pass counts exactly those, until no frequent phrase is
left outside the proposals. The counts do not depend on the sample, only the work does.

Tasks know the proposals as a Bloom filter of bounded size. A phrase it lets through by
mistake is counted in vain, which changes nothing. Which phrases a pass counts depends on
the phrase alone, so each is counted at all its places or nowhere.

The border is far larger than what is frequent. The sample and the first full pass therefore
count the upper 48 bits of hashes, packed by hash range as differences of sorted values. Phrases
that share a hash share the count, so no frequent phrase is lost; the next pass counts the phrases
themselves, only those whose hash is frequent, and with them the border beyond the proposals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.llm import text as X
from cellwise.llm.common import column_like, free_name, freeze, ship
from cellwise.session import broadcast_checked

# Bytes between words of a piece, and bytes between pieces.
_BLANKS = b" \t"
_BREAKS = b".,;:!?\n\x0b\x0c\r"

_KIND = np.full(256, 2, np.uint8)
_KIND[list(_BLANKS)] = 0
_KIND[list(_BREAKS)] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CUT = np.uint64(16)  # low bits of a hash that are not counted apart
_WORDS = (np.array([int(b != 0x20) for b in range(256)], np.uint8), X.BYTE_VALUES)


@dataclass(frozen=True)
class Settings:
    """``support`` least occurrences; ``longest`` words of a phrase; ``top`` phrases a language.

    ``sample`` is the share of rows that proposes; a phrase is proposed from ``sample`` times
    ``support`` occurrences on, rounded down. ``contained_percent``: a phrase goes if a
    longer candidate around it has at least this share of its occurrences. A filter has at
    most 2**``filter_bits`` bits, whatever the number of proposals. ``chunk`` bytes are
    counted at once in a task; hashes meet in one range for every ``range_bytes`` of text;
    ``fan`` partial lists of a language are cut to ``top`` first.
    """

    support: int = 10
    longest: int = 3
    top: int = 2000
    contained_percent: int = 50
    sample: float = 0.25
    seed: int = 11
    filter_bits: int = 28
    chunk: int = 1 << 20
    range_bytes: int = 8 << 20
    fan: int = 64

    @property
    def proposed_from(self) -> int:
        return max(1, math.floor(self.sample * self.support))


# ---- proposals as filters -----------------------------------------------------------


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return (hashes >> _CUT) & mask, (hashes >> np.uint64(64 - bits)) & mask


@dataclass(frozen=True)
class Filter:
    """The proposals of all lengths as one Bloom filter with two places a phrase."""

    words: np.ndarray
    bits: int

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for place in _places(hashes, self.bits):
            found &= (self.words[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def _lang_hash(lang: str) -> np.uint64:
    data = np.frombuffer(lang.encode() or b"\0", np.uint8)
    return X.digest64(data.reshape(1, -1))[0]


def _extend(left: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of its first words and that of its last."""
    return X.mix(left * X.WORD_STEP + word)


def _hashes_of(lang: pa.Array, phrase: pa.Array, levels: np.ndarray) -> np.ndarray:
    """Hashes of phrases given as rows (language, words with single spaces, number of words)."""
    data, offsets = X.utf8(phrase)
    words, _ = X.hash_words(data, offsets, _WORDS)
    coded = lang.dictionary_encode()
    seeds = np.array([_lang_hash(name) for name in coded.dictionary.to_pylist()], np.uint64)
    seeds = seeds[coded.indices.to_numpy()] if len(seeds) else np.zeros(0, np.uint64)
    start = np.cumsum(levels) - levels
    out = np.zeros(len(levels), np.uint64)
    for n in np.unique(levels):
        rows = np.flatnonzero(levels == n)
        value = X.mix(words[start[rows]] ^ seeds[rows])
        for k in range(1, n):
            value = _extend(value, X.mix(words[start[rows] + k] ^ seeds[rows]))
        out[rows] = value
    return out


def _hashed(phrases: DataFrame) -> DataFrame:
    """(hash) of (lang, words, phrase) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _hashes_of(batch["lang"], batch["phrase"], batch["words"].to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["hash"])

    return phrases.select("lang", "words", "phrase").mapInArrow(run, "hash long")


def build_filter(hashes: DataFrame, most_bits: int) -> Filter:
    """A filter of (hash) rows; its bits are set in tasks and merged by OR."""
    bits = min(most_bits, max(16, math.ceil(math.log2(10 * hashes.count() + 1))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.unique(np.concatenate(_places(batch["hash"].to_numpy().view(np.uint64), bits)))
            at, first = np.unique((places >> np.uint64(6)).astype(np.int64), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(mask.view(np.int64))], ["at", "mask"])

    merged = hashes.mapInArrow(place, "at long, mask long").groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(1 << max(0, bits - 6), np.uint64)
    words[merged["at"].to_numpy()] = merged["mask"].to_numpy().view(np.uint64)
    return Filter(words, bits)


# ---- counting -----------------------------------------------------------------------


def _chunks(data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """``data`` in parts of about ``size`` bytes that end at breaks, so no phrase is cut."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and _KIND[data[end - 1]] != 1:
            more = np.flatnonzero(_KIND[data[end : end + 65_536]] == 1)
            end = min(end + (int(more[0]) + 1 if len(more) else 65_536), len(data))
        yield data[at:end]
        at = end


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, int, np.ndarray]:
    """Equal codes under one number from 0: numbers, how many, and a place of each."""
    coded = pa.array(codes).dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.empty(len(coded.dictionary), np.int64)
    first[number[::-1]] = np.arange(len(number) - 1, -1, -1)
    return number, len(first), first


@dataclass(frozen=True)
class Level:
    """The distinct phrases of one length in a chunk, and whether an earlier pass counted them."""

    words: int
    hashes: np.ndarray
    counts: np.ndarray
    earlier: np.ndarray
    parts: tuple[pa.Array, np.ndarray, np.ndarray]  # distinct words, word numbers, a place of each phrase

    def texts(self, some: np.ndarray) -> pa.Array:
        known, word, place = self.parts
        return pc.binary_join_element_wise(*[known.take(pa.array(word[place[some] + k])) for k in range(self.words)], " ")


def levels(data: np.ndarray, lang: str, filters: list[Filter], longest: int) -> Iterator[Level]:
    """The phrases of lower-cased bytes that the last filter asks for, by length; no filter asks for all.

    A filter asks for the single words, and for longer phrases if it has their first n - 1
    and their last n - 1 words and asks for both.
    """
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 2, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, length = edge[::2], edge[1::2] - edge[::2]
    if not len(start):
        return
    offsets = np.append(0, np.cumsum(length)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[kind == 2])).dictionary_encode()
    word, known = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), words.dictionary
    piece = np.cumsum(kind == 1, dtype=np.int32)[start]
    joined = np.append(piece[1:] == piece[:-1], False)

    own = X.mix(X.hash_words(*X.utf8(known), _WORDS)[0] ^ _lang_hash(lang))
    first = np.empty(len(known), np.int64)
    first[word[::-1]] = np.arange(len(word) - 1, -1, -1)
    yield Level(1, own, np.bincount(word, minlength=len(known)), np.full(len(known), len(filters) > 1), (known, word, first))

    hashes = own
    gram = word  # number of the phrase that starts here, -1: none
    counted = [np.ones(len(known), bool) for _ in filters]  # by each filter's pass
    for n in range(2, longest + 1):
        asks = [c & f.has(hashes) for c, f in zip(counted, filters)]
        last = asks[-1] if filters else np.ones(len(hashes), bool)
        left, right = gram[:-1], gram[1:]
        at = np.flatnonzero(joined[: len(left)] & (left >= 0) & (right >= 0))
        at = at[last[left[at]] & last[right[at]]]
        number, many, first = _numbered(left[at] * len(known) + word[at + n - 1])
        place = at[first]
        counted = [a[left[place]] & a[right[place]] for a in asks]
        hashes = _extend(hashes[left[place]], own[word[place + n - 1]])
        earlier = np.logical_or.reduce(counted[:-1]) if len(counted) > 1 else np.zeros(many, bool)
        yield Level(n, hashes, np.bincount(number, minlength=many), earlier, (known, word, place))
        gram = np.full(len(left), -1, np.int64)
        gram[at] = number


def _texts(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[tuple[str, np.ndarray]]:
    """Language and lower-cased bytes, many rows at a time; a break lies between rows."""
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        codes = langs.indices.to_numpy(zero_copy_only=False)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch["text"].filter(pa.array(codes == k))
            for a, b in X.runs(X.utf8(texts)[1], chunk):
                joined = "\n".join(texts.slice(a, b - a).to_pylist()).encode()
                for part in _chunks(_LOWER[np.frombuffer(joined, np.uint8)], chunk):
                    yield lang, part


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every, n = every[order], np.concatenate(counts)[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])) if len(every) else np.zeros(0, np.int64)
    return every[first], np.add.reduceat(n, first) if len(first) else n


def _packed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as six planes of bytes of their differences; the upper planes are mostly zeros."""
    steps = np.diff(hashes >> _CUT, prepend=np.uint64(0)).astype("<u8")
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64) << _CUT


def _hashing(filters, longest: int, chunk: int, ranges: int, most: int, held: int = 2_000_000):
    """Hash counts of a task, packed by range of the hash; counts stop at ``most``."""
    kind = np.uint8 if most < 256 else np.int64

    def pack(hashes, counts) -> Iterator[pa.RecordBatch]:
        every, n = _summed(hashes, counts)
        n = np.minimum(n, most).astype(kind)
        edges = np.searchsorted(every, np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - max(1, int(ranges).bit_length() - 1))) if ranges > 1 else []
        for r, (a, b) in enumerate(zip([0, *edges], [*edges, len(every)])):
            if a < b:
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([_packed(every[a:b])], pa.binary()), pa.array([n[a:b].tobytes()], pa.binary())], ["range", "hashes", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value if filters is not None else []
        hashes, counts, size = [], [], 0
        for lang, part in _texts(batches, chunk):
            for level in levels(part, lang, known, longest):
                hashes.append(level.hashes >> _CUT << _CUT)
                counts.append(level.counts)
                size += len(level.hashes)
            if size >= held:
                yield from pack(hashes, counts)
                hashes, counts, size = [], [], 0
        if size:
            yield from pack(hashes, counts)

    return run


def _frequent_hashes(rows: DataFrame, filters, settings: Settings, longest: int, least: int, ranges: int) -> DataFrame:
    """(hash) of what is counted at least ``least`` times, checkpointed."""
    packed = rows.mapInArrow(_hashing(filters, longest, settings.chunk, ranges, least), "range int, hashes binary, counts binary")
    kind = np.uint8 if least < 256 else np.int64

    def add(key: tuple[pa.Scalar, ...], parts: pa.Table) -> pa.Table:
        hashes = [_unpacked(b.as_py()) for b in parts["hashes"]]
        counts = [np.frombuffer(b.as_py(), kind).astype(np.int64) for b in parts["counts"]]
        every, n = _summed(hashes, counts)
        return pa.table({"hash": pa.array(every[n >= least].view(np.int64))})

    return freeze(packed.groupBy("range").applyInArrow(add, "hash long"))


def _counting(filters, settled: bool, longest: int, chunk: int):
    """Phrases with their counts: what no earlier pass counted and, where ``settled``, what the last filter has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filters.value

        def rows(lang: str, n: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(counts)), pa.array(np.full(len(counts), n, np.int32)), phrases, pa.array(counts, pa.int64())], ["lang", "words", "phrase", "f"])

        for lang, part in _texts(batches, chunk):
            for level in levels(part, lang, known, longest):
                if settled and level.words == 1:
                    yield rows(lang, 0, pa.array([""]), np.array([level.counts.sum()]))
                some = ~level.earlier | known[-1].has(level.hashes) if settled else ~level.earlier
                if some.any():
                    yield rows(lang, level.words, level.texts(np.flatnonzero(some)), level.counts[some])

    return count


def _outside(filter_: Filter, context):
    """Whether hashes are not in the filter."""
    held = context.broadcast(filter_)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~held.value.has(batch["hash"].to_numpy().view(np.uint64))))

    return keep


def frequent_phrases(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, words, phrase, f): every phrase of up to ``longest`` words with f >= ``support``, exactly.

    The row with 0 words and an empty phrase holds the number of words of the language. The
    result is checkpointed. See ``collocations`` for the texts.
    """
    language = F.coalesce(column_like(docs, "lang", "string").cast("string"), F.lit("und")).alias("lang")
    rows = ship(docs).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), language)
    context = rows.sparkSession.sparkContext
    shorter = f"words BETWEEN 1 AND {settings.longest - 1}"
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(0, math.ceil(math.log2(max(1, size / settings.range_bytes))))

    sample = rows.sample(fraction=settings.sample, seed=settings.seed)
    proposed = _frequent_hashes(sample, None, settings, settings.longest - 1, settings.proposed_from, ranges)
    filters = [build_filter(proposed, settings.filter_bits)]
    counted = _frequent_hashes(rows, context.broadcast(filters), settings, settings.longest, settings.support, ranges)
    filters.append(build_filter(counted, settings.filter_bits))
    found = None
    while True:
        exact = rows.mapInArrow(_counting(context.broadcast(list(filters)), found is None, settings.longest, settings.chunk), "lang string, words int, phrase string, f long")
        more = freeze(exact.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(f"words = 0 OR f >= {settings.support}"))
        found = more if found is None else found.unionByName(more)
        # a frequent phrase outside the filter: longer ones over it are not counted yet
        known = _hashed(found.filter(shorter))
        if known.mapInArrow(_outside(filters[-1], context), "hash long").limit(1).count() == 0:
            return found
        filters.append(build_filter(known, settings.filter_bits))


# ---- scores -------------------------------------------------------------------------


def _words(part: Column, first: Column, count: Column) -> Column:
    return F.array_join(F.slice(part, first, count), " ")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in decimals of 38 digits."""
    wide = {c: f"CAST({c} AS DECIMAL(16, 0))" for c in (a, left, right)}
    return F.expr(f"({wide[a]} * {wide[a]} * CAST(1000000 AS DECIMAL(7, 0))) div ({wide[left]} * {wide[right]})")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to ``longest`` words of each language.

    ``docs`` has text and lang; A-Z count as a-z. Texts are split at ``.,;:!?`` and line
    breaks into pieces, pieces at spaces and tabs into words; phrases lie within a piece, and
    overlapping occurrences count. a: occurrences of the phrase, n: of all words. A phrase is
    cut in two where its score floor(1000000 a a / (l r)) is lowest (the earliest such cut);
    l and r are the occurrences of both parts. Phrases inside a longer candidate that has
    ``contained_percent`` of their occurrences go. Ties in score: more occurrences first,
    then the phrase in byte order. Counts up to 1e16 are scored exactly.

    Null or empty texts and texts without words add nothing; a null language, or a table
    without that column, counts as ``und``. Repeated rows count each time; other columns are
    ignored; an empty table gives no rows.
    """
    found = frequent_phrases(docs, settings)
    total = found.filter("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = found.filter(f"words BETWEEN 1 AND {settings.longest - 1}").select("lang", "phrase", "f")
    candidates = found.filter("words >= 2").select("lang", "phrase", F.col("f").alias("a"), "words", F.split("phrase", " ").alias("w"))

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words(F.col("w"), F.lit(1), F.col("k")).alias("first"), _words(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    for side, name in (("first", "l"), ("rest", "r")):
        known = parts.select(F.col("lang"), F.col("phrase").alias(side), F.col("f").alias(name))
        cuts = cuts.join(broadcast_checked(known), ["lang", side])
    scored = cuts.withColumn("score", _score("a", "l", "r")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))

    inner = candidates.filter("words >= 3").withColumn("m", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)))
    inner = inner.groupBy("lang", _words(F.col("w"), F.col("i"), F.col("m")).alias("phrase")).agg(F.max("a").alias("around"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(f"around IS NULL OR 100 * around < {settings.contained_percent} * cut.a").select("lang", "phrase", "cut.*")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = free_name(kept, "part")
    spread = kept.withColumn(part, F.pmod(F.xxhash64("phrase"), F.lit(settings.fan)))
    near = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= settings.top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= settings.top)
    return best.join(broadcast_checked(total), "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))
