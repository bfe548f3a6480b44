"""Reversible line dedup: exact reference counts in tables, cuckoo filters over the frequent keys.

A line's key is the line without blanks at both ends, A-Z as a-z; tables hold a 128-bit
BLAKE2 digest of it (two different keys among 1e12 share one with probability 1e-15). The
reference count of a key is the number of documents that hold it. Inserting documents writes
a table of added counts, deleting them one of subtracted counts; the sum over these tables
is exact at any time, and every so often they are written as one.

A key whose count reaches ``least_docs`` enters the cuckoo filter of its shard, and leaves it
when deletions take the count below: a cuckoo filter forgets an entry without a rebuild. To
clean documents, tasks screen their lines with the filters. A filter never misses a frequent
key; the few keys it reports by mistake are found against the exact table and spared.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.llm import text as X
from cellwise.llm.common import freeze, ship

# Fixed value: what counts as blank at the ends of a line.
_BLANKS = b" \t\n\x0b\x0c\r"
SLOTS = 4


@dataclass(frozen=True)
class Settings:
    """Keys of at least ``least_chars`` code points in at least ``least_docs`` documents are frequent.

    ``shard_keys`` frequent keys a filter when it is built. Filters of together at most
    ``broadcast_bytes`` go to every task, as do at most ``spared_keys`` mistaken keys; beyond
    either bound lines meet the exact table in a join. ``merge_after`` count tables become one.
    """

    least_docs: int = 10
    least_chars: int = 1
    shard_keys: int = 32_768
    broadcast_bytes: int = 64 << 20
    spared_keys: int = 200_000
    merge_after: int = 8
    flush: int = 200_000


# ---- cuckoo filters -----------------------------------------------------------------


def _prints(high: np.ndarray) -> np.ndarray:
    """32-bit fingerprints, none of them 0 (an empty slot)."""
    found = (high >> np.uint64(32)).astype(np.uint32)
    found[found == 0] = 1
    return found


def _hop(prints: np.ndarray) -> np.ndarray:
    return X.mix(prints.astype(np.uint64) + np.uint64(1))


class Cuckoo:
    """A cuckoo filter of ``buckets`` (a power of two) times four fingerprints."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.mask = buckets - 1
        self.slots = [0] * (buckets * SLOTS) if slots is None else slots.tolist()

    @staticmethod
    def build(high: np.ndarray, low: np.ndarray) -> Cuckoo:
        """A filter of these keys with room for about half as many again."""
        buckets = 1 << max(4, math.ceil(math.log2(max(1, len(high)) * 1.5 / SLOTS)))
        while not (made := Cuckoo(buckets)).insert(high, low):
            buckets *= 2
        return made

    def insert(self, high: np.ndarray, low: np.ndarray) -> bool:
        """Add keys; False if one found no place (the filter must then be built anew)."""
        prints, hops = _prints(high), _hop(_prints(high))
        return all(self._put(p, b & self.mask, h & self.mask, n) for n, (p, b, h) in enumerate(zip(prints.tolist(), low.tolist(), hops.tolist())))

    def _put(self, fingerprint: int, bucket: int, hop: int, turn: int) -> bool:
        slots = self.slots
        for kick in range(500):
            for place in (bucket, bucket ^ hop):
                for k in range(place * SLOTS, place * SLOTS + SLOTS):
                    if slots[k] == 0:
                        slots[k] = fingerprint
                        return True
            bucket ^= hop
            k = bucket * SLOTS + (turn + kick) % SLOTS
            fingerprint, slots[k] = slots[k], fingerprint
            hop = int(_hop(np.array([fingerprint], np.uint32))[0]) & self.mask
        return False

    def remove(self, high: np.ndarray, low: np.ndarray) -> None:
        """Take out keys that were inserted before."""
        prints, hops = _prints(high), _hop(_prints(high))
        for fingerprint, low_, hop in zip(prints.tolist(), low.tolist(), hops.tolist()):
            for place in (low_ & self.mask, (low_ & self.mask) ^ (hop & self.mask)):
                bucket = self.slots[place * SLOTS : place * SLOTS + SLOTS]
                if fingerprint in bucket:
                    self.slots[place * SLOTS + bucket.index(fingerprint)] = 0
                    break
            else:
                raise KeyError("the key is not in this filter")

    def to_bytes(self) -> bytes:
        return np.array(self.slots, "<u4").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> Cuckoo:
        slots = np.frombuffer(data, "<u4")
        return Cuckoo(len(slots) // SLOTS, slots)


@dataclass(frozen=True)
class Filters:
    """All shards for looking up many keys at once."""

    slots: np.ndarray
    start: np.ndarray
    mask: np.ndarray

    @staticmethod
    def of(tables: list[bytes]) -> Filters:
        sizes = np.array([len(t) // (4 * SLOTS) for t in tables], np.int64)
        slots = np.frombuffer(b"".join(tables), "<u4").reshape(-1, SLOTS)
        return Filters(slots, np.cumsum(sizes) - sizes, sizes - 1)

    def has(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        shard = _shard_of(high, len(self.start))
        mask = self.mask[shard].astype(np.uint64)
        prints = _prints(high)
        one = low & mask
        two = one ^ (_hop(prints) & mask)
        found = np.zeros(len(high), bool)
        for bucket in (one, two):
            found |= (self.slots[self.start[shard] + bucket.astype(np.int64)] == prints[:, None]).any(axis=1)
        return found


def _shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high % np.uint64(shards)).astype(np.int64)


# ---- keys ---------------------------------------------------------------------------


def line_keys(lines: list[bytes], least_chars: int) -> list[bytes]:
    """Digest of each line's key; empty for keys that are too short."""
    found = []
    for line in lines:
        key = line.strip(_BLANKS).lower()  # bytes.lower touches A-Z alone
        short = not key or (least_chars > 1 and len(key.decode()) < least_chars)
        found.append(b"" if short else hashlib.blake2b(key, digest_size=16).digest())
    return found


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _raw(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    data, offsets = X.utf8(column)
    view = data.tobytes() if len(offsets) > 1 and offsets[-1] - offsets[0] == len(data) else data[offsets[0] : offsets[-1]].tobytes()
    at = (offsets - (0 if len(view) == len(data) else offsets[0])).tolist()
    return (view[a:b] for a, b in zip(at, at[1:]))


def _counting(settings: Settings, screen=None):
    """Key and number of documents that hold it, added up in the task; ``screen``: only keys the filters report."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            high, low = _halves(list(held))
            n = np.fromiter(held.values(), np.int64, len(held))
            if screen is not None:
                some = screen.value.has(high, low)
                high, low, n = high[some], low[some], n[some]
            return pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(n)], ["high", "low", "n"])

        for batch in batches:
            for raw in _raw(batch["text"]):
                for key in set(line_keys(raw.split(b"\n"), settings.least_chars)):
                    if key:
                        held[key] = held.get(key, 0) + 1
                if len(held) >= settings.flush:
                    yield flush()
                    held.clear()
        if held:
            yield flush()

    return count


_COUNTS = "high long, low long, n long"
_KEY = ["high", "low"]


def _key_counts(docs: DataFrame, settings: Settings, screen=None) -> DataFrame:
    return docs.select(F.col("text").cast("string")).mapInArrow(_counting(settings, screen), _COUNTS).groupBy(*_KEY).agg(F.sum("n").alias("n"))


def _cleaning(settings: Settings, filters, spared):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in X.runs(X.utf8(batch["text"])[1], 1 << 22):
                rows = [raw.split(b"\n") for raw in _raw(batch["text"].slice(a, b - a))]
                keys = [k for lines in rows for k in line_keys(lines, settings.least_chars)]
                named = np.array([k != b"" for k in keys], bool)
                high, low = _halves([k for k in keys if k])
                drop = np.zeros(len(keys), bool)
                drop[named] = filters.value.has(high, low)
                if spared.value:
                    for k in np.flatnonzero(drop).tolist():
                        drop[k] = keys[k] not in spared.value
                sizes = np.array([len(lines) for lines in rows], np.int64)
                ends = np.cumsum(sizes)
                gone = np.diff(np.append(0, np.append(0, np.cumsum(drop))[ends]))
                kept = [b"\n".join(lines) if not g else b"\n".join(x for x, d in zip(lines, drop[e - len(lines) : e].tolist()) if not d) for lines, g, e in zip(rows, gone.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array(sizes), pa.array(gone.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_lines", "n_dropped", "text"],
                )

    return clean


def _occurrences(settings: Settings):
    """(text digest, key, its line numbers) of every text."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in X.runs(X.utf8(batch["text"])[1], 1 << 22):
                texts, keys, places = [], [], []
                for raw in _raw(batch["text"].slice(a, b - a)):
                    own: dict[bytes, list[int]] = {}
                    for k, key in enumerate(line_keys(raw.split(b"\n"), settings.least_chars)):
                        if key:
                            own.setdefault(key, []).append(k)
                    texts += [hashlib.md5(raw).hexdigest()] * len(own)
                    keys += own.keys()
                    places += own.values()
                high, low = _halves(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(texts, pa.string()), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), pa.array(places, pa.list_(pa.int32()))],
                    ["of", "high", "low", "places"],
                )

    return emit


# ---- the index ----------------------------------------------------------------------


class LineIndex:
    """Reference counts and filters of inserted documents, below ``root`` in shared storage.

    Every step writes its tables and then one row of ``root/steps``, which makes it count;
    what a failed step left behind is ignored. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, settings: Settings = Settings()):
        self.spark, self.root, self.settings = spark, root, settings
        self.step, self.tables, self.filters = 0, [], None

    @staticmethod
    def open(spark: SparkSession, root: str, settings: Settings = Settings()) -> LineIndex:
        """The index as its last finished step left it."""
        index = LineIndex(spark, root, settings)
        last = spark.read.parquet(f"{root}/steps").orderBy(F.col("step").desc()).first()
        index.step, index.tables, index.filters = last["step"], list(last["tables"]), last["filters"]
        return index

    def counts(self) -> DataFrame:
        """(high, low, n): every key of the inserted documents with the number that hold it."""
        if not self.tables:
            return self.spark.createDataFrame([], _COUNTS)
        found = self.spark.read.schema(_COUNTS).parquet(*self.tables)
        return found if len(self.tables) == 1 else found.groupBy(*_KEY).agg(F.sum("n").alias("n")).filter("n <> 0")

    def frequent(self) -> DataFrame:
        return self.counts().filter(F.col("n") >= self.settings.least_docs)

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}-{self.step}-{uuid.uuid4().hex}"

    def insert(self, docs: DataFrame) -> None:
        """Count the documents of ``docs`` (text) in."""
        self._change(docs, 1)

    def delete(self, docs: DataFrame) -> None:
        """Count documents out again; an error, and no change, if some were never inserted."""
        self._change(docs, -1)

    def _change(self, docs: DataFrame, sign: int) -> None:
        self.step += 1
        path = self._path("counts")
        _key_counts(ship(docs), self.settings).select(*_KEY, (F.col("n") * sign).alias("n")).write.parquet(path)
        first = not self.tables
        if first and sign > 0:
            tables, filters = [path], self._build(self.spark.read.schema(_COUNTS).parquet(path))
        else:
            delta = self.spark.read.schema(_COUNTS).parquet(path)
            before = self.counts().withColumnRenamed("n", "before")
            changed = freeze(delta.join(before, _KEY, "left").select(*_KEY, F.coalesce("before", F.lit(0)).alias("before"), (F.coalesce("before", F.lit(0)) + F.col("n")).alias("after")))
            if changed.filter("after < 0").limit(1).count():
                raise ValueError("documents to delete that were not inserted")
            tables = [*self.tables, path]
            least = self.settings.least_docs
            crossed = changed.filter(f"(before < {least}) <> (after < {least})")
            filters = self._update(crossed)
            if filters is None:
                held, self.tables = self.tables, tables
                filters, self.tables = self._build(self.counts()), held
        if len(tables) > self.settings.merge_after:
            merged, held, self.tables = self._path("counts"), self.tables, tables
            self.counts().write.parquet(merged)
            tables, self.tables = [merged], held
        self.spark.createDataFrame([(self.step, tables, filters)], "step int, tables array<string>, filters string").coalesce(1).write.mode("append").parquet(f"{self.root}/steps")
        self.tables, self.filters = tables, filters

    def _build(self, counts: DataFrame) -> str:
        """Filters of all frequent keys, in as many shards as they need."""
        frequent = counts.filter(F.col("n") >= self.settings.least_docs).select(*_KEY)
        shards = max(1, math.ceil(frequent.count() / self.settings.shard_keys))
        path = self._path("filters")

        def build(key: tuple[pa.Scalar, ...], keys: pa.Table) -> pa.Table:
            high, low = keys["high"].to_numpy().view(np.uint64), keys["low"].to_numpy().view(np.uint64)
            real = keys["real"].to_numpy(zero_copy_only=False)
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([Cuckoo.build(high[real], low[real]).to_bytes()], pa.binary()), "fits": pa.array([True])})

        every = self.spark.range(shards).select(F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), F.lit(False).alias("real"), F.col("id").cast("int").alias("shard"))
        real = frequent.withColumn("real", F.lit(True)).withColumn("shard", _shard_column(shards))
        real.unionByName(every).groupBy("shard").applyInArrow(build, _FILTERS).write.parquet(path)
        return path

    def _update(self, crossed: DataFrame) -> str | None:
        """Filters after keys became frequent or stopped to be; None if a shard has no room left."""
        old = self.spark.read.schema(_FILTERS).parquet(self.filters)
        path, least = self._path("filters"), self.settings.least_docs

        def update(key: tuple[pa.Scalar, ...], table: pa.Table, keys: pa.Table) -> pa.Table:
            cuckoo = Cuckoo.from_bytes(table["slots"][0].as_py())
            high, low, enters = keys["high"].to_numpy().view(np.uint64), keys["low"].to_numpy().view(np.uint64), keys["after"].to_numpy() >= least
            cuckoo.remove(high[~enters], low[~enters])
            fits = cuckoo.insert(high[enters], low[enters])
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": pa.array([cuckoo.to_bytes()], pa.binary()), "fits": pa.array([fits])})

        keyed = crossed.withColumn("shard", _shard_column(old.count()))
        old.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInArrow(update, _FILTERS).write.parquet(path)
        return path if self.spark.read.schema(_FILTERS).parquet(path).filter("NOT fits").limit(1).count() == 0 else None

    def clean(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_lines, n_dropped, text): ``docs`` without the lines whose key is frequent now.

        One row per row of ``docs``, which need not be inserted. Texts are split at line
        feeds; null and empty texts are one empty line and come back empty. A key is the line
        stripped of blanks with A-Z in lower case; lines with an empty or too short key stay.
        Lines that stay keep their bytes and are joined by line feeds. Repeated rows count as
        documents of their own; other columns are ignored; an empty table gives no rows.
        """
        rows = ship(docs).select("doc_id", F.col("text").cast("string").alias("text"))
        if self.filters is None:
            return self._joined(rows)
        shards = self.spark.read.schema(_FILTERS).parquet(self.filters)
        if shards.agg(F.sum(F.octet_length("slots"))).first()[0] > self.settings.broadcast_bytes:
            return self._joined(rows)
        held = shards.orderBy("shard").select("slots").toArrow()["slots"].to_pylist()
        filters = self.spark.sparkContext.broadcast(Filters.of(held))
        # what the filters report among these documents, held against the exact table
        mistaken = freeze(_key_counts(rows, self.settings, filters).join(self.frequent(), _KEY, "left_anti").select(*_KEY))
        if mistaken.limit(self.settings.spared_keys + 1).count() > self.settings.spared_keys:
            return self._joined(rows)
        found = mistaken.toArrow()
        keys = np.stack([found["high"].to_numpy(), found["low"].to_numpy()], axis=1).astype("<i8")
        spared = self.spark.sparkContext.broadcast({k.tobytes() for k in keys})
        kind = rows.schema["doc_id"].dataType.simpleString()
        return rows.mapInArrow(_cleaning(self.settings, filters, spared), f"doc_id {kind}, n_lines long, n_dropped long, text string")

    def _joined(self, rows: DataFrame) -> DataFrame:
        """The same where filters are too large for every task: lines meet the exact table by key.

        Equal texts lose equal lines, so each text's digest stands for its copies; adaptive
        execution splits a key that very many texts hold.
        """
        texts = rows.select(F.coalesce("text", F.lit("")).alias("text"))
        lines = texts.mapInArrow(_occurrences(self.settings), "of string, high long, low long, places array<int>").groupBy("of", *_KEY).agg(F.min("places").alias("places"))
        gone = lines.join(self.frequent().select(*_KEY), _KEY).groupBy("of").agg(F.flatten(F.collect_list("places")).alias("gone"))
        split = rows.withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n")).withColumn("of", F.md5(F.coalesce("text", F.lit(""))))
        both = split.join(gone, "of", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        kept = F.filter("lines", lambda line, k: ~F.array_contains("gone", k))
        return both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


_FILTERS = "shard int, slots binary, fits boolean"


def _shard_column(shards: int):
    """``high`` as an unsigned number modulo ``shards``."""
    return F.expr(f"CAST(pmod(pmod(high, {shards}L) + IF(high < 0, {pow(2, 64, shards)}L, 0L), {shards}L) AS INT)")


def drop_frequent_lines(docs: DataFrame, root: str, settings: Settings = Settings()) -> DataFrame:
    """Insert ``docs`` into a new index at ``root`` and clean them by it; see ``LineIndex.clean``."""
    index = LineIndex(docs.sparkSession, root, settings)
    index.insert(docs)
    return index.clean(docs)
