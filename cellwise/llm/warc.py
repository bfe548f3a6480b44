"""WARC archives with revisit records, and their index merged from sorted runs.

Each task writes one archive of gzip members into shared storage and returns its captures as
a run sorted by URL key and time. Runs meet in ranges of that order; in every range a loser
tree merges what each run has there. Together the ranges are one globally ordered capture
index, through which the archives are read back.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cellwise.llm.common import freeze, partitions_for, scalar, ship
from cellwise.session import broadcast_checked, scratch_path

LEAST_REVISIT = 100
RANGE_ROWS = 50_000
READ_BYTES = 8 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def url_key(url: str | Column) -> Column:
    """Sort key of a URL: host labels from the right, then path and query, in lower case.

    Scheme, port, user and fragment do not count. A text without scheme is all path.
    """
    url = F.lower(F.col(url) if isinstance(url, str) else url)
    host = F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#:]*)", 1)
    path = F.regexp_extract(url, r"^(?:[a-z][a-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path))


def planned(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html, fetched_at) with payload, digest, role and what a revisit refers to.

    Only payloads met more than once are looked up; their table is broadcast when a count
    shows that it is small, else both sides are shuffled.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"), F.coalesce(F.date_format("fetched_at", "yyyyMMddHHmmss"), F.lit("")).alias("stamp")
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("key", F.coalesce(url_key("url"), F.lit("")))
    large = rows.filter(F.octet_length("payload") >= LEAST_REVISIT)
    met = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first_id IS NOT NULL")
    joined = rows.join(broadcast_checked(freeze(met.select("digest", "first_id"))), "digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))).drop("first_id")


def record(page_id: int | None, url: str | None, stamp: str, digest: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, whose Content-Length is the payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]')}")
    if stamp:
        lines.append(f"WARC-Date: {stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z")
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[int | None, str, int, str, int | None]:
    """page_id, type, payload bytes, payload digest and refers_to of a record.

    A response's payload is hashed and measured anew and must agree with the header.
    """
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")

    def number(field: str) -> int | None:
        text = fields.get(field, "").strip("<>").removeprefix(_URN)
        return int(text) if text else None

    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"Damaged record {fields['WARC-Record-ID']}")
    return number("WARC-Record-ID"), fields["WARC-Type"], size, digest, number("WARC-Refers-To")


def _writing(folder: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One archive a task attempt: a repeated attempt writes its own and its index names that."""
        task = TaskContext.get()
        store, root = pa.fs.FileSystem.from_uri(folder)
        run = f"{task.partitionId():06d}-{uuid.uuid4().hex}"
        path, entries, at, out = f"{root}/{run}.warc.gz", [], 0, None
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        store.create_dir(root, recursive=True)
                        out = store.open_output_stream(path, compression=None)  # members are packed here
                    raw = record(row["page_id"], row["url"], row["stamp"], row["digest"], row["payload"], row["refers_to"])
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    entries.append((row["key"], row["stamp"], -1 if row["page_id"] is None else row["page_id"], at, len(member)))
                    at += len(member)
        finally:
            if out is not None:
                out.close()
        entries.sort()
        for k in range(0, len(entries), RANGE_ROWS):
            part = list(zip(*entries[k : k + RANGE_ROWS]))
            names = [pa.array([run] * len(part[0]), pa.string()), pa.array(part[0], pa.string()), pa.array(part[1], pa.string()), *(pa.array(p, pa.int64()) for p in part[2:])]
            yield pa.RecordBatch.from_arrays(names, ["run", "key", "stamp", "page_id", "at", "bytes"])

    return write


class LoserTree:
    """Merge of sorted lists: each inner node keeps the loser, the winner moves up."""

    def __init__(self, runs: list[list]):
        self.runs, self.next = runs, [0] * len(runs)
        self.width = 1 << max(len(runs) - 1, 0).bit_length()
        self.losers = [-1] * self.width
        winners = [k if k < len(runs) else -1 for k in range(self.width)]
        base = self.width
        level = winners
        while base > 1:
            base //= 2
            above = []
            for k in range(base):
                win, lose = self._play(level[2 * k], level[2 * k + 1])
                self.losers[base + k] = lose
                above.append(win)
            level = above
        self.winner = level[0]

    def _head(self, run: int):
        return self.runs[run][self.next[run]] if run >= 0 and self.next[run] < len(self.runs[run]) else None

    def _play(self, a: int, b: int) -> tuple[int, int]:
        x, y = self._head(a), self._head(b)
        return (a, b) if y is None or (x is not None and (x, a) <= (y, b)) else (b, a)

    def __iter__(self):
        while (head := self._head(self.winner)) is not None:
            yield head, self.winner
            run = self.winner
            self.next[run] += 1
            node = (self.width + run) // 2
            while node:
                run, self.losers[node] = self._play(run, self.losers[node])
                node //= 2
            self.winner = run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            runs.setdefault(row["run"], []).append((row["key"], row["stamp"], row["page_id"], row["at"], row["bytes"]))
    names = sorted(runs)
    for name in names:  # blocks of one run can arrive in any order
        if any(a > b for a, b in zip(runs[name], runs[name][1:])):
            runs[name].sort()
    part, held, place = TaskContext.get().partitionId(), [], 0

    def batch(held: list) -> pa.RecordBatch:
        cut = list(zip(*held))
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cut, kinds)], ["part", "place", "run", "key", "stamp", "page_id", "at", "bytes"])

    for entry, run in LoserTree([runs[n] for n in names]) if names else ():
        held.append((part, place, names[run], *entry))
        place += 1
        if len(held) == 10_000:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def merged_index(runs: DataFrame, rows: int) -> DataFrame:
    """The captures of all runs with ``position``, their gapless place in the whole order.

    Ranges are cut over (key, time, page), so a URL with any number of captures spans several.
    """
    ranges = max(1, math.ceil(rows / RANGE_ROWS))
    merged = freeze(
        runs.repartitionByRange(ranges, "key", "stamp", "page_id").mapInArrow(_merge, "part int, place long, run string, key string, stamp string, page_id long, at long, bytes long")
    )
    sizes = merged.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return merged.join(F.broadcast(offsets) if ranges <= 100_000 else offsets, "part").withColumn("position", F.col("before") + F.col("place")).drop("part", "place", "before")


def write_archives(pages: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write every row of ``pages`` as a record below ``folder``; the merged capture index.

    The runs are checkpointed before anything reads them: an attempt that is lost or repeated
    leaves at most an archive that no index row names.
    """
    rows = planned(ship(pages)).select("page_id", "url", "payload", "stamp", "digest", "key", "refers_to")
    runs = freeze(rows.mapInArrow(_writing(folder, level), "run string, key string, stamp string, page_id long, at long, bytes long"))
    return merged_index(runs, runs.count())


def _reading(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pa.fs.FileSystem.from_uri(folder)
        name, archive = None, None
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                if row["run"] != name:
                    if archive is not None:
                        archive.close()
                    name = row["run"]
                    archive = store.open_input_file(f"{root}/{name}.warc.gz")
                raw = zlib.decompress(archive.read_at(row["bytes"], row["at"]), 31)
                page, kind, size, digest, refers = parse(raw)
                found.append((page, size, digest, kind, refers, row["position"], row["key"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*found)) if found else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "position", "url_key"])
        if archive is not None:
            archive.close()

    return read


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every indexed record read back, each archive in the order of its bytes, in parts of bounded size."""
    total = scalar(index.agg(F.coalesce(F.sum("bytes"), F.lit(0))))
    part = F.expr(f"at div {READ_BYTES}")
    rows = index.select("run", "at", "bytes", "position", "key").repartition(partitions_for(total, READ_BYTES), F.col("run"), part).sortWithinPartitions("run", "at")
    return rows.mapInArrow(_reading(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, position long, url_key string")


def round_trip(pages: DataFrame, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html, fetched_at) to archives and read them back by the index.

    page_id, payload_bytes, payload_digest, record_type, refers_to, position and url_key, a
    row for every row. Null html is an empty payload; null url and null time give empty keys,
    which sort first. Payloads under 100 bytes are always responses. Rows that repeat the
    least page_id of a payload are all responses; a null page_id is a revisit wherever a row
    with an id has the same payload, and sorts before the others of its key and time. Other
    columns are ignored. An empty table gives an empty table.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, level), folder)
