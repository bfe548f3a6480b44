"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if some ``LENGTH``-byte string over it also starts in a document with a smaller
doc_id. Suffixes of a whole corpus do not fit one task, so each is sent to where its equals
are: every window of LENGTH bytes names its anchor, the leftmost of its GRAM-byte strings
with the least hash. Equal windows have equal anchors at equal places.

0. Documents whose whole text is that of a smaller document go at once; what they repeat
   stands in that document too, so they take no part in the steps below.
1. Each block of documents reports its distinct anchors; anchors met once are dropped.
2. For the rest each block sends the bytes beside the anchor (only those of windows that
   name it), equal ones once, with their least doc_id.
3. The texts around one anchor meet in one partition. Their suffixes are sorted, and the
   previous and next suffixes of a smaller document give each suffix's longest factor met
   in an earlier document: windows of LENGTH or more are repeats.
4. Each block marks its bytes and cuts them out.

The text is shuffled once, by block; the three passes read the same exchange. Blocks and
partitions hold a bounded number of bytes and their number follows the corpus. A string
that occurs everywhere costs a row a block, not a row a document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellwise.llm import text as X
from cellwise.llm.common import free_name, freeze, partitions_for, scalar, ship, utf8_length

LENGTH = 50
GRAM = 20
SIDE = LENGTH - GRAM  # windows that may name one anchor start up to SIDE bytes before it
AROUND = LENGTH + SIDE
BLOCK_BYTES = 4 << 20
REPORT_BYTES = 12 << 20  # text bytes whose anchors one partition of step 1 reads
MATCH_BYTES = 4 << 20
RUN_BYTES = 1 << 18
SUFFIXES_AT_ONCE = 50_000


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Anchors of the windows of rows [starts, ends) of ``data``.

    Gives, for each run of consecutive windows with one anchor: its position, its hash, the
    first and the last window of the run.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none
    one = X.BYTE_VALUES[data]
    powers = [np.uint64(pow(X._BASE, k, 1 << 64)) for k in (1, 2, 4, 8)]
    two = one[:-1] * powers[0] + one[1:]
    four = two[:-2] * powers[1] + two[2:]
    eight = four[:-4] * powers[2] + four[4:]
    sixteen = eight[:-8] * powers[3] + eight[8:]
    grams = sixteen[:-4] * powers[2] + four[16:]
    del one, two, four, eight, sixteen
    grams = X.mix(grams)
    least, place = grams, np.arange(len(grams), dtype=np.int32)

    def step(shift: int, least: np.ndarray, place: np.ndarray):
        left, right = least[:-shift], least[shift:]
        take = left <= right
        return np.where(take, left, right), np.where(take, place[:-shift], place[shift:])

    span = 1
    while span * 2 <= SIDE + 1:
        least, place = step(span, least, place)
        span *= 2
    if span < SIDE + 1:
        least, place = step(SIDE + 1 - span, least, place)
    sizes = np.maximum(ends - starts - (LENGTH - 1), 0)
    total = int(sizes.sum())
    if not total:
        return none, none.astype(np.uint64), none, none
    windows = np.repeat(starts - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(total)
    named = place[windows]
    first = np.flatnonzero(np.append(True, named[1:] != named[:-1]))
    last = np.append(first[1:], total) - 1
    at = named[first].astype(np.int64)
    return at, grams[at], windows[first], windows[last]


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row + 1, from byte, to byte): runs of rows, long rows in overlapping pieces."""
    for a, b in X.runs(offsets, RUN_BYTES):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a == 1 and hi - lo > RUN_BYTES:
            for at in range(lo, hi - LENGTH + 1, RUN_BYTES):
                yield a, b, at, min(at + RUN_BYTES + LENGTH - 1, hi)
        else:
            yield a, b, lo, hi


def _found(data: np.ndarray, offsets: np.ndarray):
    """Anchors of every piece: absolute positions, hashes, first and last windows, rows."""
    for a, b, lo, hi in _pieces(offsets):
        starts, ends = np.clip(offsets[a:b], lo, hi) - lo, np.clip(offsets[a + 1 : b + 1], lo, hi) - lo
        at, gram, first, last = anchors(data[lo:hi], starts, ends)
        if len(at):
            row = a + np.searchsorted(offsets[a + 1 : b + 1], first + lo, side="right")
            yield at + lo, gram, first + lo, last + lo, row


def _ids(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = blocks["doc_id"].combine_chunks()
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False)


def _texts(blocks: pa.Table, mark: str, beside: pa.Table):
    """Bytes, offsets, ids, rows that take no part (copies and rows without a doc_id), and copies."""
    data, offsets = X.utf8(blocks["text"])
    ids, unnamed = _ids(blocks)
    copies = np.isin(blocks[mark].to_numpy(), beside["copy"].drop_null().to_numpy())
    return data, offsets, ids, unnamed | copies, copies


def _report(block: str, mark: str):
    """Step 1: the distinct anchors of a block, and whether several of its documents have them."""

    def report(key: tuple[pa.Scalar, ...], rows: pa.Table, beside: pa.Table) -> pa.Table:
        data, offsets, ids, unnamed, _ = _texts(rows, mark, beside)
        grams, owners = [], []
        for _, gram, _, _, row in _found(data, offsets):
            keep = ~unnamed[row]
            grams.append(gram[keep])
            owners.append(ids[row[keep]])
        gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((owner, gram))
        gram, owner = gram[order], owner[order]
        new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(gram))[: len(head)] - 1
        return pa.table({"gram": gram[head].view(np.int64), block: pa.array(np.full(len(head), key[0].as_py()), pa.int32()), "many": owner[head] != owner[tail]})

    return report


def _gather(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _in_batches(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from rows.to_batches(max_chunksize=50_000)


def _repeated(block: str):
    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gather(batches)
        if rows is None:
            return
        gram = rows["gram"].to_numpy()
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        head = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        size = np.diff(np.append(head, len(gram)))
        many = np.maximum.reduceat(rows["many"].to_numpy(zero_copy_only=False)[order].astype(np.int8), head)
        keep = np.repeat((size > 1) | (many > 0), size)
        chosen = pa.table({block: rows[block].to_numpy()[order][keep], "gram": gram[keep]})
        yield from _in_batches(chosen)

    return repeated


def _surroundings(data, offsets, at, first, last, row) -> np.ndarray:
    """Bytes from SIDE before to LENGTH after each anchor; zero outside the windows that name it.

    The anchor itself, the same wherever its hash is, is zero too.
    """
    span = np.arange(-SIDE, LENGTH, dtype=np.int64)
    place = at[:, None] + span
    inside = (place >= first[:, None]) & (place < last[:, None] + LENGTH)
    inside[:, SIDE : SIDE + GRAM] = False
    np.clip(place, 0, len(data) - 1, out=place)
    return np.where(inside, data[place], 0).astype(np.uint8)


def _class(gram: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return X.mix(X.digest64(around) + gram * X.WORD_STEP + (low * 64 + high).astype(np.uint64))


def _listed(data, offsets, listed: np.ndarray):
    """Surroundings of the anchors in sorted ``listed``."""
    for at, gram, first, last, row in _found(data, offsets):
        near = np.minimum(np.searchsorted(listed, gram), len(listed) - 1)
        keep = np.flatnonzero(listed[near] == gram)
        for k in range(0, len(keep), 20_000):
            part = keep[k : k + 20_000]
            around = _surroundings(data, offsets, at[part], first[part], last[part], row[part])
            low, high = first[part] - at[part] + SIDE, last[part] - at[part] + SIDE
            yield gram[part], around, low, high, first[part], row[part], _class(gram[part], around, low, high)


_SENT = pa.schema([("gram", pa.int64()), ("range", pa.int16()), ("beside", pa.binary()), ("doc", pa.int64())])


def _beside(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which bytes of the surroundings are sent: left of the anchor from low, right of it up to high."""
    span = np.arange(AROUND)
    return ((span >= low[:, None]) & (span < SIDE)) | ((span >= SIDE + GRAM) & (span < high[:, None] + LENGTH))


def _packed(around: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    at = np.append(0, np.cumsum(SIDE - low + high)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(low), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(around[_beside(low, high)].tobytes())])


def _unpacked(packed, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    data, at = X.utf8(packed)
    around = np.zeros((len(low), AROUND), np.uint8)
    around[_beside(low, high)] = data[int(at[0]) : int(at[-1])]
    return around


def _send(block: str, mark: str):
    """Step 2: distinct surroundings of the block's repeated anchors, with the least doc_id."""

    def send(key: tuple[pa.Scalar, ...], rows: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = _SENT.empty_table().append_column(block, pa.array([], pa.int32()))
        listed = np.sort(wanted["gram"].drop_null().to_numpy().view(np.uint64))
        if not rows.num_rows or not len(listed):
            return empty
        data, offsets, ids, unnamed, _ = _texts(rows, mark, wanted)
        kept = []
        for gram, around, low, high, _, row, kind in _listed(data, offsets, listed):
            keep = ~unnamed[row]
            doc = ids[row]
            order = np.lexsort((doc, kind))
            order = order[keep[order]]
            if not len(order):
                continue
            head = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1]))
            tail = np.append(head[1:], len(order)) - 1
            many = doc[order[head]] != doc[order[tail]]
            order = order[head]
            kept.append((gram[order], low[order], high[order], around[order], kind[order], doc[order], many))
        if not kept:
            return empty
        gram, low, high, around, kind, doc, many = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((doc, kind))
        head = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1]))
        tail = np.append(head[1:], len(order)) - 1
        several = (np.add.reduceat(many[order].astype(np.int64), head) > 0) | (doc[order[head]] != doc[order[tail]])
        order = order[head]
        low, high = low[order], high[order]
        return pa.table(
            {"gram": gram[order].view(np.int64), "range": (low + 32 * high + 1024 * several).astype(np.int16), "beside": _packed(around[order], low, high), "doc": doc[order]}
        ).append_column(block, pa.array(np.full(len(order), key[0].as_py()), pa.int32()))

    return send


def longest_previous(texts: np.ndarray, lengths: np.ndarray, group: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Longest prefix each suffix shares with a suffix of its group in a smaller document.

    ``texts``: zero-padded byte matrix. Suffixes are sorted; for each one the previous and
    the next in that order with a smaller document are found by following such links, the
    common prefix narrowing on the way.
    """
    n, width = texts.shape
    keyed = np.concatenate([group.astype(">u8").view(np.uint8).reshape(n, 8), texts], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{width + 8}").ravel(), kind="stable")
    keyed, lengths, docs = keyed[order], lengths[order], docs[order]
    differ = keyed[1:] != keyed[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width + 8) - 8
    common = np.minimum(np.maximum(common, 0), np.minimum(lengths[1:], lengths[:-1]))

    def one_side(docs: np.ndarray, common: np.ndarray) -> np.ndarray:
        link = np.arange(-1, n - 1)
        shared = np.append(0, common)
        open_ = np.flatnonzero((link >= 0) & (shared > 0))
        while len(open_):
            open_ = open_[(link[open_] >= 0) & (shared[open_] > 0)]
            open_ = open_[docs[link[open_]] >= docs[open_]]
            over = link[open_]
            shared[open_] = np.minimum(shared[open_], shared[over])
            link[open_] = link[over]
        return np.where(link >= 0, shared, 0)

    best = np.maximum(one_side(docs, common), one_side(docs[::-1], common[::-1])[::-1])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _match(block: str):
    """Step 3: for every sent class, its least document and the windows repeated even there."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _gather(batches)
        if rows is None:
            return
        gram, doc, packed = rows["gram"].to_numpy(), rows["doc"].to_numpy(), rows["range"].to_numpy().astype(np.int64)
        kind = np.empty(len(gram), np.uint64)
        for k in range(0, len(gram), SUFFIXES_AT_ONCE):
            part = slice(k, k + SUFFIXES_AT_ONCE)
            ends = packed[part] % 32, packed[part] // 32 % 32
            around = _unpacked(rows["beside"].slice(k, SUFFIXES_AT_ONCE), *ends)
            kind[part] = _class(gram[part].view(np.uint64), around, *ends)
        kind = kind.view(np.int64)
        order = np.lexsort((doc, kind, gram))
        gram, kind, doc = gram[order], kind[order], doc[order]
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new_kind = new_gram | np.append(True, kind[1:] != kind[:-1])
        head = np.flatnonzero(new_kind)
        of = np.cumsum(new_kind) - 1
        least = doc[head]
        family = (np.cumsum(new_gram) - 1)[head]
        several = np.bincount(family)[family] > 1
        low, high = packed[order[head]] % 32, packed[order[head]] // 32 % 32
        masks = np.zeros(len(head), np.int64)
        todo = np.flatnonzero(several)
        weight = np.cumsum(high[todo] - low[todo] + 1)
        begin = 0
        while begin < len(todo):
            end = int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + SUFFIXES_AT_ONCE, side="right"))
            end = max(end, begin + 1)
            while end < len(todo) and family[todo[end]] == family[todo[end - 1]]:
                end += 1
            part = todo[begin:end]
            begin = end
            counts = high[part] - low[part] + 1
            who = np.repeat(np.arange(len(part)), counts)
            start = np.arange(counts.sum()) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts) + low[part][who]
            around = _unpacked(rows["beside"].take(pa.array(order[head[part]])), low[part], high[part])
            padded = np.concatenate([around, np.zeros_like(around)], axis=1)
            suffixes = padded[who[:, None], start[:, None] + np.arange(AROUND)]
            lengths = high[part][who] + LENGTH - start
            previous = longest_previous(suffixes, lengths, family[part][who], least[part][who])
            hit = previous >= LENGTH
            np.bitwise_or.at(masks, part[who[hit]], np.left_shift(np.int64(1), start[hit]))
        many = packed[order] >= 1024
        useful = many | (doc > least[of]) | (masks[of] != 0)
        yield from _in_batches(
            pa.table({block: rows[block].to_numpy()[order][useful], "gram": gram[useful], "class": kind[useful], "least": least[of][useful], "mask": masks[of][useful]})
        )

    return match


def _cut(columns: list[str], rewrite: bool, mark: str):
    """Step 4: the rows of a block with their repeated bytes counted, and cut out of the text."""

    def cut(key: tuple[pa.Scalar, ...], rows: pa.Table, found: pa.Table) -> pa.Table:
        data, offsets, ids, unnamed, copies = _texts(rows, mark, found)
        base = int(offsets[0])
        marks = np.zeros(int(offsets[-1]) - base + 1, np.int32)
        np.add.at(marks, offsets[:-1][copies] - base, 1)
        np.add.at(marks, offsets[1:][copies] - base, -1)
        found = found.filter(pc.is_null(found["copy"]))
        if found.num_rows:
            kinds = found["class"].to_numpy().view(np.uint64)
            order = np.argsort(kinds, kind="stable")
            kinds, least, mask = kinds[order], found["least"].to_numpy()[order], found["mask"].to_numpy()[order]
            listed = np.unique(found["gram"].to_numpy().view(np.uint64))
            for gram, around, low, high, first, row, kind in _listed(data, offsets, listed):
                near = np.minimum(np.searchsorted(kinds, kind), len(kinds) - 1)
                hit = np.flatnonzero((kinds[near] == kind) & ~unnamed[row])
                near = near[hit]
                counts = high[hit] - low[hit] + 1
                who = np.repeat(np.arange(len(hit)), counts)
                start = np.arange(counts.sum()) - np.repeat(np.append(0, np.cumsum(counts)[:-1]), counts)
                later = (ids[row[hit]] > least[near])[who]
                repeat = later | ((mask[near][who] >> (low[hit][who] + start)) & 1).astype(bool)
                begin = first[hit][who[repeat]] + start[repeat] - base
                np.add.at(marks, begin, 1)
                np.add.at(marks, begin + LENGTH, -1)
        gone = np.cumsum(marks[:-1]) > 0
        text = data[base : int(offsets[-1])]
        removed, spans, digests, kept = [], [], [], []
        for a, b in zip((offsets[:-1] - base).tolist(), (offsets[1:] - base).tolist()):
            lost = gone[a:b]
            count = int(np.count_nonzero(lost))
            left = text[a:b][~lost].tobytes() if count else text[a:b].tobytes()
            removed.append(count)
            spans.append(int(np.count_nonzero(lost[1:] & ~lost[:-1])) + int(lost[0]) if count else 0)
            digests.append(hashlib.sha256(left).hexdigest())
            if rewrite:
                kept.append(left.decode("utf-8", "ignore"))
        if rewrite:
            nulls = rows["text"].is_null().to_pylist()
            texts = pa.array([None if n else k for n, k in zip(nulls, kept)], pa.string())
            return pa.table({c: texts if c == "text" else rows[c] for c in columns})
        return pa.table(
            {"doc_id": rows["doc_id"]} | {"n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
        )

    return cut


def remove_repeats(docs: DataFrame, rewrite: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``.

    With ``rewrite`` the columns of ``docs`` come back instead, ``text`` being what is left
    (bytes of characters cut in half go too). Matches never cross
    documents; a string repeated only inside one document, or only in rows with the same
    doc_id, stays. Null text counts as empty and stays null; rows without a doc_id stay
    whole and make nothing else a repeat. An empty table gives an empty table.
    """
    columns = docs.columns if rewrite else ["doc_id"]
    block = free_name(docs, "block")
    source = ship(docs).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    if not rewrite:
        source = source.select("doc_id", "text")
    total = scalar(source.agg(F.coalesce(F.sum(utf8_length("text")), F.lit(0))))
    count = partitions_for(total, BLOCK_BYTES)
    mark = free_name(docs, "mark")
    marked = source.withColumn(mark, F.xxhash64("doc_id", F.xxhash64("text"))).withColumn(block, F.pmod(mark, F.lit(count)).cast("int"))
    blocks = marked.repartition(count, block)
    long = marked.filter(F.octet_length("text") >= LENGTH).filter("doc_id IS NOT NULL").select("doc_id", mark, block, F.sha2("text", 256).alias("same"))
    firsts = long.groupBy("same").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter("least < most").drop("most")
    copies = long.join(firsts, "same").filter("doc_id > least").select(block, F.col(mark).alias("copy"))
    copies = freeze(copies)

    def with_copies(rows: DataFrame) -> DataFrame:
        return rows.unionByName(copies, allowMissingColumns=True)

    report = blocks.groupBy(block).cogroup(copies.groupBy(block)).applyInArrow(_report(block, mark), f"gram long, `{block}` int, many boolean")
    repeated = report.repartition(partitions_for(total, REPORT_BYTES), "gram").mapInArrow(_repeated(block), f"`{block}` int, gram long")
    sent = (
        blocks.groupBy(block).cogroup(with_copies(repeated).groupBy(block))
        .applyInArrow(_send(block, mark), f"gram long, range smallint, beside binary, doc long, `{block}` int")
    )
    matched = sent.repartition(partitions_for(total, MATCH_BYTES), "gram").mapInArrow(_match(block), f"`{block}` int, gram long, class long, least long, mask long")
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns)
    if not rewrite:
        schema += ", n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return blocks.groupBy(block).cogroup(with_copies(matched).groupBy(block)).applyInArrow(_cut(columns, rewrite, mark), schema)
