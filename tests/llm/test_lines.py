"""Line dedup against counting lines in Python, and back again after deletions."""

import random
from collections import Counter

import numpy as np
import pytest

from cellwise.llm import lines as L
from helpers import awkward_documents, frame, lower


def key(line):
    return lower(line.strip(" \t\n\x0b\x0c\r"))


def brute(inserted, rows, settings):
    held = Counter()
    for _, text in inserted:
        held.update({key(x) for x in (text or "").split("\n") if len(key(x)) >= settings.least_chars})
    out = []
    for i, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < settings.least_chars or held[key(x)] < settings.least_docs]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=order)


def order(row):
    return row[0] is None, row


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=order)


def some_rows():
    rng = random.Random(5)
    pool = [f"Line Ä {k} " + "x" * rng.randrange(5) for k in range(200)] + ["", "  ", "\t", "A", "a", " a\r", "Über", "\x00"]
    rows = [(i, "\n".join(rng.choice(pool[: rng.choice([20, 208])]) for _ in range(rng.randrange(12)))) for i in range(200)]
    return rows + [(None, "A\nA"), (7, "same\nrow"), (7, "same\nrow")] + [(i, t) for i, t in awkward_documents() if i != 50]


@pytest.mark.parametrize(
    "settings",
    [L.Settings(), L.Settings(least_docs=3, least_chars=2, flush=50), L.Settings(shard_keys=5), L.Settings(broadcast_bytes=1), L.Settings(spared_keys=-1)],
    ids=["as dealt", "two code points", "many shards", "filters too large", "too many mistakes"],
)
def test_against_brute_force(spark, tmp_path, settings):
    rows = some_rows()
    got = L.drop_frequent_lines(frame(spark, rows), str(tmp_path / "index"), settings)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "text"]
    assert rows_of(got) == brute(rows, rows, settings)


def test_insertions_and_deletions(spark, tmp_path):
    settings = L.Settings(shard_keys=5, merge_after=2)
    rows, root = some_rows(), str(tmp_path / "index")
    one, two = [r for r in rows if (r[0] or 0) % 3], [r for r in rows if not (r[0] or 0) % 3]
    index = L.LineIndex(spark, root, settings)
    index.insert(frame(spark, one))
    assert rows_of(index.clean(frame(spark, rows))) == brute(one, rows, settings)
    index.insert(frame(spark, two))
    assert rows_of(index.clean(frame(spark, rows))) == brute(rows, rows, settings)
    index.delete(frame(spark, one))
    again = L.LineIndex.open(spark, root, settings)
    assert len(again.tables) == 1  # merged
    assert rows_of(again.clean(frame(spark, rows))) == brute(two, rows, settings)
    before = rows_of(again.counts())
    with pytest.raises(ValueError):
        again.delete(frame(spark, one))
    assert rows_of(again.counts()) == before == rows_of(L.LineIndex.open(spark, root, settings).counts())


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert L.drop_frequent_lines(none, str(tmp_path / "a")).collect() == []
    index = L.LineIndex(spark, str(tmp_path / "b"))
    assert rows_of(index.clean(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))) == [(1, 2, 0, "a\nb")]


def test_mistaken_keys_are_spared(spark, tmp_path):
    """Filters that report everything change no result."""
    rows, settings = some_rows(), L.Settings()
    index = L.LineIndex(spark, str(tmp_path / "index"), settings)
    index.insert(frame(spark, rows))
    held = np.array([b for line in {x for _, t in rows for x in (t or "").split("\n")} for b in L.line_keys([line.encode()], 1)], object)
    high, low = L._halves([h for h in held if h])
    full = L.Cuckoo.build(high, low).to_bytes()
    spark.createDataFrame([(0, bytearray(full), True)], L._FILTERS).write.parquet(index.filters + "-full")
    index.filters += "-full"
    assert rows_of(index.clean(frame(spark, rows))) == brute(rows, rows, settings)


def test_cuckoo_filters():
    keys = np.random.default_rng(1).integers(0, 2**64, (40_000, 2), np.uint64)
    high, low = keys[:, 0], keys[:, 1]
    cuckoo = L.Cuckoo.build(high[:20_000], low[:20_000])
    seen = lambda: L.Filters.of([cuckoo.to_bytes()]).has(high, low)
    assert seen()[:20_000].all() and seen()[20_000:].sum() <= 3
    assert cuckoo.insert(high[20_000:24_000], low[20_000:24_000])
    cuckoo.remove(high[:10_000], low[:10_000])
    assert seen()[10_000:24_000].all() and seen()[:10_000].sum() <= 3
    with pytest.raises(KeyError):
        cuckoo.remove(high[39_000:], low[39_000:])
    assert not L.Cuckoo(16).insert(high[:100], low[:100])  # 64 slots
