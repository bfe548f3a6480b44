import hashlib
import heapq
import random

import pytest

from cellwise.llm import warc

SCHEMA = "page_id long, url string, html string, fetched_at timestamp, key string, run string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, "k", "r") for i, u, h in rows], SCHEMA).repartition(3).withColumn("fetched_at", __import__("pyspark.sql.functions", fromlist=["x"]).expr("timestamp_seconds(1704067200 + page_id % 3)"))


def rows_of(n=60):
    rng = random.Random(1)
    big = ["<p>" + "é" * 60 + str(k) + "</p>" * 10 for k in range(4)]
    rows = [(k, f"HTTP://www.Example{k % 3}.org:80/a/{k % 5}?q={k}#f", rng.choice(big)) for k in range(n)]
    rows += [(100, "http://a.b/", None), (101, None, ""), (102, "no scheme", "x" * 99), (103, "http://h", "x" * 99), (104, "http://h/ü\r\nX: y", "x" * 100), (105, "http://h", "x" * 100)]
    rows += [(None, "http://n/", big[0]), (None, None, None), (106, "http://h", "r" * 200), (106, "http://h", "r" * 200)]
    return rows


def test_round_trip(spark):
    rows = rows_of()
    found = warc.round_trip(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    first = {}
    for i, _, h in rows:
        payload = (h or "").encode()
        if len(payload) >= 100 and i is not None:
            first[payload] = min(first.get(payload, i), i)
    want = []
    for i, _, h in rows:
        payload = (h or "").encode()
        ref = first.get(payload)
        ref = None if ref == i else ref
        want.append((i, len(payload), hashlib.sha256(payload).hexdigest(), "response" if ref is None else "revisit", ref))
    assert sorted((tuple(r)[:5] for r in found), key=str) == sorted(want, key=str)
    assert sorted(r.position for r in found) == list(range(len(rows)))
    ordered = sorted(found, key=lambda r: r.position)
    assert [r.url_key for r in ordered] == sorted(r.url_key for r in ordered)


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    found = warc.round_trip(pages(spark, rows_of()[:66])).orderBy("position").collect()
    assert [r.position for r in found] == list(range(66))
    assert [r.url_key for r in found] == sorted(r.url_key for r in found)


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
    merged = list(warc.LoserTree(runs)) if runs else []
    assert [m[0] for m in merged] == list(heapq.merge(*runs))
    assert [m[1] for m in merged if m[0] == 5] == sorted(m[1] for m in merged if m[0] == 5)


def test_damage_is_found():
    raw = warc.record(1, "http://a/", "20240101000000", hashlib.sha256(b"abc").hexdigest(), b"abc", None)
    assert warc.parse(raw) == (1, "response", 3, hashlib.sha256(b"abc").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
