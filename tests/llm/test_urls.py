import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from cellwise.llm import urls

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(day):
    return START + timedelta(days=day)


def tables(spark, captures, entries):
    pages = spark.createDataFrame([(i, u, None if d is None else at(d), "x") for i, u, d in captures], "page_id long, url string, fetched_at timestamp, pattern string")
    listed = spark.createDataFrame([(p, c, a, at(d)) for p, c, a, d in entries], "pattern string, category string, action string, effective_at timestamp")
    return pages, listed


def brute(captures, entries):
    """Replay the events up to the fetch time, removals after additions of one moment."""
    out = []
    for i, u, d in captures:
        host = urls_host(u)
        best = None
        if host is not None and d is not None:
            state = {}
            for p, c, a, day in sorted({e for e in entries if e[0] is not None}, key=lambda e: (e[3], e[2])):
                if day <= d:
                    state[p.lower(), c] = day if a == "add" else None
            for (p, c), day in state.items():
                if day is not None and (host == p or host.endswith("." + p)):
                    best = min(best or (0, "", "", 0), (-len(p), p, c, day)) if best else (-len(p), p, c, day)
        out.append((i, host, best is not None, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=str)


def urls_host(u):
    import re

    found = re.match(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (u or "").lower())
    return (found[1].rstrip(".") or None) if found else None


def got(df):
    rows = df.select("page_id", "host", "blocked", "pattern", "category", "valid_from").collect()
    return sorted(((r[0], r[1], r[2], r[3], r[4], None if r[5] is None else round((r[5].replace(tzinfo=timezone.utc) - START).total_seconds() / 86400)) for r in rows), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_replay(spark, seed):
    rng = random.Random(seed)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "co.b.org", "c.net"]
    captures = [(k, f"http://{rng.choice(hosts)}/p{k}", rng.randint(0, 400)) for k in range(150)]
    captures += [(7, "http://a.com/", 3), (7, "http://a.com/", 3), (200, None, 5), (201, "nothing", 5), (202, "HTTPS://User@X.A.com.:8080/?q", None), (203, "HTTPS://User@X.A.com.:8080/?q", 100), (None, "http://a.com", 9)]
    entries = [(rng.choice(hosts).upper(), rng.choice("pq"), rng.choice(["add", "add", "remove"]), rng.randint(0, 380)) for _ in range(60)]
    entries += [entries[0], (None, "p", "add", 1), ("com", "tld", "add", 50), ("com", "tld", "remove", 50), ("com", "tld", "add", 300), ("com", "tld", "remove", 310)]
    pages, listed = tables(spark, captures, entries)
    assert got(urls.listed(pages, listed)) == brute(captures, entries)


def test_empty_tables(spark):
    pages, listed = tables(spark, [(1, "http://a.com/", 3)], [("a.com", "p", "add", 1)])
    assert urls.listed(pages.limit(0), listed).count() == 0
    assert [r.blocked for r in urls.listed(pages, listed.limit(0)).collect()] == [False]
    assert [r.blocked for r in urls.listed(pages, listed).collect()] == [True]


def test_no_python_in_the_plan(spark):
    pages, listed = tables(spark, [(1, "http://a.com/", 3)], [("a.com", "p", "add", 1)])
    plan = urls.listed(pages, listed).select(F.col("*"))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_captures_are_read_once_beside_their_moments(spark, tmp_path):
    pages, entries = tables(spark, [(1, "http://a.b.org/", 5), (2, "http://c.org/", 6)], [("b.org", "x", "add", 1)])
    pages.write.parquet(str(tmp_path / "pages"))
    judged = urls.listed(spark.read.parquet(str(tmp_path / "pages")), entries)
    assert judged._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    assert [(r.page_id, r.blocked) for r in judged.orderBy("page_id").collect()] == [(1, True), (2, False)]
