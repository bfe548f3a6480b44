"""Phrase mining against counting everything in Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cellwise.llm import phrases as P
from helpers import lower


def brute(rows, settings):
    per = defaultdict(Counter)
    for text, lang in rows:
        found = per["und" if lang is None else lang]
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            found[()] += len(words)
            for n in range(1, settings.longest + 1):
                found.update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in per.items():
        candidates = [p for p in f if len(p) >= 2 and f[p] >= settings.support]
        kept = []
        for p in candidates:
            a = f[p]
            around = (q for q in candidates if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * f[q] >= settings.contained_percent * a for q in around):
                score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, name, left, right) in enumerate(sorted(kept)[: settings.top], 1):
            out.append((lang, rank, name.decode(), -a, left, right, f[()], -score))
    return sorted(out)


def some_rows():
    rng = random.Random(3)
    vocabulary = [a + b for a in "Aabcé" for b in "xyzß"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice(ends) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(300)]
    return rows + [(None, "en"), ("", "fr"), ("...", "fr"), ("one two three four " * 30, "it"), ("one two three four " * 30, "it"), ("w" * 5000 + " end", "it")]


@pytest.mark.parametrize(
    "settings",
    [P.Settings(), P.Settings(longest=4, support=5, chunk=64), P.Settings(sample=0.01, top=7, fan=3, filter_bits=16)],
    ids=["as dealt", "four words", "poor sample"],
)
def test_against_brute_force(spark, settings):
    rows = some_rows()
    docs = spark.createDataFrame([(t, c, "x", 1) for t, c in rows], "text string, lang string, phrase string, n int").repartition(5)
    assert sorted(tuple(r) for r in P.collocations(docs, settings).collect()) == brute(rows, settings)


def test_a_sample_of_nothing_changes_no_count(spark):
    docs = spark.createDataFrame(some_rows(), "text string, lang string")
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(P.frequent_phrases(docs, P.Settings(sample=0.0))) == key(P.frequent_phrases(docs, P.Settings(sample=1.0)))


def test_empty_tables_and_missing_language(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    got = P.collocations(spark.createDataFrame([("a b. " * 10,)], "text string")).collect()
    assert [tuple(r) for r in got] == [("und", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_scores_past_64_bits(spark):
    rows = [(3 * 10**12, 7 * 10**12, 5 * 10**12 + 1), (10**15, 10**15, 10**15)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(P._score("a", "l", "r").alias("s")).collect()
    assert [r.s for r in got] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_passes_count_each_phrase_once():
    data = np.frombuffer(b"a b c a b c a b d\nx y", np.uint8)
    seen = lambda filters: {(v.words, p): (int(c), bool(e)) for v in P.levels(data, "en", filters, 3) for p, c, e in zip(v.texts(np.arange(len(v.counts))).to_pylist(), v.counts, v.earlier)}
    every = seen([])
    assert every[1, "a"] == (3, False) and every[2, "a b"] == (3, False) and every[3, "a b c"] == (2, False) and (2, "d x") not in every
    nothing = P.Filter(np.zeros(1 << 10, np.uint64), 16)
    everything = P.Filter(np.full(1 << 10, 2**64 - 1, np.uint64), 16)
    first, later = seen([nothing]), seen([nothing, everything])
    assert set(first) == {k for k in every if k[0] == 1} and set(later) == set(every)
    assert all(earlier == (k in first) for k, (_, earlier) in later.items())


def test_hash_counts_of_ranges(spark):
    """Whatever the number of ranges, frequent hashes are those of the phrases counted in Python."""
    rows = spark.createDataFrame([(t or "", c or "und") for t, c in some_rows()], "text string, lang string").repartition(3)
    found = [sorted(r.hash for r in P._frequent_hashes(rows, None, P.Settings(chunk=500), 2, 10, ranges).collect()) for ranges in (1, 2, 16)]
    assert found[0] == found[1] == found[2] and len(found[0]) == len(set(found[0])) > 50


def test_packed_hashes_come_back_without_their_low_bits():
    for n in (0, 1, 5, 100_000):
        hashes = np.sort(np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False)) if n else np.zeros(0, np.uint64)
        cut = hashes >> np.uint64(16) << np.uint64(16)
        assert (P._unpacked(P._packed(cut)) == cut).all()
    whole = np.array([0, (1 << 64) - 1], np.uint64)
    assert P._unpacked(P._packed(whole)).tolist() == [0, (1 << 64) - (1 << 16)]
