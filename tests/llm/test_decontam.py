import hashlib
import random
import re

import numpy as np
import pytest

from cellwise.llm import decontam
from helpers import awkward_documents, frame, lower, sentence

PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = re.findall(PATTERN, lower(t))
        for k in range(len(w) - 12):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
        if 0 < len(w) < 13:
            windows.setdefault(tuple(w), set()).add(i)
    out = []
    for i, t in rows:
        w = re.findall(PATTERN, lower(t))
        hit, found = [False] * len(w), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit[k : k + n] = [True] * n
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), sum(hit), len(found), digest, sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(9)
    items = [(k, sentence(rng, rng.randint(13, 40))) for k in range(20)]
    items += [(30, "short one here"), (31, "short one here"), (32, "x"), (33, None), (34, ""), (35, "..."), (36, items[0][1])]
    rows = awkward_documents()
    for k in range(60, 80):
        words = rng.choice(items[:20])[1].split(" ")
        cut = words[rng.randint(0, 5) : rng.randint(12, 40)]
        rows.append((k, f"{sentence(rng, rng.randint(0, 60))}, {' '.join(cut).upper()}! {sentence(rng, 20)}"))
    rows += [(80, "Short, ONE\there x"), (81, "short one"), (82, items[3][1])]
    return rows, items


def bench(spark, items):
    return spark.createDataFrame([(i, t, "n") for i, t in items], "item_id long, text string, doc_id string")


def got(df):
    return sorted((tuple(r) for r in decontam.digest(df).collect()), key=str)


@pytest.mark.parametrize("part_words", [decontam.PART_WORDS, 60])
def test_against_brute_force(spark, case, part_words):
    rows, items = case
    assert got(decontam.contamination(frame(spark, rows), bench(spark, items), part_words)) == brute(rows, items)


def test_empty_tables(spark, case):
    rows, items = case
    assert decontam.contamination(frame(spark, []).limit(0), bench(spark, items)).count() == 0
    assert got(decontam.contamination(frame(spark, rows[:5]), bench(spark, []))) == brute(rows[:5], [])


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    grams = rng.integers(0, 50, 500).astype(np.uint64)
    at = decontam.winnow(grams, 9)
    for k in range(len(grams) - 8):
        chosen = at[(at >= k) & (at < k + 9)]
        assert len(chosen) and grams[chosen].min() == grams[k : k + 9].min()


@pytest.mark.parametrize("part_words", [decontam.PART_WORDS, 10])
def test_items_without_id_and_with_names(spark, part_words):
    rng = random.Random(5)
    texts = [sentence(rng, 20) for _ in range(4)]
    items = [(None, texts[0]), ("task/1", texts[1]), (None, "short words"), ("7", texts[2])]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, f"{texts[0]} {texts[1]}"), (5, "a few short words")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontam.contamination(frame(spark, rows), bench, part_words).collect()}
    assert found == {0: (20, [], True), 1: (20, ["task/1"], True), 2: (20, ["7"], True), 3: (0, [], False), 4: (40, ["task/1"], True), 5: (2, [], True)}


def test_repeated_words_take_time_in_proportion(spark):
    """Every word of document and item is the same: all positions match all positions."""
    import time

    items = spark.createDataFrame([(1, "same " * 10_000), (2, "same " * 13), (3, "same"), (4, "other " * 20)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 100_000), (2, "same " * 12 + "x"), (3, "x")], "doc_id long, text string")
    begun = time.monotonic()
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(docs, items).collect()}
    assert time.monotonic() - begun < 60
    assert found == {1: (100_000, 100_000, ["1", "2", "3"]), 2: (13, 12, ["3"]), 3: (1, 0, [])}
