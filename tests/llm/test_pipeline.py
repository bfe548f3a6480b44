import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from cellwise.llm import quality
from helpers import awkward_documents, sentence
from test_decontam import brute as contaminated
from test_neardup import shingles as word_shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(4)
    items = [(k, sentence(rng, 30)) for k in range(10)]
    rows = [r for r in awkward_documents() if r[0] != 50]
    rows += [(100 + k, f"{sentence(rng, 10)} {items[k % 10][1]}") for k in range(10)]
    rows += [(200 + k, " ".join(w.upper() + "!!" for w in sentence(rng, 30).split(" "))) for k in range(120)]
    rows += [(400 + k, sentence(rng, 40)) for k in range(240)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(4).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(not 200 <= i < 320), 0) for i, _ in rows if i >= 200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def four_fifths(rows):
    """As test_neardup.brute, with links from a similarity of 0.8 on."""
    sets = {i: word_shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if sets[a] & sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((label[a], label[b]))
            label = {i: x if c == y else c for i, c in label.items()}
    return sorted((i, len(sets[i]), label[i], label[i] == i) for i, _ in rows)


def test_each_stage_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and corpus_pipeline.ORACLE_SQL is None
    rows = docs.collect()

    def step(k, docs):
        out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
        out.write.parquet(f"{folder}/stage-{k}.parquet")
        return spark.read.parquet(f"{folder}/stage-{k}.parquet")

    first = step(0, docs)
    assert first.columns == columns
    kept = {r.doc_id for r in first.collect()}
    scored = quality.classify(docs.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    assert kept == {r.doc_id for r in rows} - {r.doc_id for r in scored.collect() if r.predicted == 0}
    assert len({i for i in kept if 200 <= i < 320}) <= 6 and len({i for i in kept if i >= 400}) >= 234

    second = step(1, first)
    assert second.columns == columns
    alone = {g[0] for g in four_fifths([(r.doc_id, r.text) for r in first.collect()]) if g[3]}
    assert {r.doc_id for r in second.collect()} == alone

    third = step(2, second)
    assert third.columns == columns
    texts = [(r.doc_id, r.text) for r in second.collect()]
    want, least = {}, {}
    for i, t in texts:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(least.get(b[k : k + 50], i), i)
    for i, t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if b else ""
        if left or not b:
            want[i] = None if t is None else left
    got = third.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.text is None or r.n_chars == len(r.text) for r in got)

    fourth = step(3, third)
    assert fourth.columns == columns
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    clean = {c[0] for c in contaminated([(r.doc_id, r.text) for r in got], items) if not c[5]}
    assert {r.doc_id for r in fourth.collect()} == clean and clean < set(want)

    last = step(4, fourth)
    tokens, sizes = {}, {}
    for r in last.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    for r in fourth.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + len((r.text or "").encode()) + 1
    assert tokens == sizes


def test_run(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.count() > 0 and {"doc_id", "bucket", "batch", "slot"} <= set(packed.columns)


def test_near_copies_from_four_fifths_on(spark, folder):
    """Pairs that share 80 of 100, 91 of 109 and 79 of 99 shingles: only the last stays a pair."""
    rows = []
    for k, (shingles, changed) in enumerate([(90, 10), (100, 9), (89, 10)]):
        words = [f"w{k}x{j}" for j in range(shingles + 4)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-changed] + [f"n{k}x{j}" for j in range(changed)]))]
    left = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert {r.doc_id for r in left.collect()} == {0, 2, 4, 5}


def test_rows_without_an_id_and_equal_rows(spark, folder, tmp_path):
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rng = random.Random(9)
    lone, other = sentence(rng, 40), sentence(rng, 40)
    rows = [(None, item), (None, item + " "), (7, item), (None, lone), (None, lone), (8, other), (8, other), (9, None), (9, None), (None, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    clean = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert sorted([tuple(r)[:2] for r in clean.collect()], key=str) == sorted([r for r in rows if not (r[1] or "").startswith(item)], key=str)
    left = corpus_pipeline.drop_near_duplicates(spark, clean, folder)
    assert sorted([tuple(r)[:2] for r in left.collect()], key=str) == sorted({r for r in rows if not (r[1] or "").startswith(item)}, key=str)
