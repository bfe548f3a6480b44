import random
import zlib

import numpy as np
import pyarrow as pa

from cellwise.llm import quality
from cellwise.llm import text as X
from helpers import frame, sentence

SMALL = quality.Settings(rows=1024, size=16, chunks=4, epochs=40, fan=2)


def corpus(n=600):
    rng = random.Random(1)
    rows, labels = [], []
    for k in range(n):
        good = k % 3 > 0
        text = sentence(rng, rng.randint(10, 60))
        rows.append((k, text if good else " ".join(w.upper() + "!!" for w in text.split(" "))))
        labels.append((k, int(good), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_context_vectors_against_loops(spark):
    rows = [(1, "a b c a b"), (2, None), (3, ""), (4, "b a"), (5, "c")]
    s = quality.Settings(rows=64, size=8, chunks=4, fan=2)
    found = quality.word_vectors(frame(spark, rows, 4), s)
    contexts, counts = np.zeros((64, 8)), np.zeros(64)

    def hashed(text):
        data, offsets = X.utf8(pa.array([text], pa.string()))
        return X.hash_words(data, offsets, X.TOKENS)[0]

    def index(h):
        v = np.zeros(8)
        for k in range(s.nonzero):
            drawn = int(X.mix(np.array([h + np.uint64(k + 1)], np.uint64))[0])
            v[(drawn >> 1) % 8] += 1 if drawn & 1 else -1
        return v

    for _, text in rows:
        hs = hashed(text) if text else []
        for i, h in enumerate(hs):
            row = int(h) >> (64 - 6)
            counts[row] += 1
            for j in range(max(0, i - 2), min(len(hs), i + 3)):
                if i != j:
                    contexts[row] += index(hs[j])
    usual = contexts.sum(axis=0) / counts.sum()
    want = (contexts - counts[:, None] * usual) / (counts[:, None] + s.shrink)
    assert np.allclose(found, want, atol=1e-5)


def test_learns_and_scores_every_row(spark):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "x" * 2_000_000), (5, rows[5][1]), (None, "a null id")]
    labels += [(1, None, 0), (None, 1, 0), (99999, 1, 0), (7, 1, 0), (7, 1, 1)]
    found = quality.classify(frame(spark, rows), label_table(spark, labels), SMALL).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found)
    for r in found:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [r for r in found if r.held_out and r.doc_id < 600]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    by_text = {}
    for r in found:
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())


def test_only_unheld_labels_are_used(spark):
    rows, labels = corpus(200)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    score = lambda ls: sorted((r.doc_id, r.score) for r in quality.classify(frame(spark, rows), label_table(spark, ls), SMALL).collect())
    assert score(labels) == score(flipped)


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    z = rng.normal(0, 2, 20_000)
    labels = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(int)
    assert abs(quality.calibrated(3 * z, labels) - 3) < 0.15


def test_no_labels_and_empty_table(spark):
    rows, labels = corpus(20)
    found = quality.classify(frame(spark, rows), label_table(spark, []), SMALL).collect()
    assert {r.score for r in found} == {0.5}
    assert quality.classify(frame(spark, []).limit(0), label_table(spark, labels), SMALL).count() == 0
