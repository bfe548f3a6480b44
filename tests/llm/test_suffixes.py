import hashlib
import random

import numpy as np
import pytest

from cellwise.llm import suffixes
from helpers import awkward_documents, frame


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in texts:
        if i is not None:
            for k in range(len(b) - length + 1):
                s = b[k : k + length]
                least[s] = min(least.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if i is not None and least[b[k : k + length]] < i:
                gone[k : k + length] = True
        left = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        spans = int(np.count_nonzero(np.diff(np.append(0, gone.astype(int))) == 1))
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_against_brute_force(spark):
    rows = [r for r in awkward_documents() if r[0] != 50]
    assert got(suffixes.remove_repeats(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_random_edits(spark, seed, monkeypatch):
    """Few letters, so that strings repeat by chance and inside documents, over many blocks."""
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(suffixes, "REPORT_BYTES", 5000)
    monkeypatch.setattr(suffixes, "MATCH_BYTES", 5000)
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    rows = []
    for k in range(60):
        text = "".join(rng.choice(pool)[rng.randint(0, 20) :] for _ in range(rng.randint(0, 6)))
        rows.append((rng.randint(0, 50), text))
    assert got(suffixes.remove_repeats(frame(spark, rows))) == brute(rows)


def test_long_rows_in_pieces(monkeypatch):
    """Anchors of a row cut in pieces cover its windows once, as those of the whole row do."""
    rng = np.random.default_rng(1)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    offsets = np.array([0, 5000])

    def windows():
        found = {}
        for at, gram, first, last, row in suffixes._found(data, offsets):
            for a, g, f, t in zip(at, gram, first, last):
                for w in range(f, t + 1):
                    assert w not in found
                    found[w] = (a, g)
        return found

    whole = windows()
    monkeypatch.setattr(suffixes, "RUN_BYTES", 300)
    monkeypatch.setattr(suffixes.X, "SLICE_BYTES", 300)
    assert windows() == whole and len(whole) == 5000 - suffixes.LENGTH + 1


def test_longest_previous_factors():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    docs = np.array([rng.randint(0, 40) for _ in texts])
    groups = np.array([rng.randint(0, 2) for _ in texts])
    matrix = np.zeros((len(texts), 12), np.uint8)
    for k, t in enumerate(texts):
        matrix[k, : len(t)] = np.frombuffer(t.encode(), np.uint8)

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    want = [max((common(texts[i], texts[j]) for j in range(len(texts)) if groups[i] == groups[j] and docs[j] < docs[i]), default=0) for i in range(len(texts))]
    got = suffixes.longest_previous(matrix, np.array([len(t) for t in texts]), groups, docs)
    assert got.tolist() == want


def test_rewriting_keeps_columns(spark):
    line = "a line of more than fifty bytes that two documents hold, é included"
    rows = frame(spark, [(1, line), (2, f"before {line} after"), (3, None), (None, line), (4, "")])
    found = {r.doc_id: r for r in suffixes.remove_repeats(rows, rewrite=True).collect()}
    assert suffixes.remove_repeats(rows, rewrite=True).columns == rows.columns
    assert found[1].text == line and found[2].text == "before  after" and found[3].text is None and found[None].text == line and found[4].text == ""
    assert found[2].block == "b"


def test_empty_table(spark):
    assert suffixes.remove_repeats(frame(spark, []).limit(0)).count() == 0
