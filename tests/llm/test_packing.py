from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from cellwise.llm import packing
from helpers import awkward_documents, frame


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.sort(rng.choice(60, 9, replace=False) + 1)
        counts = rng.integers(1, 50, 9)

        def padded(ends):
            return sum(int(c) * min(e for e in ends if e >= n) for n, c in zip(lengths, counts))

        for buckets in (1, 2, 3, 4):
            best = min(padded((*inner, lengths[-1])) for k in range(buckets) for inner in combinations(lengths[:-1], k))
            ends = packing.optimal_boundaries(lengths, counts, buckets)
            assert len(ends) <= buckets and padded(ends) == best


def test_fewer_lengths_than_buckets():
    assert packing.optimal_boundaries(np.array([3, 7]), np.array([2, 1]), 16) == [3, 7]
    assert packing.optimal_boundaries(np.array([], int), np.array([], int), 4) == []


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_documents(spark, unit):
    rows = awkward_documents()
    settings = packing.Settings(buckets=5, longest=500, budget=1000, unit=unit)
    found = packing.pack(frame(spark, rows), settings).collect()
    size = (lambda t: len((t or "").encode())) if unit == "bytes" else (lambda t: len((t or "").replace("\x00", "\x01").split()))
    want = Counter()
    for i, t in rows:
        want[i] += size(t) + 1
    got, batches, rooms = Counter(), defaultdict(list), {}
    for r in found:
        got[r.doc_id] += r.n_tokens
        assert 0 < r.n_tokens <= r.padded_tokens <= 500
        batches[r.bucket, r.batch].append(r.slot)
        rooms[r.bucket] = max(1, 1000 // r.padded_tokens)
    assert got == want
    assert len({r.bucket for r in found}) <= 5
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= rooms[bucket]
    last = {b: max(k for c, k in batches if c == b) for b in rooms}
    assert all(len(s) == rooms[b] for (b, k), s in batches.items() if k < last[b])
    ends = packing.optimal_boundaries(*(np.array(x) for x in zip(*sorted(Counter(r.n_tokens for r in found).items()))), 5)
    assert {r.padded_tokens for r in found} == set(ends)


def test_tokenizer_file(spark):
    path = Path("/opt/tokenizers/byte_bpe_50k.json")
    if not path.exists():
        pytest.skip("no tokenizer file")
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(str(path))
    known.encode_special_tokens = True
    rows = [r for r in awkward_documents() if r[0] not in (50, 52)] + [(60, "a <|endoftext|> b")]
    found = packing.pack(frame(spark, rows), packing.Settings(longest=200, unit="tokenizer", tokenizer=str(path))).collect()
    got = Counter()
    for r in found:
        got[r.doc_id] += r.n_tokens
    assert got == {i: len(known.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}


def test_empty_table(spark):
    assert packing.pack(frame(spark, []).limit(0)).count() == 0


def test_numbering_over_slices(spark, monkeypatch):
    from cellwise.llm import common

    monkeypatch.setattr(common, "ROWS_PER_SLICE", 10)
    rows = spark.range(95).selectExpr("id", "id % 2 as g")
    found = common.numbered(rows, "g", ["id"], "n", 95).collect()
    for g in (0, 1):
        own = sorted(r.n for r in found if r.g == g)
        assert own == list(range(len(own)))
