import random
import zlib
from collections import defaultdict

import numpy as np

from cellwise.llm import sharding
from helpers import awkward_documents, frame


def plain_differencing(sizes, shards):
    """The definition, with sets of items in place of links."""
    parts = [([(s, [k])] + [(0, []) for _ in range(shards - 1)]) for k, s in enumerate(sizes)]
    order = list(range(len(parts)))
    live = {k: p for k, p in zip(order, parts)}
    count = len(parts)
    while len(live) > 1:
        spread = lambda k: live[k][0][0] - live[k][-1][0]
        a, b = sorted(live, key=lambda k: (-spread(k), k))[:2]
        x, y = live.pop(a), live.pop(b)
        live[count] = sorted(((p[0] + q[0], p[1] + q[1]) for p, q in zip(x, y[::-1])), key=lambda p: -p[0])
        count += 1
    return sorted(s for s, _ in next(iter(live.values())))


def test_differencing_balances_as_the_definition_does():
    rng = random.Random(4)
    for shards in (2, 3, 5):
        sizes = [rng.randint(1, 10**6) for _ in range(40)]
        dealt = sharding.differencing(sizes, shards)
        sums = sorted(np.bincount(dealt, sizes, shards).astype(int).tolist())
        assert sums == plain_differencing(sizes, shards)


def test_better_than_greedy():
    rng = random.Random(6)
    sizes = sorted((rng.randint(1, 10**9) for _ in range(300)), reverse=True)
    greedy = [0] * 8
    for s in sizes:
        greedy[greedy.index(min(greedy))] += s
    dealt = np.array(sharding.differencing(sizes, 8))
    assert sharding.spread(np.array(sizes), dealt, 8) < max(greedy) - min(greedy)


def test_edges():
    assert sharding.differencing([], 4) == []
    assert sharding.differencing([5], 4) == [0]
    assert sorted(sharding.differencing([1, 1, 1, 1], 4)) == [0, 1, 2, 3]


def test_documents(spark):
    rows = awkward_documents()
    found = sharding.balanced_shards(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    slots, groups, sums = defaultdict(list), defaultdict(set), defaultdict(int)
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(t)
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 16
        slots[r.shard].append(r.slot)
        text = texts[r.doc_id][0]
        assert r.size == len((text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((text or "").encode())
        groups[text].add(r.shard)
        sums[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(g) == 1 for g in groups.values())


def test_many_small_groups_are_near_equal(spark):
    rng = random.Random(8)
    rows = [(k, "x" * rng.randint(0, 400) + str(k)) for k in range(5000)] + [(k, "same") for k in range(5000, 6000)]
    found = sharding.balanced_shards(frame(spark, rows)).groupBy("shard").sum("size").collect()
    sums = [r[1] for r in found]
    assert len(sums) == 16 and max(sums) - min(sums) <= max(sums) * 0.001


def test_empty_table(spark):
    assert sharding.balanced_shards(frame(spark, []).limit(0)).count() == 0
