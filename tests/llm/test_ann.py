from itertools import combinations

import numpy as np
import pytest

from cellwise.llm import ann


def vectors(spark, values, ids=None):
    ids = range(len(values)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v] if v is not None else None, "c") for i, v in zip(ids, values)], "vec_id long, embedding array<float>, code string").repartition(3)


def clustered(n, size, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 25 + 1, size))
    return (centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, size))).astype(np.float32)


def exact(values, ids, query, count):
    scores = values.astype(float) @ values[query].astype(float)
    order = [k for k in np.lexsort((ids, -scores)) if ids[k] != ids[query]][:count]
    return [int(ids[k]) for k in order]


@pytest.mark.parametrize("size", [16, 70])
def test_recall(spark, size):
    values = clustered(900, size)
    table = vectors(spark, values)
    settings = ann.Settings(shard_rows=200, query_rows=20, sample=500, probes=32)
    found = ann.neighbours(table, table.filter("vec_id % 20 = 0"), settings).collect()
    hits, got = 0, {}
    for r in found:
        got.setdefault(r.query_id, {})[r["rank"]] = r
    assert set(got) == set(range(0, 900, 20))
    for q, ranks in got.items():
        assert sorted(ranks) == list(range(1, 21))
        for r in ranks.values():
            assert abs(r.score - float(values[q].astype(float) @ values[r.vec_id].astype(float))) < 1e-9
        keys = [(-ranks[k].score, ranks[k].vec_id) for k in sorted(ranks)]
        assert keys == sorted(keys)
        hits += len({r.vec_id for r in ranks.values()} & set(exact(values, np.arange(900), q, 20)))
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("cover", [0.97, 0.0])
def test_equal_vectors_come_in_the_order_of_their_ids(spark, cover):
    """Fifty equal rows over several shards score equal, in the index and in the exact search."""
    values = clustered(600, 64)
    values[100:150] = values[40]
    ids = np.random.default_rng(3).permutation(600)
    table = vectors(spark, values, ids)
    asked = table.filter(f"vec_id = {ids[40]}")
    found = ann.neighbours(table, asked, ann.Settings(shard_rows=70, sample=300, probes=8, cover=cover)).orderBy("rank").collect()
    assert [r.vec_id for r in found] == sorted(int(i) for i in ids[100:150])[:20]
    assert len({r.score for r in found}) == 1


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**20, 3000).astype(np.uint64)
    for parts, radius in ((1, 3), (2, 5), (4, 6), (5, 4), (7, 9)):
        index = ann.ShardIndex(codes, 20, parts, radius)
        for code in codes[:20]:
            assert index.within(code).tolist() == np.flatnonzero(np.bitwise_count(codes ^ code) <= radius).tolist()


def test_splits():
    for bits in (1, 7, 64):
        for parts in range(1, bits + 1):
            pieces = ann.split_of(bits, parts)
            assert sum(w for _, w in pieces) == bits and all(a + w == b for (a, w), (b, _) in zip(pieces, pieces[1:]))
    assert len(ann.flips(8, 2)) == 1 + 8 + len(list(combinations(range(8), 2)))


def test_odd_vectors(spark):
    values = [[1, 0], [1, 0], [1, 0], None, [0, 0], [float("nan"), 1], [float("inf"), 1], [0, 1], [-1, 0], []]
    table = vectors(spark, values)
    odd = spark.createDataFrame([(50, [1.0, None], "c"), (51, [1.0, 2.0, 3.0], "c"), (None, [1.0, 1.0], "c")], table.schema)
    table = table.unionByName(odd)
    found = ann.neighbours(table, table.filter("vec_id in (0, 3, 4, 5, 6, 7, 51)")).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == {0: [(1, 1.0), (2, 1.0), (7, 0.0), (8, -1.0)], 7: [(0, 0.0), (1, 0.0), (2, 0.0), (8, 0.0)]}


def test_far_queries_still_get_their_neighbours(spark):
    values = np.vstack([clustered(300, 8), -50 * np.ones((1, 8))]).astype(np.float32)
    table = vectors(spark, values)
    found = ann.neighbours(table, table.filter("vec_id = 300 or vec_id = 0"), ann.Settings(cover=0.0)).groupBy("query_id").count().collect()
    assert {r[0]: r[1] for r in found} == {0: 20, 300: 20}


def test_empty_tables(spark):
    table = vectors(spark, clustered(5, 4))
    assert ann.neighbours(table.limit(0), table.limit(0)).count() == 0
    assert ann.neighbours(table, table.limit(0)).count() == 0
    assert ann.neighbours(table, table).count() == 20
