"""The registered corpus queries without SQL, on a small folder against brute force.

Those with SQL run in test_oracle.py.
"""

import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
from cellwise.llm import queries as corpus
from helpers import awkward_documents, frame
from test_ann import clustered, exact, vectors
from test_suffixes import brute as repeats


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in awkward_documents() if r[0] != 50]
    frame(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors(spark, clustered(400, 12)).write.parquet(f"{path}/embeddings.parquet")
    return path, rows


def run(spark, folder, number):
    name = next(n for n in corpus.QUERIES if n.startswith(f"op{number}_"))
    return entry.queries()[name](spark, folder)


def test_one_query_for_each_operator():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "pipeline" in names
    assert set(corpus.SQL) <= set(corpus.QUERIES)


def test_packing(spark, folder):
    path, rows = folder
    packed = run(spark, path, 1).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((t or "").encode()) + 1 for _, t in rows)
    assert len({(r.bucket, r.batch, r.slot) for r in packed}) == len(packed)


def test_sharding(spark, folder):
    path, rows = folder
    found = run(spark, path, 2)
    assert dict(found.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = sorted((r.doc_id, r["size"], r.text_crc32) for r in found.collect())
    assert got == sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)


def test_quality(spark, folder):
    path, rows = folder
    found = run(spark, path, 4)
    assert dict(found.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = found.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)


def test_neighbours(spark, folder):
    path, _ = folder
    values, ids = clustered(400, 12), np.arange(400)
    found = run(spark, path, 5)
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 400, 20)) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(exact(values, ids, q, 20))) for q in got) >= 0.9 * 20 * len(got)


def test_repeats(spark, folder):
    path, rows = folder
    found = run(spark, path, 7)
    assert dict(found.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    assert sorted((tuple(r) for r in found.collect()), key=str) == repeats(rows)
