"""File digests: whole values for small files, blocks for large ones, the same result."""

import hashlib

from cellwise.sources import loads


def test_large_files_are_hashed_in_blocks(spark, tmp_path):
    contents = {"empty.csv": b"", "small.csv": b"a,b\n1,2\n", "border.csv": b"x" * 1000, "large one.csv": bytes(range(256)) * 20_001, "other.txt": b"no"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    expected = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items() if name.endswith(".csv") and data}
    for whole in (0, 1000, 1 << 30):
        found = loads.file_manifest(spark, str(tmp_path), "s", "*.csv", whole_bytes=whole, block=4096)
        assert {(r.file_name, r.file_size, r.sha256) for r in found.collect()} == expected


def test_a_large_file_is_listed_without_its_content(spark, tmp_path):
    with open(tmp_path / "sparse.bin", "wb") as sparse:
        sparse.truncate((2 << 30) + 4097)  # more than one value of a row can hold
    digest, zeros = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        digest.update(zeros)
    digest.update(bytes(4097))
    row = loads.file_manifest(spark, str(tmp_path), "s").first()
    assert (row.file_size, row.sha256) == ((2 << 30) + 4097, digest.hexdigest())
