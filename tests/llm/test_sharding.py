import zlib

import pytest

from heddle.llm.sharding import balanced_shards


def brute(rows, shards):
    key = lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()))
    ordered = sorted(rows, key=key)
    total = sum(len((t or "").encode()) + 1 for _, t in ordered)
    out, before, slots = [], 0, {}
    for doc_id, text in ordered:
        raw = (text or "").encode()
        size = len(raw) + 1
        shard = (2 * before + size) * shards // (2 * total)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((doc_id, size, zlib.crc32(raw), shard, slots[shard]))
        before += size
    return out


CASES = [
    [(i, "x" * (i * 7 % 50)) for i in range(200)],
    [(5, "é" * 9)] * 40 + [(None, "a"), (None, None), (1, ""), (2, "y" * 5000), (-3, "b"), (5, "é" * 9)],
    [(1, "one")],
    [],
]


@pytest.mark.parametrize("rows", CASES)
def test_same_as_one_pass(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as size", "2 as SHARD", "3 as part")
    got = [tuple(r) for r in balanced_shards(docs.repartition(5), 16).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 16), key=str)


def test_shards_are_even(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = {}
    for r in balanced_shards(docs, 16).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    largest = max(len(r.text.encode()) for r in docs.collect()) + 1
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 2 * largest
