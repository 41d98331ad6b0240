import math

import numpy as np
import pytest
from pyspark.errors import PythonException

from heddle.llm import negatives


def brute(rows, every=10, positives=5, most=5):
    whole = []
    for vec_id, label, v in rows:
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, (anchor, label, q) in enumerate(whole):
        if anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), vec_id, other) for j, (vec_id, other, v) in enumerate(whole) if j != i and len(v) == len(q)]
        for p, positive, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            inside = sorted(x[:2] for x in scored if x[2] != label and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(anchor, positive, rank + 1, vec_id, -p, -s) for rank, (s, vec_id) in enumerate(inside[:most])]
    return sorted(out)


def check(spark, rows, every=10, **more):
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 as V", "2 as row", "3 as score")
    found = negatives.hard_negatives(vectors.repartition(3), every, **more)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, every)


def clustered(n, length, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (6, length))
    return [(i, int(rng.integers(0, 4)), (centres[i % 6] + rng.normal(0, 0.1, length)).tolist()) for i in range(n)]


@pytest.mark.parametrize("row_block,anchor_block,codes", [(16384, 256, 16), (9, 4, 3)])
def test_against_brute_force(spark, monkeypatch, row_block, anchor_block, codes):
    for name, value in (("ROW_BLOCK", row_block), ("ANCHOR_BLOCK", anchor_block), ("CODES", codes)):
        monkeypatch.setattr(negatives, name, value)
    check(spark, clustered(300, 12, 1))


def test_ties_lengths_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, i % 3, rng.integers(-1, 2, 5).astype(float).tolist()) for i in range(90)]
    rows += [(100, None, [1.0] * 5), (110, 1, None), (120, 1, [1.0, None, 0.0, 0.0, 1.0]), (130, 1, [float("nan")] * 5), (140, 1, [float("inf")] * 5), (150, 1, [])]
    rows += [(None, 1, [1.0] * 5), (200, 1, [1.0]), (201, 1, [2.0]), (202, 2, [2.0]), (210, 1, [0.5] * 7)]
    rows += [(300, 1, [1.0] * 5)] * 3 + [(301, 2, [1.0] * 5)] * 4 + [(-10, 0, [-1.0] * 5), (310, 7, [1.0] * 5), (320, 1, [0.0] * 5)]
    check(spark, rows)


def test_large_numbers(spark):
    check(spark, [(i, i % 2, [1e6 + i, -3e6, 1e6 * (i % 4)]) for i in range(0, 60, 5)])
    with pytest.raises(PythonException, match="64 bits"):
        negatives.hard_negatives(spark.createDataFrame([(i, i % 2, [1e20, 1.0]) for i in range(4)], "vec_id long, label int, embedding array<float>")).collect()


def test_few_rows(spark):
    check(spark, [])
    check(spark, [(10, 1, [1.0, 2.0])])
    check(spark, [(10, 1, [1.0, 2.0]), (20, 1, [1.0, 1.9]), (30, 2, [1.0, 1.8])])


def test_the_walk_goes_down_and_misses_no_cell():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * rng.normal(0, 0.2, (500, 9)))
    books = negatives.Codebooks(vectors[:200])
    cells = np.sort(books.cells(vectors))
    vectors = vectors[np.argsort(books.cells(vectors), kind="stable")]
    plain = np.arange(500).tobytes()
    block = negatives.Block({"rows": plain, "ids": plain, "labels": plain, "cells": cells.astype(np.int64).tobytes(), "vectors": vectors.tobytes()}, books)
    query = vectors[7]
    seen = list(block.walk(query))
    assert sorted(i for _, at in seen for i in range(at.start, at.stop)) == list(range(500))
    assert all(a[0] >= b[0] for a, b in zip(seen, seen[1:]))
    assert all(bound >= (vectors[at] @ query).max() for bound, at in seen)
