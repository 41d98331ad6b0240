import math

import numpy as np
import pytest

from heddle.llm import topk


def brute(rows, k, every):
    whole = []
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for n, (q, qv) in enumerate(whole):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(qv, v)), i) for m, (i, v) in enumerate(whole) if m != n and len(v) == len(qv))
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def check(spark, rows, k=5, every=5):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as V", "2 as rank", "3 as score")
    assert sorted(tuple(r) for r in topk.top_k(vectors.repartition(3), k, every).collect()) == brute(rows, k, every)


@pytest.mark.parametrize("query_block,row_block", [(256, 4096), (3, 7)])
def test_random_vectors(spark, monkeypatch, query_block, row_block):
    monkeypatch.setattr(topk, "QUERY_BLOCK", query_block)
    monkeypatch.setattr(topk, "ROW_BLOCK", row_block)
    rng = np.random.default_rng(4)
    check(spark, [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(120)])


def test_ties_lengths_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-1, 2, 4).astype(float).tolist()) for i in range(60)]
    rows += [(100, None), (105, [1.0, None, 0.0, 0.0]), (110, [float("nan")] * 4), (115, [float("inf"), 0.0, 0.0, 0.0]), (120, [])]
    rows += [(None, [1.0] * 4), (200, [1.0]), (201, [2.0]), (205, [0.5] * 7), (210, [1.0] * 4), (210, [1.0] * 4), (210, [2.0] * 4), (-5, [-1.0] * 4)]
    rows += [(300, [1e6] * 4), (301, [-3e6, 1e6, 0.0, 7.0])]
    check(spark, rows)


def test_few_rows(spark):
    check(spark, [])
    check(spark, [(5, [1.0, 2.0])])
    check(spark, [(5, [1.0, 2.0]), (6, [0.0, -1.0]), (7, [1.0, 1.0])])


def test_rows_of_one_id_are_rows_of_their_own(spark):
    check(spark, [(1, [3.0, 0.0])] * 3 + [(1, [2.0, 2.0])] + [(50, [1.0, 1.0]), (50, [1.0, 1.0])] + [(5, [0.5, 0.5])] * 4)


def test_scores_beyond_62_bits_are_refused(spark):
    with pytest.raises(Exception, match="62 bits"):
        topk.top_k(spark.createDataFrame([(5, [1e20, 1.0]), (6, [1e20, 1.0])], "vec_id long, embedding array<float>"), 1, 5).collect()


def test_queries_are_moved_to_their_numbers(spark):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "vec_id long, v array<double>")
    met = topk.pairs(topk.blocks(rows, 8), topk.blocks(rows, 8), 3)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.select("row_block", "query_block", "slice").distinct().count() == met.count()
