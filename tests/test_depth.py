import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from heddle import session
from heddle.operators import depth as dp
from heddle.operators import graph as g


def reach(edges, nodes):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for m in out[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        found[n] = seen
    return found


def brute(edges, n):
    """Depth by the definition: edges inside a strongly connected component leave, the rest is a plain longest path."""
    nodes = range(n)
    r = reach(edges, nodes)
    into = defaultdict(set)
    for a, b in edges:
        if a != b and not (a in r[b] and b in r[a]):
            into[b].add(a)
    known = {}

    def of(v):
        if v not in known:
            known[v] = max((of(u) + 1 for u in into[v]), default=0)
        return known[v]

    return {v: of(v) for v in nodes}


def tables(spark, graphs):
    nodes = [(i, f"n{v:05d}") for i, (_, n) in enumerate(graphs) for v in range(n)]
    edges = [(i, f"n{a:05d}", f"n{b:05d}") for i, (edges, _) in enumerate(graphs) for a, b in edges]
    return spark.createDataFrame(nodes, "g int, node string"), spark.createDataFrame(edges, "g int, source string, target string")


def check(spark, graphs):
    nodes, edges = tables(spark, graphs)
    got = {(r.g, r.node): r.depth for r in dp.longest_path(nodes, edges, "g").collect()}
    assert got == {(i, f"n{v:05d}"): d for i, (e, n) in enumerate(graphs) for v, d in brute(e, n).items()}


def shape(rng, n):
    kind = rng.randrange(5)
    if kind == 0:  # anything
        return [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(2 * n))], n
    if kind == 1:  # a long tail behind a ring, with a way out
        ring = rng.randrange(2, n // 2)
        return [(i, (i + 1) % ring) for i in range(ring)] + [(i, i + 1) for i in range(ring, n - 1)] + [(rng.randrange(ring), ring)], n
    if kind == 2:  # a chain with shortcuts and parents of its own
        return [(i, i + 1) for i in range(n // 2 - 1)] + [(i + n // 2, i) for i in range(n // 2) if rng.random() < 0.6] + [(0, n // 2 - 1)], n
    if kind == 3:  # rings in a row
        size = 3
        row = [(i, i + 1 if (i + 1) % size else i + 1 - size) for i in range(n - n % size)]
        return row + [(i, i + size) for i in range(0, n - n % size - size, size)], n
    return [(rng.randrange(max(1, v)), v) for v in range(1, n)], n  # a tree


def test_depth_of_random_graphs(spark, monkeypatch):
    monkeypatch.setattr(dp, "LEVELS", 2)
    rng = random.Random(11)
    check(spark, [shape(rng, rng.randrange(6, 26)) for _ in range(60)])


def test_depth_of_nothing_and_of_lone_nodes(spark):
    check(spark, [([], 3), ([(0, 0), (1, 1)], 2)])
    nodes, edges = tables(spark, [([(0, 9), (1, 0)], 2)])
    assert sorted((r.node, r.depth) for r in dp.longest_path(nodes, edges, "g").collect()) == [("n00000", 1), ("n00001", 0)]
    assert dp.longest_path(nodes.limit(0), edges.limit(0), "g").collect() == []


def test_a_chain_of_ten_thousand_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    nodes = spark.range(n).select(F.lit(1).alias("g"), F.col("id").alias("node"))
    edges = spark.range(n - 1).select(F.lit(1).alias("g"), F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    rounds = []
    peel, heads = dp._peel, dp._heads
    monkeypatch.setattr(dp, "_peel", lambda *a: (out := peel(*a), rounds.append(len(out[1])))[0])
    monkeypatch.setattr(dp, "_heads", lambda *a: (out := heads(*a), rounds.append(len(out[1]) // 2))[0])
    got = dp.longest_path(nodes, edges, "g")
    assert got.filter("depth <> node").count() == 0 and got.count() == n
    assert sum(rounds) < 20


def test_strong_components(spark):
    rng = random.Random(5)
    graphs = [shape(rng, rng.randrange(6, 24)) for _ in range(40)]
    _, edges = tables(spark, graphs)
    got = {(r.g, r.node): r.scc for r in dp.strong_components(edges.withColumnRenamed("source", "src").withColumnRenamed("target", "node"), "g").collect()}
    for i, (e, n) in enumerate(graphs):
        r = reach([x for x in e if x[0] != x[1]], range(n))
        for v in range(n):
            alike = [u for u in range(n) if u == v or (u in r[v] and v in r[u])]
            if len(alike) > 1:
                assert got[i, f"n{v:05d}"] == f"n{max(alike):05d}"
            else:
                assert got.get((i, f"n{v:05d}")) in (None, f"n{v:05d}")


def test_components_of_random_graphs_chains_and_a_hub(spark):
    rng = random.Random(3)
    graphs = [([(rng.randrange(30), rng.randrange(30)) for _ in range(rng.randrange(40))], 30) for _ in range(20)] + [([(i, i + 1) for i in range(400)], 401), ([], 4)]
    nodes, edges = tables(spark, graphs)
    got = {(r.g, r.node): r.component for r in g.components(nodes, edges, "g").collect()}
    for i, (e, n) in enumerate(graphs):
        r = reach(e + [(b, a) for a, b in e], range(n))
        for v in range(n):
            assert got[i, f"n{v:05d}"] == f"n{min(r[v] | {v}):05d}"


def test_components_of_a_hub_with_a_million_edges(spark):
    n = 1_000_000
    edges = spark.range(1, n + 1).select(F.lit(1).alias("g"), F.lit(n + 5).alias("source"), F.col("id").alias("target"))
    nodes = edges.select("g", F.col("target").alias("node"))
    assert [tuple(r) for r in g.components(nodes, edges, "g").groupBy("component").count().collect()] == [(1, n)]


def test_the_static_side_of_a_loop_is_not_moved_again(spark):
    static = session.Dealt(spark.range(1000).select((F.col("id") % 50).alias("k"), "id"), "k")
    with_size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = static.join(spark.range(50).select(F.col("id").alias("k")))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_size)
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in joined._jdf.queryExecution().toString()


def spread_of(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


@pytest.mark.parametrize("loop", [True, False])
def test_hot_keys_are_spread(spark, loop):
    big = spark.range(40_000).select(F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    small = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    setting = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in setting}
    for k, v in setting.items():
        spark.conf.set(k, v)
    try:
        joined = session.Dealt(big, "k", least=100).join(small) if loop else session.join_hot(big, small, ["k"], least=100)
        found = joined.select("k", "v", "w")
        assert found.count() == 40_000 and found.filter("w <> 2 * k").count() == 0
        sizes = spread_of(joined)
        assert max(sizes) <= 2 * 40_000 / 16
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
