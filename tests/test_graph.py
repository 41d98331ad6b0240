"""Graph walks against brute force on small random graphs, cycles included."""

import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from heddle.operators import graph as g
from heddle.operators import model as md
from heddle.session import running_last, running_position


def tables(spark, edges, n, kinds=None):
    entity = spark.createDataFrame(
        [Row(model_id="m", entity_id=f"n{i}", kind="attribute", name=f"n{i}", parent_id=None if i < 3 else f"n{i % 3}", layer_name=f"L{i % 4}", object_id=f"o{i}",
             has_children=False, path=f"n{i}") for i in range(n)],
        "model_id string, entity_id string, kind string, name string, parent_id string, layer_name string, object_id string, has_children boolean, path string",
    )
    transition = spark.createDataFrame(
        [("m", f"t{k:03}", f"n{a}", f"n{b}", k) for k, (a, b) in enumerate(edges)], "model_id string, transition_id string, source string, target string, ordinal bigint"
    )
    return entity, transition


def random_edges(seed, n, m):
    rnd = random.Random(seed)
    return [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]


def depth_first(edges, start, goal, max_paths, max_depth):
    adjacent = {}
    for k, (a, b) in enumerate(edges):
        adjacent.setdefault(a, []).append((k, b))
    found, cut_short = [], []

    def walk(node, hops, seen):
        if len(found) >= max_paths:
            cut_short.append(1)
            return
        if hops and goal(node, adjacent):
            found.append(tuple(f"t{k:03}" for k in hops))
            return
        if len(hops) >= max_depth:
            cut_short.append(1)
            return
        for k, b in adjacent.get(node, []):
            if b not in seen:
                walk(b, [*hops, k], seen | {b})

    walk(start, [], {start})
    return found, bool(cut_short)


@pytest.mark.parametrize("seed,n,m,paths,depth,layer", [(1, 9, 14, 3, 5, None), (2, 8, 20, 12, 16, None), (3, 10, 24, 2, 4, "L2"), (4, 7, 12, 5, 3, "L1"), (5, 12, 13, 1, 6, None), (6, 8, 16, 3, None, None)])
def test_trace_paths(spark, seed, n, m, paths, depth, layer):
    edges = random_edges(seed, n, m)
    entity, transition = tables(spark, edges, n)
    starts = spark.createDataFrame([("m", f"n{i}") for i in range(n)], "model_id string, start string")
    kept, status = g.trace_paths(starts, entity, transition, to_layer=layer, max_paths=paths, max_depth=depth)
    got = {}
    for r in kept.collect():
        got.setdefault(r["start"], []).append((r["path_no"], tuple(r["hops"])))
    flags = {r["start"]: (r["n_paths"], r["truncated"]) for r in status.collect()}
    for i in range(n):
        goal = (lambda x, adj: not adj.get(x)) if layer is None else (lambda x, adj: f"L{x % 4}" == layer)
        want, truncated = depth_first(edges, i, goal, paths, depth or 10**9)
        assert [h for _, h in sorted(got.get(f"n{i}", []))] == want, (i, want)
        assert flags[f"n{i}"] == (len(want), truncated), (i, want, truncated)


@pytest.mark.parametrize("seed,n,m,depth,layer", [(1, 9, 14, None, None), (2, 7, 14, None, "L2"), (3, 8, 16, 3, None)])
def test_all_paths_and_their_edges(spark, seed, n, m, depth, layer):
    edges = random_edges(seed, n, m)
    entity, transition = tables(spark, edges, n)
    starts = spark.createDataFrame([("m", f"n{i}") for i in range(n)], "model_id string, start string")
    kept, status = g.trace_paths(starts, entity, transition, to_layer=layer, max_depth=depth)
    got = {}
    for r in kept.collect():
        got.setdefault(r["start"], []).append((r["path_no"], tuple(r["hops"])))
    counted = {r["start"]: r["n_paths"] for r in status.collect()}
    along = {}
    for r in g.trace_edges(starts, entity, transition, to_layer=layer).collect():
        along.setdefault(r["start"], set()).add(r["transition_id"])
    for i in range(n):
        goal = (lambda x, adj: not adj.get(x)) if layer is None else (lambda x, adj: f"L{x % 4}" == layer)
        want, _ = depth_first(edges, i, goal, 10**9, depth or 10**9)
        assert [h for _, h in sorted(got.get(f"n{i}", []))] == want
        assert counted[f"n{i}"] == len(want)
        assert {h for path in want for h in path} <= along.get(f"n{i}", set())


def test_edges_of_exponentially_many_paths(spark):
    # Twelve layers of three nodes, the last closed by a cycle, then one sink: 3^12 paths, 3 + 11 * 9 + 3 + 3 edges.
    edges = [(0, 1 + k) for k in range(3)]
    edges += [(1 + 3 * i + a, 4 + 3 * i + b) for i in range(11) for a in range(3) for b in range(3)]
    edges += [(34, 35), (35, 36), (36, 34)] + [(34 + a, 37) for a in range(3)]
    entity, transition = tables(spark, edges, 38)
    starts = spark.createDataFrame([("m", "n0")], "model_id string, start string")
    assert g.trace_edges(starts, entity, transition).count() == len(edges)


@pytest.mark.parametrize("direction", ["downstream", "upstream"])
def test_reach_and_components(spark, direction):
    n, edges = 15, random_edges(7, 15, 16)
    entity, transition = tables(spark, edges, n)
    starts = entity.select("model_id", F.col("entity_id").alias("start"))
    got = {(r["start"], r["entity_id"]) for r in g.impact_reach(starts, entity, transition, direction).collect()}
    step = {}
    for a, b in edges:
        a, b = (a, b) if direction == "downstream" else (b, a)
        step.setdefault(a, set()).add(b)
    want = set()
    for i in range(n):
        seen, stack = {i}, [i]
        while stack:
            for b in step.get(stack.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    stack.append(b)
        want |= {(f"n{i}", f"n{j}") for j in seen - {i}}
    assert got == want
    label = {r["node"]: r["component"] for r in g.components(entity.select("model_id", F.col("entity_id").alias("node")), transition).collect()}
    for a, b in edges:
        assert label[f"n{a}"] == label[f"n{b}"]
    assert all(label[v] == v for v in set(label.values()))


def test_longest_path(spark):
    rnd = random.Random(3)
    edges = [tuple(sorted(rnd.sample(range(14), 2))) for _ in range(25)]
    entity, transition = tables(spark, edges, 14)
    got = {r["node"]: r["depth"] for r in g.longest_path(entity.select("model_id", F.col("entity_id").alias("node")), transition).collect()}
    want = {i: 0 for i in range(14)}
    for i in range(14):
        want[i] = max([want[a] + 1 for a, b in edges if b == i], default=0)
    assert got == {f"n{i}": d for i, d in want.items()}


def test_longest_path_counts_no_edge_inside_a_cycle(spark):
    # 0 -> 1 -> 2 -> 3 -> 2 (cycle 2,3), 3 -> 4 -> 5, and 6 <-> 7 with nothing above.
    edges = [(0, 1), (1, 2), (2, 3), (3, 2), (3, 4), (4, 5), (6, 7), (7, 6)]
    entity, transition = tables(spark, edges, 8)
    got = {r["node"]: r["depth"] for r in g.longest_path(entity.select("model_id", F.col("entity_id").alias("node")), transition).collect()}
    assert got == {"n0": 0, "n1": 1, "n2": 2, "n3": 0, "n4": 1, "n5": 2, "n6": 0, "n7": 0}


def test_gaps_and_touched_make_the_whole(spark):
    entity, transition = tables(spark, random_edges(11, 20, 12), 20)
    gaps = md.gaps(entity, transition).count()
    rows = g.live_edges(transition, entity)
    touched = rows.select("source").union(rows.select("target")).distinct().count()
    assert gaps + touched == 20


def test_unknown_direction_is_refused(spark):
    entity, transition = tables(spark, [(0, 1)], 3)
    with pytest.raises(ValueError):
        g.oriented(transition, "sideways")


def test_positions_and_last_values_in_a_hot_group(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"), F.col("id").alias("o"),
        F.when(F.col("id") % 11 == 0, F.col("id")).alias("v"),
    ).repartition(7)
    got = sorted((r["k"], r["o"], r["p"]) for r in running_position(rows, ["k"], [F.col("o")], "p").collect())
    last = {(r["k"], r["o"]): r["l"] for r in running_last(rows, ["k"], ["o"], "v", "l").collect()}
    count, carry = {}, {}
    for k, o, p in got:
        count[k] = count.get(k, 0) + 1
        assert p == count[k]
        assert last[(k, o)] == carry.get(k)
        if o % 11 == 0:
            carry[k] = o


def test_details_hold_properties_and_ordered_transforms(spark):
    entity, transition = tables(spark, [(0, 5), (1, 5), (2, 5), (3, 5), (5, 6)], 7)
    rows = [("m", "n5", "Tags", "x"), ("m", "n5", "Note", ""), ("m", "t000", "Transform", "z"), ("m", "t001", "Transform", "b"), ("m", "t002", "Transform", "z"), ("m", "t003", "Transform", ""), ("m", "t004", "Access", "Read")]
    prop = spark.createDataFrame(rows, "model_id string, entity_id string, key string, value string")
    got = {tuple(r) for r in md.describe_details(entity, transition, prop).collect()}
    assert got == {
        ("m", "n5", "property", None, "Tags", "x"), ("m", "n5", "property", None, "Note", ""),
        ("m", "n5", "transform", 1, "Transform", "z"), ("m", "n5", "transform", 2, "Transform", "b"),
    }


def test_description_is_whole(spark):
    entity, transition = tables(spark, [(0, 5), (1, 5), (5, 6), (5, 99)], 7)
    entity = entity.withColumn("ordinal", F.lit(4).cast("long"))
    rows = [("m", "n5", "Tags", "x"), ("m", "t000", "Transform", "z"), ("m", "t001", "Transform", "b"), ("m", "gone", "Tags", "x")]
    prop = spark.createDataFrame(rows, "model_id string, entity_id string, key string, value string")
    found = md.describe(entity, transition, prop).collect()
    counts = {r.entity_id: (r.path, r.upstream, r.downstream, r.children, r.properties) for r in found if r.part == "entity"}
    assert len(counts) == 7 and counts["n5"] == ("n5", 2, 1, 0, 1) and counts["n0"] == ("n0", 0, 1, 2, 0)
    assert {(r.entity_id, r.part, r.position, r.key, r.value) for r in found if r.part != "entity"} == {
        ("n5", "property", None, "Tags", "x"), ("n5", "transform", 1, "Transform", "z"), ("n5", "transform", 2, "Transform", "b"),
        *[(f"n{i % 3}", "child", 4, f"n{i}", f"n{i}") for i in range(3, 7)],
    }


def test_coverage_has_what_is_untraced_and_the_edges(spark):
    layers = [("m", "L", "layer", "L", "Raw", True), ("m", "K", "layer", "K", "Gold", False), ("bare", "B", "layer", "B", "Raw", False)]
    rows = [("m", "o", "object", "L", "Raw", True), ("m", "a", "attribute", "L", "Raw", False), ("m", "b", "attribute", "L", "Raw", False), ("m", "g", "attribute", "L", "Raw", True)]
    entity = spark.createDataFrame(layers + rows, "model_id string, entity_id string, kind string, layer_id string, layer_name string, has_children boolean")
    edges = [("m", "t1", "a", "o"), ("m", "t2", "o", "a"), ("m", "t3", "a", "gone"), ("lost", "t1", "x", "y")]
    transition = spark.createDataFrame(edges, "model_id string, transition_id string, source string, target string")
    prop = spark.createDataFrame([("m", "t1", "Source", "run"), ("m", "t2", "Source", "")], "model_id string, entity_id string, key string, value string")
    columns = ["objects", "objects_untraced", "attributes", "attributes_traced", "attributes_untraced", "transitions", "derived", "hand_drawn", "dangling"]
    got = {(r["model_id"], r["layer_name"]): tuple(r[c] for c in columns) for r in md.coverage_by_layer(entity, transition, prop).collect()}
    none = (None,) * 4
    assert got == {
        ("m", "Raw"): (1, 0, 2, 1, 1, *none), ("m", "Gold"): (0, 0, 0, 0, 0, *none), ("bare", "Raw"): (0, 0, 0, 0, 0, *none),
        ("m", None): (1, 0, 2, 1, 1, 2, 1, 1, 1), ("bare", None): (0,) * 9, ("lost", None): (0, 0, 0, 0, 0, 0, 0, 0, 1),
    }


def test_positions_of_large_and_small_groups(spark):
    from heddle.session import hot_keys, placed

    rows = [("a", i) for i in range(40)] + [("b", 1), ("b", 0)] + [(None, i) for i in range(30)]
    df = spark.createDataFrame([(k, i, i * 7 % 41) for k, i in rows], "k string, i int, o int")
    assert {(r["k"], r["_salts"] > 0) for r in hot_keys(df, ["k"], 20).collect()} == {("a", True), (None, True)}
    for least in (10, 1000):
        got = {(r["k"], r["i"]): r["n"] for r in placed(df, ["k"], ["o"], "n", least=least).collect()}
        want = {}
        for k in ("a", "b"):  # rows without a group have no place
            for n, (_, i) in enumerate(sorted((i * 7 % 41, i) for x, i in rows if x == k), 1):
                want[(k, i)] = n
        assert got == want


def test_edges_come_out_dealt_by_the_end_that_is_asked_for(spark):
    entity = spark.createDataFrame([("m", x) for x in "abc"], "model_id string, entity_id string")
    edges = spark.createDataFrame([("m", "a", "b"), ("m", "a", "b"), ("m", "b", "c"), ("m", "c", "x"), (None, "a", "b")], "model_id string, source string, target string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for direction, want in (("downstream", {("a", "b"), ("b", "c")}), ("upstream", {("b", "a"), ("c", "b")})):
            step = g.oriented(g.live_edges(edges, entity, g._by(direction)), direction)
            assert {(r["node"], r["nxt"]) for r in step.collect()} == want
            plan = step._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert plan.count("Exchange hashpartitioning") == 4  # both ends' ids and the edges twice, none to tell edges apart
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_the_model_is_built_with_the_rows_of_its_binding(spark, tmp_path):
    from heddle.plans import catalog, registry  # noqa: F401

    data = {
        "nation": ("n_nationkey long, n_name string", [(1, "PERU"), (2, "CHINA")]),
        "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string, c_acctbal double", [(1, "C1", 1, "B", 1.0), (2, "C2", 2, "M", 2.0), (2, "C2b", 2, "M", 2.0), (None, "C3", 1, "B", 0.0)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "S1", 1), (2, "S2", 2), (2, "S2b", 1)]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string", [(1, "a b", "Brand#1", "T"), (2, "c", "Brand#2", "U"), (2, "c", "Brand#2", "V")]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string", [(1, 1, "F", "1-URGENT"), (2, 2, "P", "3-LOW"), (2, 1, "O", "2-HIGH"), (3, None, "F", None), (None, 1, "F", "1-URGENT")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string", [(1, 1, 1, 1, "R", "O"), (1, 1, 1, 1, "A", "F"), (2, 2, 2, 1, "N", "O"), (2, None, 2, 2, None, "O"), (None, 1, 1, 1, "R", "O"), (9, 1, 1, 1, "R", "O")]),
    }
    for name, (schema, rows) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    t = registry.Inputs(spark, str(tmp_path))
    for name in registry.BUILT:
        plain = t.sql(registry.BINDINGS[name])
        assert sorted(map(str, t(name).collect())) == sorted(map(str, plain.collect())), name


def _trace_tables(spark):
    ids = [("m", x, "attribute", "own" if x == "s" else None) for x in ("s", "a", "b", "loop", "back")] + [("m", "t", "attribute", None)] * 2 + [("m", "own", "object", None), ("m", "far", "object", None)]
    entity = spark.createDataFrame([(*r, "Gold" if r[1] == "t" else "Bronze") for r in ids], "model_id string, entity_id string, kind string, object_id string, layer_name string")
    ends = [("s", "a"), ("a", "t"), ("s", "b"), ("b", "t"), ("s", "loop"), ("loop", "back"), ("back", "loop"), ("a", "gone"), ("gone", "t"), ("s", None), ("own", "far")]
    transition = spark.createDataFrame(
        [("m", f"{a}>{b}", a, b, i) for i, (a, b) in enumerate(ends)], "model_id string, transition_id string, source string, target string, ordinal bigint"
    )
    return entity, transition


def test_steps_of_a_trace(spark):
    """Only edges towards a goal, once for each row of the goal, with a missing end on neither side; a walk joins them where they lie."""
    entity, transition = _trace_tables(spark)
    for to_layer, want in ((None, {"s>a", "a>t", "s>b", "b>t", "own>far"}), (" gold", {"s>a", "a>t", "s>b", "b>t"})):
        step, _, _ = g._steps(entity, transition, "downstream", to_layer)
        rows = [(r["hop"], r["goal"]) for r in step.rows().collect()]
        assert {h for h, _ in rows} == want
        assert sorted(h for h, goal in rows if goal and h != "own>far") == ["a>t", "a>t", "b>t", "b>t"]
    starts = spark.createDataFrame([("m", "s")], "model_id string, start string")
    paths, status = g.trace_paths(starts, entity, transition)
    assert sorted((r["path_no"], tuple(r["nodes"])) for r in paths.collect()) == [(1, ("s", "a", "t")), (2, ("s", "a", "t")), (3, ("s", "b", "t")), (4, ("s", "b", "t"))]
    assert status.first()["n_paths"] == 4
    got = {(r["transition_id"], r["goal"]) for r in g.trace_edges(starts, entity, transition).collect()}
    assert got == {("s>a", False), ("a>t", True), ("s>b", False), ("b>t", True)}


def test_fallback_goes_along_one_set_of_steps(spark, monkeypatch):
    entity, transition = _trace_tables(spark)
    transition = transition.filter("source <> 's' or source is null")
    made, steps = [], g._steps
    monkeypatch.setattr(g, "_steps", lambda *a: made.append(a) or steps(*a))
    starts = spark.createDataFrame([("m", "s"), ("m", "a"), ("m", "loop")], "model_id string, start string")
    paths, status = g.trace_with_fallback(starts, entity, transition.filter("target <> 's'"))
    assert {(r["start"], r["answered"], r["n_paths"]) for r in status.collect()} == {("s", "object", 1), ("a", "own", 2), ("loop", "none", 0)}
    assert len(made) == 1


def test_level_of_a_start_needs_no_paths_group(spark):
    entity, _ = _trace_tables(spark)
    rows = [("m", "s", 1, ["s", "a"]), ("m", "s", 2, ["s", "b"]), ("m", "own", 1, ["own", "far"]), ("m", "a", 1, ["a", "far"])]
    paths = spark.createDataFrame(rows, "model_id string, start string, path_no bigint, nodes array<string>")
    per_start = g.trace_levels(paths, entity)[1]
    assert {(r["start"], r["level"]) for r in per_start.collect()} == {("s", "attribute"), ("own", "object"), ("a", "mixed")}
    assert per_start._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    unknown = entity.withColumn("kind", F.when(F.col("entity_id").isin("a", "b"), None).otherwise(F.col("kind")))
    odd = spark.createDataFrame([("m", "a", 1, ["a", "s"]), ("m", "a", 2, ["a", "b"])], paths.schema)
    assert g.trace_levels(odd, unknown)[1].first()["level"] == "mixed"


def test_levels_of_a_walk_are_not_moved_again(spark, monkeypatch):
    monkeypatch.setattr(g, "SMALL", 0)
    edges = spark.createDataFrame([("m", f"n{i}", f"n{(i + 1) % 20}") for i in range(20)], "model_id string, node string, nxt string")
    seeds = spark.createDataFrame([("m", "n0", "n0"), ("m", "n5", "n5")], "model_id string, start string, node string")
    got = {(r["start"], r["node"], r["hops"]) for r in g.reachable(seeds, edges).collect()}
    assert got == {(f"n{s}", f"n{(s + i) % 20}", i) for s in (0, 5) for i in range(20)}
    alone = g.reachable(seeds.select("model_id", "node"), edges, 2)
    assert sorted((r["node"], r["hops"]) for r in alone.collect()) == [("n0", 0), ("n1", 1), ("n2", 2), ("n5", 0), ("n6", 1), ("n7", 2)]
