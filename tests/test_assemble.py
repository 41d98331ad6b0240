"""Owner layers, frames and views against small worked cases."""

import random

import pytest

from heddle.operators import assemble as am
from heddle.operators import flows


@pytest.mark.parametrize("steps_first", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_assign_owners(spark, seed, steps_first):
    rnd = random.Random(seed)
    steps = [(f"s{i}", "notebook", rnd.choice(["", "Wa", "Wb"]), None) for i in range(6)]
    tables = [(f"t{i}", "table", rnd.choice(["", "Wc"]), rnd.choice([None, "bronze", "gold"])) for i in range(8)]
    nodes = [("g", i, *n) for i, n in enumerate(rnd.sample(steps + tables, 14))]
    # Acyclic: reads come from lower tables, writes go to higher ones.
    links = []
    for i in range(6):
        links += [(f"t{rnd.randrange(0, i + 1)}", f"s{i}", "read"), (f"s{i}", f"t{rnd.randrange(i + 1, 8)}", "write"), (f"s{i}", f"t{rnd.randrange(i + 1, 8)}", "write")]
    node = spark.createDataFrame(nodes, "graph_id string, ordinal int, node_id string, kind string, workspace string, lakehouse string")
    link = spark.createDataFrame([("g", k, *x) for k, x in enumerate(links)], "graph_id string, ordinal int, source string, target string, kind string")
    got = {r["node_id"]: (r["owner"], r["layer"]) for r in am.assign_owners(node, link, steps_first).collect()}

    by_id = {n[2]: n for n in nodes}
    depth = {}

    def deep(x):
        if x not in depth:
            depth[x] = max([deep(a) + 1 for a, b, _ in links if b == x], default=0)
        return depth[x]

    def owner(n):
        lake = n[5] if n[3] == "table" else next((by_id[b][5] for a, b, k in links if k == "write" and a == n[2]), None)
        return n[4] or (f"lh:{lake}" if lake else "")

    first = {}
    for n in nodes:
        o = first.setdefault(owner(n), [99, n[1], False])
        o[0] = min(o[0], deep(n[2]))
        o[2] |= n[3] != "table"
    ranked = sorted(first, key=lambda o: (steps_first and not first[o][2], o == "", first[o][0], first[o][1]))
    assert got == {n[2]: (owner(n), ranked.index(owner(n))) for n in nodes}


def test_a_view_that_leads_back_to_itself_accounts_for_nothing(spark):
    view = spark.createDataFrame([("n", "a", True), ("n", "b", True), ("n", "c", False)], "nb_id string, view_key string, resolved boolean")
    shape = "nb_id string, view_key string, column string, source_name string, source_column string, transform string"
    view_flow = spark.createDataFrame([("n", "a", "x", "b", "x", None), ("n", "b", "x", "a", "x", None), ("n", "b", "x", "W/L/t", "x", "f(x)"), ("n", "c", "x", "W/L/u", "x", None)], shape)
    flow = spark.createDataFrame(
        [("n", "out", "x", "a", "x", None), ("n", "out", "y", "a", "nope", None), ("n", "out", "z", "c", "x", None), ("m", "out", "x", "a", "x", None)],
        "nb_id string, target string, column string, source_name string, source_column string, transform string",
    )
    got = {tuple(r) for r in flows.flatten_views(flow, view_flow, view).collect()}
    assert got == {("n", "out", "x", "W/L/t", "x", "f(x)"), ("m", "out", "x", "a", "x", None)}


def test_frames_built_on_an_unknown_frame_are_unknown(spark):
    columns = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b")], "ref string, ordinal int, column_name string")
    shape = "nb_id string, frame_id string, op string, input_frame string, input_frame2 string, args array<struct<out: string, expr: string, refs: array<string>>>"
    ops = spark.createDataFrame(
        [
            ("n", "1", "read", "t", None, []),
            ("n", "2", "pivot", "1", None, []),
            ("n", "3", "passthrough", "2", None, []),
            ("n", "4", "join", "1", "3", []),
            ("n", "5", "groupAgg", "1", None, [(None, "key", ["a"])]),
            ("n", "6", "rename", "1", None, [("z", None, ["missing"])]),
            ("n", "7", "select", "1", None, [("b", None, ["b"]), ("b", "b + a", ["a", "b"]), (None, "max(a)", ["a"])]),
            ("n", "8", "read", "nowhere", None, []),
        ],
        shape,
    )
    frames, unknown = flows.frame_provenance(ops, columns)
    assert {r["frame_id"] for r in unknown.collect()} == {"2", "3", "4", "5", "6", "8"}
    seven = [(r["column"], sorted(s["src_col"] for s in r["sources"]), r["transform"]) for r in frames.filter("frame_id = '7'").collect()]
    assert seven == [("b", ["a", "b"], "b + a")]


def test_activities_held_back_by_a_cycle_follow_in_document_order(spark):
    rows = [("p", 0, "a", ["c"]), ("p", 1, "b", ["a"]), ("p", 2, "c", ["b"]), ("p", 3, "d", ["zz"]), ("p", 4, "e", None)]
    df = spark.createDataFrame(rows, "pipeline_id string, ordinal int, name string, depends_on array<string>")
    got = [r["name"] for r in am.activity_order(df).orderBy("position").collect()]
    assert got == ["d", "e", "a", "b", "c"]


def test_pipelines_nested_deeper_than_any_bound_are_expanded(spark):
    # p0 calls p1 calls ... p8; p8 calls p3 again, which is not expanded twice on one path.
    rows = [("w", f"p{i}", 0, f"a{i}", "Run", None, f"P{i + 1}" if i < 8 else "p3", "") for i in range(9)]
    schema = "workspace_id string, pipeline_id string, ordinal int, name string, type string, depends_on array<string>, child_pipeline_id string, child_workspace_id string"
    df = spark.createDataFrame(rows, schema)
    whole, deps = am.expand_pipelines(df)
    depth = {r["name"]: r["depth"] for r in whole.filter("root = 'p0'").collect()}
    chain = " / ".join(f"a{i}" for i in range(9))
    assert depth[chain] == 8 and len(depth) == 9
    assert deps.filter("root = 'p0'").count() == 8
    cut_off, _ = am.expand_pipelines(df, max_depth=2)
    assert cut_off.filter("root = 'p0'").count() == 3
