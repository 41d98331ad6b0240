"""What is moved: results of operators on rows that take different ways through them, and plans that move no more than they must."""

import hashlib
import os
import time

from pyspark.sql import functions as F

from heddle.operators import edit, flows
from heddle.operators import graph, model
from heddle.session import FACTOR, SWEEP, Passing, cut, cut_by, lasting, sized, swept

EDIT = "model_id string, batch_id long, seq int, kind string, describes string, source_id string, target_id string, entity_id string, key string, value string"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_proposals_are_moved_only_by_the_ids_they_have(spark):
    entity = spark.createDataFrame([("m", x, f"n{x}") for x in "abc"] + [("m", "c", "other")], "model_id string, entity_id string, name string")
    transition = spark.createDataFrame([("m", "a", "b")], "model_id string, source string, target string")
    prop = spark.createDataFrame([("m", "a", "k", "v"), ("m", "b", "Tags", "One, two")], "model_id string, entity_id string, key string, value string")
    rows = [
        ("m", 1, 0, "add_transition", "d", "a", "c", None, None, None),  # c stands twice
        ("m", 1, 1, "add_transition", "d", "b", "a", None, None, None),
        ("m", 1, 2, "add_transition", "d", "b", "a", None, None, None),
        ("m", None, 3, "add_transition", "d", "b", "a", None, None, None),
        ("m", 2, 0, "add_transition", "d", "a", "b", "a", None, None),
        ("m", 2, 1, "add_transition", "d", None, "b", None, None, None),
        ("m", 2, 2, "add_transition", "d", None, None, None, None, None),
        ("m", 2, 3, "add_transition", "d", "b", "a", "a", None, None),
        ("m", 2, 4, "add_transition", "d", "x", "a", None, None, None),
        (None, 2, 5, "add_transition", "d", "a", "c", None, None, None),
        ("m", 3, 0, "set_property", "d", None, None, "a", " k ", "v"),
        ("m", 3, 1, "add_tag", "d", None, None, "b", None, " TWO "),
        ("m", 3, 2, "rename", "d", None, None, "c", None, "nc"),
        ("m", 3, 3, "rename", " ", None, "c", None, None, "nc"),
        ("m", 3, 4, None, "d", None, None, None, None, None),
        ("m", 3, 5, "rename", "d", None, None, None, None, "x"),
    ]
    found = edit.validate_changes(spark.createDataFrame(rows, EDIT), entity, transition, prop)
    assert "isnull(entity_id" in plan_of(found)
    assert sorted(((r.batch_id or 0, r.seq, r.reason or "") for r in found.collect())) == sorted([
        (1, 0, ""), (1, 0, ""), (1, 1, ""), (1, 2, "already proposed"), (0, 3, ""), (2, 0, "exists"), (2, 1, "needs both ends"), (2, 2, "needs both ends"),
        (2, 3, ""), (2, 4, "unknown source"), (2, 5, "unknown source"), (3, 0, "no change"), (3, 1, "no change"), (3, 2, "no change"), (3, 2, ""),
        (3, 3, "no description"), (3, 3, "no description"), (3, 4, ""), (3, 5, "unknown entity"),
    ])


VIEW_FLOW = "nb_id long, view_key string, column string, source_name string, source_column string, transform string"


def test_views_are_asked_about_where_they_are_read(spark):
    steps = [("v1", "t", None), ("v2", "v1", "f"), ("v3", "v2", "g"), ("bad", "v2", None), ("top", "bad", None), ("a", "b", None), ("b", "a", None), ("b", "u", "h"), ("lost", "v1", None)]
    rows = spark.createDataFrame([(1, v, "c", s, "c", f) for v, s, f in steps], VIEW_FLOW)
    names = ("v1", "v2", "v3", "bad", "top", "a", "b")
    view = spark.createDataFrame([(1, v, v != "bad") for v in names] + [(1, "v1", None)], "nb_id long, view_key string, resolved boolean")
    views = flows._views(view)
    assert {tuple(r._via) for r in flows.first_steps(rows, views).collect()} == {()}
    found = {(r.view_key, r.source_name, r.transform) for r in flows.view_closure(rows, view).collect()}
    assert found == {("v1", "t", None), ("v2", "t", "f"), ("v3", "t", "g"), ("a", "u", "h"), ("b", "u", "h")}
    flow = spark.createDataFrame([(1, "o", "c", s, "c", None) for s in ("v3", "bad", "base", "b", None)], "nb_id long, target string, column string, source_name string, source_column string, transform string")
    assert sorted((r.source_name or "", r.transform or "") for r in flows.flatten_views(flow, rows, view).collect()) == [("", ""), ("base", ""), ("t", "g"), ("u", "h")]
    assert {(r.view_key, r.ref) for r in flows.view_base_refs(rows, view).collect()} == {(v, s) for v, s, _ in found}


def test_ids_of_copies_are_made_and_not_moved(spark):
    entity = spark.createDataFrame(
        [("m", "L", "layer", None, "L", None), ("m", "o", "object", "L", "L", "o"), ("m", "a", "attribute", "o", "L", "o"), ("m", "K", "layer", None, "K", None), ("m", "p", "object", "K", "K", "p")],
        "model_id string, entity_id string, kind string, parent_id string, layer_id string, object_id string",
    )
    transition = spark.createDataFrame([("m", "a", "o"), ("m", "p", "a"), ("m", "a", "gone")], "model_id string, source string, target string")
    prop = spark.createDataFrame([("m", "a", "k", "v"), ("m", "p", "k", "v")], "model_id string, entity_id string, key string, value string")
    ids = spark.createDataFrame([("m", "L"), ("m", "a")], "model_id string, entity_id string")
    made, edges, bags = edit.clone(ids, entity, transition, prop, "s")
    new = {x: "copy-" + hashlib.sha256("\u0001".join(["s", "m", x]).encode()).hexdigest() for x in "Loa"}
    assert {tuple(r) for r in made.collect()} == {("m", new["L"], "layer", None, new["L"], None), ("m", new["o"], "object", new["L"], new["L"], new["o"]), ("m", new["a"], "attribute", new["o"], new["L"], new["o"])}
    assert {tuple(r) for r in edges.collect()} == {("m", new["a"], new["o"]), ("m", "p", new["a"])}
    assert [tuple(r) for r in bags.collect()] == [("m", new["a"], "k", "v")]
    assert not any("new_id" in x._jdf.queryExecution().executedPlan().toString() for x in (made, edges, bags))


def test_steps_are_sized_by_their_rows(spark):
    ids = cut(spark.range(50_000).select(F.concat(F.lit("l:"), "id").alias("k")))
    before = {c: spark.conf.get(c) for c in (FACTOR, "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set(FACTOR, "1.0")
        size = int(str(ids.select("*")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 4 * size)
        joined = lambda: ids.join(ids.withColumn("n", F.lit(1)).filter("k <> 'x'"), "k")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in joined()
        sized(spark)
        assert "BroadcastHashJoin" not in joined()
        spark.conf.set(FACTOR, "2.0")  # one of the session's own stays
        sized(spark)
        assert float(spark.conf.get(FACTOR)) == 2
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_steps_that_only_lead_to_others_are_deleted(spark):
    files = lambda df: [x.removeprefix("file:") for x in df.inputFiles()]
    there = lambda paths: [os.path.exists(x) for x in paths]
    rows = spark.range(10).withColumnRenamed("id", "k")
    with Passing(spark) as outer:
        with Passing(spark) as here:
            a, b = cut(rows), cut_by(rows, "k")
            gone = files(a) + files(b)
            with here.outside():
                c = cut(a.union(b))
            d = here.kept(b, "k")
            with lasting():
                e = cut(a)
            passed, kept = files(c) + files(d), files(e)
        assert gone and not any(there(gone)) and all(there(passed)) and c.count() == 20 and d.count() == 10
        f = outer.kept(c)
    assert not any(there(passed)) and all(there(kept + files(f))) and f.count() == 20 and e.count() == 10


def test_shuffle_files_of_a_step_go_when_it_is_written(spark):
    before = spark.conf.get(SWEEP, None)
    with swept(spark):
        assert spark.conf.get(SWEEP) == "true"
    assert spark.conf.get(SWEEP, None) == before
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle_")}
    had = shuffled()
    step = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):  # they may take a moment
        if not shuffled() - had:
            break
        time.sleep(0.1)
    assert not shuffled() - had and step.count() == 7


def test_steps_of_a_trace_do_not_outlast_it(spark):
    entity = spark.createDataFrame([("m", x) for x in "abc"], "model_id string, entity_id string")
    transition = spark.createDataFrame([("m", "t1", "a", "b", 1), ("m", "t2", "b", "c", 2)], "model_id string, transition_id string, source string, target string, ordinal long")
    starts = spark.createDataFrame([("m", "a")], "model_id string, start string")
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("heddle_step")}
    before = tables()
    paths, _ = graph.trace_paths(starts, entity, transition)
    assert [(r.nodes, r.hops) for r in paths.collect()] == [(["a", "b", "c"], ["t1", "t2"])]
    assert tables() == before


def test_views_of_an_edge_lie_by_their_entity(spark):
    rows = [("m", x, x, "attribute", "o", "L", x) for x in "ab"]
    entity = spark.createDataFrame(rows, "model_id string, entity_id string, name string, kind string, object_name string, layer_name string, path string")
    transition = spark.createDataFrame([("m", "t", "a", "b"), ("m", "u", "a", "gone")], "model_id string, transition_id string, source string, target string")
    prop = spark.createDataFrame([("m", "t", "Derives", "d")], "model_id string, entity_id string, key string, value string")
    links = model.explain_links(entity, transition, prop)
    assert plan_of(links).count("Join") == 1  # the other moves are done
    assert {tuple(r)[1:] for r in links.collect()} == {
        ("a", "downstream", "t", "b", "o.b", "b", "from d"), ("b", "upstream", "t", "a", "o.a", "a", "from d"), ("a", "downstream", "u", "gone", "(deleted)", "", None),
    }
