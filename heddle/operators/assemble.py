"""Assembly of graphs and authored models from catalogues, definitions and runs."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from heddle.functions.refs import make_ref, parse_ref
from heddle.operators.graph import longest_path
from heddle.session import cut, join_hot

TEXT = "string"


def _null(name: str) -> Column:
    return F.lit(None).cast(TEXT).alias(name)


# --- workspace graphs --------------------------------------------------------

NODE = ["graph_id", "node_id", "kind", "name", "parent_id", "ref", "flag"]
EDGE = ["graph_id", "source", "target", "kind"]


def _table_node(ref: str) -> Column:
    return F.concat(F.lit("table."), F.lower(ref))


def workspace_graph(
    workspace: DataFrame, lakehouse: DataFrame, table: DataFrame, notebook: DataFrame, access: DataFrame,
    pipeline: DataFrame, activity: DataFrame, activity_access: DataFrame, other: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """Every item of each workspace and what it depends on.

    `workspace` (graph_id, name), `lakehouse` (graph_id, id, name), `table` (graph_id, lakehouse_id, name), `notebook`
    (graph_id, id, name), `access` (graph_id, notebook_id, access, ref), `pipeline` (graph_id, id, name), `activity`
    (graph_id, pipeline_id, notebook_id), `activity_access` (graph_id, pipeline_id, access, ref), `other` (graph_id, id,
    name, item_type). Items nothing can be read from are opaque; referenced tables no catalogue lists are inferred.
    """
    ws = workspace.select("graph_id", F.concat(F.lit("workspace."), "graph_id").alias("_ws"))

    def items(df: DataFrame, kind: str, flag: Column | None = None) -> DataFrame:
        return join_hot(df, ws, ["graph_id"]).select(
            "graph_id", F.concat(F.lit(f"{kind}."), "id").alias("node_id"), F.lit(kind).alias("kind"), "name", F.col("_ws").alias("parent_id"),
            _null("ref"), (flag if flag is not None else F.lit(None).cast(TEXT)).alias("flag"),
        )

    top = workspace.select("graph_id", F.concat(F.lit("workspace."), "graph_id").alias("node_id"), F.lit("workspace").alias("kind"), "name", _null("parent_id"), _null("ref"), _null("flag"))
    held = (
        join_hot(
            join_hot(table.withColumnRenamed("name", "_t"), lakehouse.select("graph_id", F.col("id").alias("lakehouse_id"), F.col("name").alias("_l")), ["graph_id", "lakehouse_id"]),
            workspace.select("graph_id", F.col("name").alias("_w")),
            ["graph_id"],
        )
        .withColumn("ref", make_ref("_t", "_l", "_w"))
    )
    # Two listings of one ref are one node, the first lakehouse id keeps it.
    tables = held.groupBy("graph_id", _table_node("ref").alias("node_id")).agg(F.min(F.struct("lakehouse_id", "_t", "ref")).alias("_f")).select(
        "graph_id", "node_id", F.lit("table").alias("kind"), F.col("_f._t").alias("name"), F.concat(F.lit("lakehouse."), "_f.lakehouse_id").alias("parent_id"),
        F.col("_f.ref").alias("ref"), _null("flag"),
    )
    known = top.unionByName(items(lakehouse, "lakehouse")).unionByName(tables).unionByName(items(notebook, "notebook"))
    known = known.unionByName(items(pipeline, "pipeline")).unionByName(items(other, "item", F.concat(F.lit("opaque:"), "item_type")))
    named = lambda df: df.filter(parse_ref("ref")["table"] != "")
    touch = access.select("graph_id", F.concat(F.lit("notebook."), "notebook_id").alias("_i"), "access", "ref").union(
        named(activity_access).select("graph_id", F.concat(F.lit("pipeline."), "pipeline_id"), "access", "ref")
    )
    reading = F.col("access") == "read"
    edges = touch.select(
        "graph_id", F.when(reading, _table_node("ref")).otherwise(F.col("_i")).alias("source"), F.when(reading, F.col("_i")).otherwise(_table_node("ref")).alias("target"),
        F.when(reading, "reads").otherwise("writes").alias("kind"),
    )
    calls = activity.join(notebook.select("graph_id", F.col("id").alias("notebook_id")), ["graph_id", "notebook_id"], "left_semi").select(
        "graph_id", F.concat(F.lit("pipeline."), "pipeline_id").alias("source"), F.concat(F.lit("notebook."), "notebook_id").alias("target"), F.lit("calls").alias("kind")
    )
    seen = touch.groupBy("graph_id", _table_node("ref").alias("node_id")).agg(F.min("ref").alias("ref"))
    missing = seen.join(known.select("graph_id", "node_id"), ["graph_id", "node_id"], "left_anti").select(
        "graph_id", "node_id", F.lit("table").alias("kind"), parse_ref("ref")["table"].alias("name"), _null("parent_id"), "ref", F.lit("inferred").alias("flag")
    )
    return known.unionByName(missing).select(*NODE), edges.unionByName(calls).distinct()


FIELDS = ("database", "path", "url", "server")


def lakehouse_of_source(source: DataFrame, lakehouse: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, source_id, lakehouse_id): the lakehouse a connection names, in a field or a path segment of it, fields in
    their fixed order. `source` is (scope, id, details), `lakehouse` (scope, id, name)."""
    def candidates(rank: int, field: str) -> Column:
        value = F.try_element_at("details", F.lit(field))
        parts = F.filter(F.split(F.replace(value, F.lit("\\"), F.lit("/")), "/"), lambda s: s != "")
        keyed = F.transform(
            F.concat(F.array(value), parts),
            lambda s, i: F.struct(F.lit(rank).alias("rank"), i.cast("int").alias("pos"), F.lower(F.trim(s)).alias("key")),
        )
        none = F.expr("cast(array() as array<struct<rank: int, pos: int, key: string>>)")
        return F.when(F.coalesce(value, F.lit("")) != "", keyed).otherwise(none)

    ranked = [candidates(rank, field) for rank, field in enumerate(FIELDS)]
    found = source.select(*scope, F.col("id").alias("source_id"), F.inline(F.concat(*ranked)))
    named = lakehouse.select(*scope, F.lower(F.trim("name")).alias("key"), F.col("id").alias("lakehouse_id")).filter("key <> ''")
    one = named.groupBy(*scope, "key").agg(F.max("lakehouse_id").alias("lakehouse_id"))
    return found.join(one, [*scope, "key"]).groupBy(*scope, "source_id").agg(F.min_by("lakehouse_id", F.struct("rank", "pos")).alias("lakehouse_id"))


def bi_edges(bi: dict[str, DataFrame], lakehouse: DataFrame, scope: str = "scan_id") -> DataFrame:
    """(scope, source, target): lakehouse to dataset, dataset to report, report to dashboard; both ends scanned."""
    via = lakehouse_of_source(bi["datasource"], lakehouse, [scope])
    used = bi["dataset"].select(scope, F.col("id").alias("_d"), F.explode("datasource_ids").alias("source_id"))
    a = used.join(via, [scope, "source_id"]).select(scope, F.concat(F.lit("lakehouse."), "lakehouse_id").alias("source"), F.concat(F.lit("semanticmodel."), "_d").alias("target"))
    known = bi["dataset"].select(scope, F.col("id").alias("dataset_id"))
    b = bi["report"].join(known, [scope, "dataset_id"], "left_semi").select(
        scope, F.concat(F.lit("semanticmodel."), "dataset_id").alias("source"), F.concat(F.lit("report."), "id").alias("target")
    )
    shown = bi["dashboard"].select(scope, F.col("id").alias("_b"), F.explode("report_ids").alias("id"))
    c = shown.join(bi["report"].select(scope, "id"), [scope, "id"], "left_semi").select(
        scope, F.concat(F.lit("report."), "id").alias("source"), F.concat(F.lit("dashboard."), "_b").alias("target")
    )
    return a.unionByName(b).unionByName(c).distinct()


def bi_consumers(bi: dict[str, DataFrame], written: DataFrame, scope: str = "scan_id") -> DataFrame:
    """(scope, id, name, kind, via): datasets, reports and dashboards downstream of written lakehouses (scope, name), each with
    the first lakehouse it comes through."""
    wanted = written.select(scope, F.col("name").alias("id"), "name").filter("trim(name) <> ''")
    via = lakehouse_of_source(bi["datasource"], wanted, [scope]).withColumnRenamed("lakehouse_id", "via")
    used = bi["dataset"].select(scope, "id", "name", F.posexplode("datasource_ids").alias("_at", "source_id"))
    hit = used.join(via, [scope, "source_id"]).groupBy(scope, "id", "name").agg(F.min_by("via", "_at").alias("via"))
    reports = bi["report"].join(hit.select(scope, F.col("id").alias("dataset_id"), "via"), [scope, "dataset_id"]).select(scope, "id", "name", "via")
    shown = bi["dashboard"].select(scope, F.col("id").alias("_b"), F.col("name").alias("_n"), F.posexplode("report_ids").alias("_at", "id"))
    boards = shown.join(reports.select(scope, "id", "via"), [scope, "id"]).groupBy(scope, "_b", "_n").agg(F.min_by("via", "_at").alias("via"))
    tag = lambda df, k: df.select(scope, "id", "name", F.lit(k).alias("kind"), "via")
    return tag(hit, "semanticmodel").unionByName(tag(reports, "report")).unionByName(tag(boards.withColumnsRenamed({"_b": "id", "_n": "name"}), "dashboard"))


def item_rollup(node: DataFrame, edge: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items, links): tables folded onto their lakehouse, the workspace dropped; a link counts its edges. A table without a
    lakehouse stays as an external item; self links and links to ends that are not drawn are dropped."""
    drawn = node.filter("kind <> 'workspace' and not (kind = 'table' and parent_id is not null)")
    items = drawn.select("graph_id", "node_id", "kind", "name", (F.col("kind") == "table").alias("external"))
    folded = F.when((F.col("kind") == "table") & F.col("parent_id").isNotNull(), F.col("parent_id")).otherwise(F.col("node_id"))
    place = node.filter("kind <> 'workspace'").select("graph_id", "node_id", folded.alias("_item")).join(
        items.select("graph_id", F.col("node_id").alias("_item")), ["graph_id", "_item"], "left_semi"
    )
    ends = edge.join(place.select("graph_id", F.col("node_id").alias("source"), F.col("_item").alias("from")), ["graph_id", "source"]).join(
        place.select("graph_id", F.col("node_id").alias("target"), F.col("_item").alias("to")), ["graph_id", "target"]
    )
    return items, ends.filter("`from` <> `to`").groupBy("graph_id", "from", "to").agg(F.count(F.lit(1)).alias("count"))


# --- pipelines -----------------------------------------------------------------

def expand_pipelines(activity: DataFrame, max_depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(activities, dependencies) of every pipeline with its children spliced in.

    `activity` is (workspace_id, pipeline_id, ordinal, name, type, depends_on, child_pipeline_id, child_workspace_id).
    activities: (workspace_id, root, name, holder, type, depth), `name` prefixed by the activities that invoke it;
    dependencies: (workspace_id, root, name, depends_on). A child's roots depend on the invoking activity; what depended on that
    one now depends on the child's leaves. No pipeline twice on one path, which ends the expansion unless
    `max_depth` ends it earlier; an unreadable child leaves its activity as it is.
    """
    acts = cut(activity.withColumn("_key", F.struct(F.lower("workspace_id").alias("w"), F.lower("pipeline_id").alias("p"))))
    root = ["_rw", "root"]
    level = acts.select(
        F.col("workspace_id").alias("_rw"), F.col("pipeline_id").alias("root"), "name", _null("holder"), "type", F.col("workspace_id").alias("_ws"), "child_pipeline_id",
        "child_workspace_id", F.coalesce("depends_on", F.expr("cast(array() as array<string>)")).alias("_deps"), F.expr("cast(array() as array<struct<w: string, p: string>>)").alias("_seen"),
    )
    levels = [cut(level)]
    while max_depth is None or len(levels) <= max_depth:
        child = F.struct(F.lower(F.coalesce(F.nullif("child_workspace_id", F.lit("")), "_ws")).alias("w"), F.lower("child_pipeline_id").alias("p"))
        calls = levels[-1].filter("coalesce(child_pipeline_id, '') <> ''").withColumn("_key", child).filter(~F.array_contains("_seen", F.col("_key")))
        kids = calls.select(*root, F.col("name").alias("holder"), "_key", F.array_append("_seen", F.col("_key")).alias("_seen")).join(
            acts.select("_key", F.col("name").alias("_n"), "type", F.col("workspace_id").alias("_ws"), "child_pipeline_id", "child_workspace_id", F.col("depends_on").alias("_d")), "_key"
        )
        inside = lambda n: F.concat_ws(" / ", F.col("holder"), n)
        kids = cut(kids.select(
            *root, inside(F.col("_n")).alias("name"), "holder", "type", "_ws", "child_pipeline_id", "child_workspace_id",
            F.transform(F.coalesce("_d", F.expr("cast(array() as array<string>)")), lambda d: inside(d)).alias("_deps"), "_seen",
        ))
        if kids.isEmpty():
            break
        levels.append(kids)
    # Bottom up: what a dependency on an invoking activity means is known once its child is.
    leaves: DataFrame | None = None
    below: DataFrame | None = None
    finals = []
    for level in reversed(levels):
        deps = level.select(*root, "name", "holder", F.explode("_deps").alias("depends_on"))
        if leaves is not None:
            tails = leaves.select(*root, F.col("holder").alias("depends_on"), "leaf")
            deps = deps.join(tails, [*root, "depends_on"], "left").withColumn("depends_on", F.coalesce("leaf", "depends_on")).drop("leaf")
        first = level.filter("size(_deps) = 0 and holder is not null").select(*root, "name", "holder", F.col("holder").alias("depends_on"))
        final = cut(deps.select(*root, "name", "holder", "depends_on").unionByName(first).distinct())
        finals.append(final.drop("holder"))
        candidate = level.filter("holder is not null").select(*root, "holder", F.col("name").alias("leaf"))
        needed = final.filter("holder is not null").select(*root, "holder", F.col("depends_on").alias("leaf"))
        if leaves is not None:
            mine = level.select(*root, "holder", F.col("name").alias("_n"))
            candidate = candidate.union(leaves.select(*root, F.col("holder").alias("_n"), "leaf").join(mine, [*root, "_n"]).filter("holder is not null").select(*root, "holder", "leaf"))
            called = below.filter("holder = depends_on").select(*root, F.col("holder").alias("_n")).distinct()
            needed = needed.union(called.join(mine, [*root, "_n"]).filter("holder is not null").select(*root, "holder", F.col("_n").alias("leaf")))
        free = candidate.distinct().join(needed.distinct(), [*root, "holder", "leaf"], "left_anti")
        alone = level.filter("holder is not null").select(*root, "holder").distinct().join(free.select(*root, "holder").distinct(), [*root, "holder"], "left_anti")
        leaves = cut(free.union(alone.select(*root, "holder", F.col("holder").alias("leaf"))))
        below = final
    activities = None
    for depth, level in enumerate(levels):
        part = level.select(F.col("_rw").alias("workspace_id"), "root", "name", "holder", "type", F.lit(depth).alias("depth"))
        activities = part if activities is None else activities.unionByName(part)
    dependencies = finals[0]
    for part in finals[1:]:
        dependencies = dependencies.unionByName(part)
    return activities, dependencies.select(F.col("_rw").alias("workspace_id"), "root", "name", "depends_on")


def pipeline_waves(activity: DataFrame) -> DataFrame:
    """(pipeline_id, name, wave, concurrent): one wave past the deepest dependency, unknown ones ignored; `activity` is (pipeline_id, name, depends_on)."""
    nodes = activity.select("pipeline_id", F.col("name").alias("node"))
    edges = activity.select("pipeline_id", F.col("name").alias("target"), F.explode("depends_on").alias("source"))
    depth = cut(longest_path(nodes, edges, "pipeline_id"))
    size = depth.groupBy("pipeline_id", "depth").agg(F.count(F.lit(1)).alias("_n"))
    return depth.join(size, ["pipeline_id", "depth"]).select(
        "pipeline_id", F.col("node").alias("name"), (F.col("depth") + 1).alias("wave"), (F.col("_n") > 1).alias("concurrent")
    )


def _document_order(activities: list) -> list[int]:
    """Positions of (ordinal, name, depends_on) rows, sorted by ordinal, in the order they can run."""
    known = {a["name"] for a in activities}
    waits = [{d for d in (a["depends_on"] if a["depends_on"] is not None else ()) if d in known} for a in activities]
    dependants: dict[str, list[int]] = {}
    for i, deps in enumerate(waits):
        for d in deps:
            dependants.setdefault(d, []).append(i)
    ready = [i for i, deps in enumerate(waits) if not deps]
    heapq.heapify(ready)
    out: list[int] = []
    finished: set[str] = set()
    while ready:
        i = heapq.heappop(ready)
        out.append(i)
        name = activities[i]["name"]
        if name not in finished:
            finished.add(name)
            for j in dependants.get(name, ()):
                waits[j].discard(name)
                if not waits[j]:
                    heapq.heappush(ready, j)
    placed = set(out)
    return out + [i for i in range(len(activities)) if i not in placed]


@F.pandas_udf(ArrayType(IntegerType()))
def _order_of(activities: pd.Series) -> pd.Series:
    return pd.Series([_document_order(list(a)) for a in activities])


def activity_order(activity: DataFrame) -> DataFrame:
    """(pipeline_id, name, position): always the first activity in document order whose known dependencies are done; what
    a cycle holds back follows in document order. A pipeline is one JSON document, which bounds its array."""
    listed = activity.groupBy("pipeline_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "name", "depends_on"))).alias("_a"))
    placed = listed.select("pipeline_id", "_a", F.posexplode(_order_of("_a")).alias("_p", "_i"))
    return placed.select("pipeline_id", F.get("_a", F.col("_i"))["name"].alias("name"), (F.col("_p") + 1).alias("position"))


def nested_steps(step: DataFrame) -> DataFrame:
    """(model_id, path, name, parent_path, is_step): holders for every prefix of step names like ``a / b / c`` and the steps under them."""
    parts = F.split("name", " / ")
    spots = F.sequence(F.lit(1), F.size(parts))
    rows = step.select("model_id", parts.alias("_p"), F.explode(spots).alias("_n"))
    path = lambda n: F.array_join(F.slice("_p", 1, n), " / ")
    made = rows.select(
        "model_id", path(F.col("_n")).alias("path"), F.element_at("_p", F.col("_n")).alias("name"),
        F.when(F.col("_n") > 1, path(F.col("_n") - 1)).alias("parent_path"), (F.col("_n") == F.size("_p")).alias("_leaf"),
    )
    return made.groupBy("model_id", "path", "name", "parent_path").agg(F.max("_leaf").alias("is_step"))


# --- runs ----------------------------------------------------------------------------

def run_graph(run: DataFrame, access: DataFrame, column: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, column maps) of runs: `run` (run_id, notebook, workspace), `access` (run_id, access, ref),
    `column` (run_id, ref, ordinal, column_name, data_type), `flow` (run_id, to_table, to_column, from_column, transform).
    Column maps hang on the write edge of their target; table columns come as rows of kind `column`."""
    ws = F.concat(F.lit("workspace."), F.lower("workspace"))
    nb = F.concat(F.lit("notebook."), F.lower("notebook"))
    top = run.select("run_id", ws.alias("node_id"), F.lit("workspace").alias("kind"), F.col("workspace").alias("name"), _null("parent_id"))
    book = run.select("run_id", nb.alias("node_id"), F.lit("notebook").alias("kind"), F.col("notebook").alias("name"), ws.alias("parent_id"))
    refs = access.select("run_id", "ref").distinct()
    table = refs.select("run_id", _table_node("ref").alias("node_id"), F.lit("table").alias("kind"), parse_ref("ref")["table"].alias("name"), _null("parent_id"))
    col = column.join(refs, ["run_id", "ref"], "left_semi").select(
        "run_id", F.concat_ws("#", _table_node("ref"), "column_name").alias("node_id"), F.lit("column").alias("kind"), F.col("column_name").alias("name"), _table_node("ref").alias("parent_id")
    )
    placed = access.select("run_id", "access", "ref").distinct().join(run.select("run_id", nb.alias("_nb")), "run_id")
    reading = F.col("access") == "read"
    edges = placed.select(
        "run_id", F.when(reading, _table_node("ref")).otherwise(F.col("_nb")).alias("source"), F.when(reading, F.col("_nb")).otherwise(_table_node("ref")).alias("target"),
        F.when(reading, "reads").otherwise("writes").alias("kind"),
    )
    written = placed.filter("access = 'write'").select("run_id", F.col("ref").alias("to_table"), F.col("_nb").alias("source"))
    maps = flow.join(written, ["run_id", "to_table"]).select("run_id", "source", _table_node("to_table").alias("target"), "from_column", "to_column", "transform")
    return top.unionByName(book).unionByName(table).unionByName(col), edges, maps


def copy_schemas(flow: DataFrame) -> DataFrame:
    """(pipeline_id, ordinal, ref, position, column_name): table columns as a copy's mapping names them, in first-seen order;
    `flow` is (pipeline_id, ordinal, flow_no, to_table, to_column, from_table, from_column)."""
    both = flow.select("pipeline_id", "ordinal", F.inline(F.array(
        F.struct(F.col("from_table").alias("ref"), F.col("from_column").alias("column_name"), (F.col("flow_no") * 2).alias("_at")),
        F.struct(F.col("to_table").alias("ref"), F.col("to_column").alias("column_name"), (F.col("flow_no") * 2 + 1).alias("_at")),
    ))).filter("ref is not null")
    return both.groupBy("pipeline_id", "ordinal", "ref", "column_name").agg(F.min("_at").alias("position"))


def step_io(step_run: DataFrame, access: DataFrame) -> DataFrame:
    """(step_id, access, ref): distinct over the runs of a step."""
    return step_run.select("step_id", "run_id").join(access, "run_id").select("step_id", "access", "ref").distinct()


# Stage names in the order data moves through them.
STAGES = ("landing", "raw", "staging", "bronze", "silver", "gold", "platinum", "curated", "serving", "mart")


def stage_rank(name: Column | str) -> Column:
    """Place of the first stage a name carries as a word of its own, -1 for none."""
    low = F.lower(name)
    found = [F.when(F.rlike(low, F.lit(f"(?:^|[^a-z]){s}(?:[^a-z]|$)")), i) for i, s in enumerate(STAGES)]
    return F.coalesce(*found, F.lit(-1))


def assign_stages(node: DataFrame, link: DataFrame) -> DataFrame:
    """(graph_id, node_id, stage, layer): a table's stage is its lakehouse's, a step's that of the first table it writes that has
    one, else reads. Layers number the stages present, nodes without one last. `node` (graph_id, node_id, kind, lakehouse),
    `link` (graph_id, ordinal, source, target, kind read or write)."""
    table = node.filter("kind = 'table'").select("graph_id", "node_id", stage_rank(F.coalesce("lakehouse", F.lit(""))).alias("stage"))
    staged = table.filter("stage >= 0")
    writing = F.col("kind") == "write"
    step = link.select(
        "graph_id", "ordinal", F.when(writing, F.col("source")).otherwise(F.col("target")).alias("_step"), F.when(writing, F.col("target")).otherwise(F.col("source")).alias("node_id"),
        F.when(writing, 0).otherwise(1).alias("_w"),
    )
    first = step.join(staged, ["graph_id", "node_id"]).groupBy("graph_id", F.col("_step").alias("node_id")).agg(F.min_by("stage", F.struct("_w", "ordinal")).alias("stage"))
    steps = node.filter("kind <> 'table'").select("graph_id", "node_id").join(first, ["graph_id", "node_id"], "left").fillna(-1, ["stage"])
    every = table.unionByName(steps)
    present = every.select("graph_id", "stage").distinct()  # at most one row per stage name and graph
    layer = F.row_number().over(W.partitionBy("graph_id").orderBy((F.col("stage") < 0), "stage")) - 1
    return every.join(present.withColumn("layer", layer), ["graph_id", "stage"])


def assign_owners(node: DataFrame, link: DataFrame, steps_first: bool = False) -> DataFrame:
    """(graph_id, node_id, owner, layer): one layer per owner (workspace, else lakehouse), by the earliest depth and then first
    appearance (then by name); an unknown owner last; optionally owners that run steps first. `node` (graph_id, ordinal, node_id, kind,
    workspace, lakehouse)."""
    depth = longest_path(node.select("graph_id", F.col("node_id").alias("node")), link, "graph_id").select("graph_id", F.col("node").alias("node_id"), "depth")
    writes = link.filter("kind = 'write'").join(node.select("graph_id", F.col("node_id").alias("target"), F.col("lakehouse").alias("_l")), ["graph_id", "target"])
    into = writes.groupBy("graph_id", F.col("source").alias("node_id")).agg(F.min_by("_l", "ordinal").alias("_into"))
    lake = F.nullif(F.coalesce(F.when(F.col("kind") == "table", F.col("lakehouse")).otherwise(F.col("_into")), F.lit("")), F.lit(""))
    owner = F.coalesce(F.nullif("workspace", F.lit("")), F.concat(F.lit("lh:"), lake), F.lit(""))
    rows = cut(node.join(into, ["graph_id", "node_id"], "left").join(depth, ["graph_id", "node_id"]).withColumn("owner", owner))
    owners = rows.groupBy("graph_id", "owner").agg(F.min("depth").alias("_d"), F.min("ordinal").alias("_at"), F.max(F.col("kind") != "table").alias("_runs"))
    keys = ([~F.col("_runs")] if steps_first else []) + [F.col("owner") == "", "_d", "_at", "owner"]
    layer = F.row_number().over(W.partitionBy("graph_id").orderBy(*keys)) - 1
    return rows.join(owners.withColumn("layer", layer).select("graph_id", "owner", "layer"), ["graph_id", "owner"]).select("graph_id", "node_id", "owner", "layer")


# --- authored models -------------------------------------------------------------------

CLAIM = "run analysis"


def _key(*parts: Column | str) -> Column:
    return F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts])


def first_flows(flow: DataFrame) -> DataFrame:
    """(model, to_table, to_column) with the first owned flow: `flow` is (model_id, ordinal, step, to_table, to_column, from_table, from_column, transform)."""
    best = F.min(F.struct("ordinal", "from_table", "from_column", "transform", F.col("step").alias("via"))).alias("_b")
    return flow.filter("from_table is not null").groupBy("model_id", "to_table", "to_column").agg(best).select("model_id", "to_table", "to_column", "_b.*").drop("ordinal")


def model_from_runs(step: DataFrame, access: DataFrame, column: DataFrame, flow: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, transitions, properties) of one authored model per `model_id`.

    `step` (model_id, step, ordinal, kind, workspace), `access` (model_id, step, access Read or Write, ref), `column`
    (model_id, ref, ordinal, column_name, data_type), `flow` as in `first_flows`. Steps hold a row per access and a column under it
    per table column; tables hold their columns. An access is an edge between its row and the table and one per column; the
    write side of a column edge carries where the value derives from. Layers follow the longest path.
    """
    ref, kind = "ref", F.col("access")
    acc = cut(access.select("model_id", "step", "access", "ref").distinct())
    table = acc.select("model_id", "ref").distinct()
    sid, tid = _key(F.lit("s"), "step"), _key(F.lit("t"), F.lower(ref))
    io = _key(F.lit("io"), "step", "access", "ref")
    reading = kind == "Read"
    link = acc.select("model_id", F.when(reading, tid).otherwise(sid).alias("source"), F.when(reading, sid).otherwise(tid).alias("target"))
    nodes = step.select("model_id", sid.alias("node")).union(table.select("model_id", tid.alias("node")))
    depth = cut(longest_path(nodes, link).withColumnRenamed("depth", "_c"))
    steps_in = depth.filter("node like 's|%'").select("model_id", "_c").distinct().withColumn("_steps", F.lit(True))
    last = depth.groupBy("model_id").agg(F.max("_c").alias("_last"))
    columns = depth.select("model_id", "_c").distinct().join(steps_in, ["model_id", "_c"], "left").join(last, "model_id")
    name = F.when(F.col("_steps"), "Notebooks & pipelines").when(F.col("_c") == 0, "Source tables").when(F.col("_c") == F.col("_last"), "Output tables").otherwise("Tables")
    layer = columns.select("model_id", _key(F.lit("L"), "_c").alias("entity_id"), F.lit("layer").alias("kind"), name.alias("name"), _null("parent_id"))
    home = depth.select("model_id", F.col("node").alias("entity_id"), _key(F.lit("L"), "_c").alias("parent_id"))
    row = lambda df, i, k, n, p: df.select("model_id", i.alias("entity_id"), F.lit(k).alias("kind"), n.alias("name"), p.alias("parent_id"))
    leaf = parse_ref(ref)["table"]
    objects = step.select("model_id", sid.alias("entity_id"), F.col("step").alias("name")).union(table.select("model_id", tid, leaf)).join(home, ["model_id", "entity_id"])
    objects = objects.select("model_id", "entity_id", F.lit("object").alias("kind"), "name", "parent_id")
    schema = column.select("model_id", "ref", "column_name", "data_type").dropDuplicates(["model_id", "ref", "column_name"])
    accessed = cut(acc.join(schema, ["model_id", "ref"]))
    owned = schema.join(table, ["model_id", "ref"], "left_semi")
    iocol, tcol = _key(io, "column_name"), _key(F.lit("c"), F.lower(ref), "column_name")
    entity = layer.unionByName(objects).unionByName(row(acc, io, "attribute", leaf, sid)).unionByName(row(accessed, iocol, "attribute", F.col("column_name"), io))
    entity = entity.unionByName(row(owned, tcol, "attribute", F.col("column_name"), tid))

    def edge(df: DataFrame, here: Column, there: Column, what: str) -> DataFrame:
        return df.select(
            "model_id", F.lit(what).alias("what"), "access", "ref", *(["column_name"] if "column_name" in df.columns else [_null("column_name")]),
            F.when(reading, there).otherwise(here).alias("source"), F.when(reading, here).otherwise(there).alias("target"),
        )

    edges = edge(acc, io, tid, "table").unionByName(edge(accessed, iocol, tcol, "column"))
    edges = cut(edges.withColumn("transition_id", _key(F.lit("e"), "source", "target")))
    derived = first_flows(flow).select("model_id", F.col("to_table").alias("ref"), F.col("to_column").alias("column_name"), "from_table", "from_column", "transform", "via")
    told = edges.filter("what = 'column' and access = 'Write'").join(derived, ["model_id", "ref", "column_name"])
    source = F.concat_ws(".", parse_ref("from_table")["table"], "from_column")
    bag = lambda df, i, **kv: df.select("model_id", i.alias("entity_id"), F.inline(F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("key"), v.cast(TEXT).alias("value")) for k, v in kv.items()])))
    t = F.col("transition_id")
    props = bag(edges, t, Source=F.lit(CLAIM), Access=kind).unionByName(bag(told, t, Derives=source, Transform=F.col("transform"), Via=F.col("via")))
    props = props.unionByName(bag(acc, io, Access=kind)).unionByName(bag(accessed, iocol, Data_type=F.col("data_type"))).unionByName(bag(owned, tcol, Data_type=F.col("data_type")))
    word = F.when(F.col("kind") == "pipeline", "Pipeline").otherwise("Notebook")
    props = props.unionByName(bag(step, sid, Tags=F.concat(word, F.lit(", Step "), "ordinal"), Source=F.lit(CLAIM), Step=F.col("ordinal"), Workspace=F.nullif("workspace", F.lit(""))))
    filed = F.when(F.startswith(F.lower(leaf), F.lit("files/")), "File").otherwise("Table")
    props = props.unionByName(bag(table, tid, Tags=filed, Source=F.lit(CLAIM), Workspace=F.nullif(parse_ref(ref)["workspace"], F.lit(""))))
    return entity, edges.select("model_id", "transition_id", "source", "target"), props.filter("value is not null")


def staged_hops(access: DataFrame, column: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, transitions) of the semantic layouts: a step that both reads and writes becomes one row ``reads → writes`` that holds
    its tables' columns by name; both of its edges land on it. Column edges replace the table edge wherever there are columns."""
    acc = cut(access.select("model_id", "step", "access", "ref").distinct())
    leaf = parse_ref("ref")["table"]
    sides = acc.groupBy("model_id", "step").agg(
        *[F.array_join(F.sort_array(F.collect_set(F.when(F.col("access") == a, leaf))), ", ").alias(a) for a in ("Read", "Write")]
    )
    both = (F.col("Read") != "") & (F.col("Write") != "")
    placed = acc.join(sides, ["model_id", "step"]).withColumn(
        "row_id", F.when(both, _key(F.lit("hop"), "step")).otherwise(_key(F.lit("io"), "step", "access", "ref"))
    ).withColumn("row_name", F.when(both, F.concat_ws(" → ", "Read", "Write")).otherwise(F.concat(leaf, F.lit(" (staged)"))))
    sid = _key(F.lit("s"), "step")
    rows = placed.select("model_id", F.col("row_id").alias("entity_id"), F.col("row_name").alias("name"), sid.alias("parent_id")).distinct()
    schema = column.select("model_id", "ref", "column_name").distinct()
    cols = cut(placed.join(schema, ["model_id", "ref"]))
    inner = cols.select("model_id", _key("row_id", "column_name").alias("entity_id"), F.col("column_name").alias("name"), F.col("row_id").alias("parent_id")).distinct()
    reading = F.col("access") == "Read"
    tid, tcol, icol = _key(F.lit("t"), F.lower("ref")), _key(F.lit("c"), F.lower("ref"), "column_name"), _key("row_id", "column_name")
    ends = lambda df, here, there: df.select("model_id", F.when(reading, there).otherwise(here).alias("source"), F.when(reading, here).otherwise(there).alias("target"))
    bare = placed.join(schema.select("model_id", "ref").distinct(), ["model_id", "ref"], "left_anti")
    return rows.unionByName(inner), ends(cols, icol, tcol).union(ends(bare, F.col("row_id"), tid)).distinct()
