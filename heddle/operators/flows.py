"""Composition of column lineage: set algebra over flows and frames.

A flow is (scope, to_table, to_column, from_table, from_column, transform); a null
from_table means the owner is not known, never that there is none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.refs import ref_parts
from heddle.session import cut, join_hot, running_last

FLOW_KEY = ["to_table", "to_column", "from_table", "from_column"]


# --- views ------------------------------------------------------------------

def _views(view: DataFrame) -> DataFrame:
    """(nb_id, source_name, _good): every view once, as what reads it names it, with whether it is resolved."""
    return view.groupBy("nb_id", F.col("view_key").alias("source_name")).agg(F.coalesce(F.max("resolved"), F.lit(False)).alias("_good"))


def first_steps(view_flow: DataFrame, views: DataFrame) -> DataFrame:
    """The flows of views that do not read an unresolved one, with `_good` where they read a view. `_via` holds the views on a way behind its own."""
    one = view_flow.join(views, ["nb_id", "source_name"], "left").filter("_good is null or _good")
    return one.withColumn("_via", F.array().cast("array<string>"))


def _ways_down(view_flow: DataFrame, views: DataFrame) -> DataFrame:
    """(nb_id, view_key, column, source_name, source_column, transform) as `view_closure` has it, also for a view that is unresolved or unknown
    itself: who reads a view asks whether it is resolved, so that rows need not be moved to ask it here.

    The relation is composed with itself: ways of 1, 2, 4, ... steps that still end in a view are put in front of all ways
    down that are known, so views on views of any depth take a logarithmic number of rounds.
    """
    one = cut(first_steps(view_flow, views))
    row = ["nb_id", "view_key", "column", "source_name", "source_column", "transform", "_via"]
    down = one.filter("_good is null").select(*row)
    still = one.filter("_good").select(*row)
    while not still.isEmpty():
        inner = lambda rows: rows.select("nb_id", F.col("view_key").alias("source_name"), F.col("column").alias("source_column"), *[F.col(x).alias(f"_{x}_") for x in ("source_name", "source_column", "transform", "_via")])
        ends = inner(down).withColumn("_ends", F.lit(True)).unionByName(inner(still).withColumn("_ends", F.lit(False)))
        own, behind = F.concat("_via", F.array("view_key")), F.concat("__via_", F.array("source_name"))
        met = still.join(ends, ["nb_id", "source_name", "source_column"]).filter(~F.arrays_overlap(own, behind))
        met = cut(met.select("nb_id", "view_key", "column", F.col("_source_name_").alias("source_name"), F.col("_source_column_").alias("source_column"), F.coalesce("transform", "_transform_").alias("transform"), F.concat("_via", behind).alias("_via"), "_ends"))
        down = down.unionByName(met.filter("_ends").select(*row))
        still = met.filter("not _ends").select(*row)
    return down.drop("_via")


def view_closure(view_flow: DataFrame, view: DataFrame) -> DataFrame:
    """(nb_id, view_key, column, source_name, source_column, transform): what each column of a resolved view comes to in base tables, one row
    for each way down, with the first transform on it. A way that passes a view twice, or an unresolved one, accounts for nothing."""
    views = _views(view)
    good = views.filter("_good").select("nb_id", F.col("source_name").alias("view_key"))
    return _ways_down(view_flow, views).join(good, ["nb_id", "view_key"], "left_semi")


def flatten_views(flow: DataFrame, view_flow: DataFrame, view: DataFrame) -> DataFrame:
    """Replace view sources by the base tables underneath, views on views included.

    `flow` is (nb_id, target, column, source_name, source_column, transform). What a
    view cannot account for, and what comes from an unresolved view, contributes
    nothing. An outer passthrough inherits the first transform on the way down.
    A view that leads back to itself accounts for nothing.
    """
    views = _views(view)
    read = cut(flow.join(views, ["nb_id", "source_name"], "left").filter("_good is null or _good"))
    base, outer = read.filter("_good is null"), read.filter("_good")
    under = _ways_down(view_flow, views).select("nb_id", F.col("view_key").alias("source_name"), F.col("column").alias("source_column"), F.col("source_name").alias("_name"), F.col("source_column").alias("_column"), F.col("transform").alias("_transform"))
    found = outer.join(under, ["nb_id", "source_name", "source_column"]).select(
        "nb_id", "target", "column", F.col("_name").alias("source_name"), F.col("_column").alias("source_column"), F.coalesce("transform", "_transform").alias("transform")
    )
    return base.select(*found.columns).unionByName(found)


def view_base_refs(view_flow: DataFrame, view: DataFrame) -> DataFrame:
    """(nb_id, view_key, ref): the tables that reading a view reads."""
    return view_closure(view_flow, view).select("nb_id", "view_key", F.col("source_name").alias("ref")).distinct()


# --- frames -----------------------------------------------------------------
# A frame is rows (nb_id, frame_id, ordinal, column, sources, transform), sources an
# array of (src_ref, src_col): as long as one column has inputs.

FRAME = ["nb_id", "frame_id", "ordinal", "column", "sources", "transform"]
PAIRS = "array<struct<src_ref: string, src_col: string>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {PAIRS})")


def feed(op: DataFrame, frame: DataFrame) -> DataFrame:
    """Columns of each operation's inputs under the operation's own frame id; `_side` 0 is left."""
    wanted = op.select("nb_id", "frame_id", "op", "args", F.explode(F.array(
        F.struct(F.lit(0).alias("_side"), F.col("input_frame").alias("_in")),
        F.struct(F.lit(1).alias("_side"), F.col("input_frame2").alias("_in")),
    )).alias("_i")).select("nb_id", "frame_id", "op", "args", "_i.*").filter("_in is not null")
    return join_hot(wanted, frame.withColumnRenamed("frame_id", "_in"), ["nb_id", "_in"]).drop("_in")


def join_frames(fed: DataFrame) -> DataFrame:
    """Left columns, then the right's new ones; a shared name carries both sides' sources."""
    out = fed.groupBy("nb_id", "frame_id", "column").agg(
        F.min(F.struct("_side", "ordinal")).alias("_o"),
        F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        F.max(F.when(F.col("_side") == 0, F.col("transform"))).alias("transform"),
    )
    # A window over the columns of one frame: as wide as a table is.
    place = F.row_number().over(W.partitionBy("nb_id", "frame_id").orderBy("_o"))
    return out.withColumn("ordinal", place).select(*FRAME)


def union_frames(fed: DataFrame) -> DataFrame:
    """The left's columns with the right's sources, matched by name (unionByName) or by
    place (union); a union by place of unequal widths abstains, i.e. gives no rows."""
    frame = W.partitionBy("nb_id", "frame_id")
    rows = fed.select(
        "*",
        F.row_number().over(W.partitionBy("nb_id", "frame_id", "_side").orderBy("ordinal")).alias("_place"),
        F.count_if(F.col("_side") == 0).over(frame).alias("_l"),
        F.count_if(F.col("_side") == 1).over(frame).alias("_r"),
    ).filter("op = 'unionByName' or _l = _r")
    key = F.when(F.col("op") == "unionByName", F.col("column")).otherwise(F.col("_place").cast("string"))
    left = F.col("_side") == 0
    return (
        rows.groupBy("nb_id", "frame_id", key.alias("_key"))
        .agg(
            *[F.max(F.when(left, F.col(c))).alias(c) for c in ("ordinal", "column", "transform")],
            F.array_distinct(F.flatten(F.collect_list("sources"))).alias("sources"),
        )
        .filter("column is not null")
        .select(*FRAME)
    )


def project_frames(op: DataFrame, fed: DataFrame) -> DataFrame:
    """select, and groupBy + agg: the named outputs in order, unnamed ones dropped; a name
    given twice keeps its first place and its last meaning."""
    arg = op.select("nb_id", "frame_id", F.posexplode("args").alias("_pos", "_a")).filter("_a.out is not null")
    arg = arg.select("nb_id", "frame_id", "_pos", "_a.out", "_a.expr", F.explode_outer("_a.refs").alias("column"))
    named = arg.join(
        fed.select("nb_id", "frame_id", "column", F.col("sources").alias("_s")), ["nb_id", "frame_id", "column"], "left"
    )
    per_arg = named.groupBy("nb_id", "frame_id", "out", "_pos").agg(
        F.array_distinct(F.flatten(F.collect_list(F.coalesce("_s", _none())))).alias("sources"), F.max("expr").alias("transform")
    )
    last = F.max(F.struct("_pos", "sources", "transform")).alias("_l")
    one = per_arg.groupBy("nb_id", "frame_id", F.col("out").alias("column")).agg(F.min("_pos").alias("ordinal"), last)
    return one.select("nb_id", "frame_id", "ordinal", "column", "_l.sources", "_l.transform")


def single_input_frames(fed: DataFrame) -> DataFrame:
    """filter-like operations, withColumn, rename and drop; a rename of a column that is not there gives no rows."""
    arg = F.get("args", F.lit(0))
    given = fed.select("*", arg["out"].alias("_out"), arg["expr"].alias("_expr"), arg["refs"].alias("_refs"))
    named = F.array_contains("_refs", F.col("column"))
    has = F.max(named).over(W.partitionBy("nb_id", "frame_id"))
    given = given.withColumn("_has", has).filter("op <> 'rename' or _has")
    renamed = (F.col("op") == "rename") & named
    mine = F.col("column") == F.col("_out")
    kept = given.filter(~((F.col("op") == "drop") & named) & ~((F.col("op") == "withColumn") & mine)).withColumn(
        "column", F.when(renamed, F.col("_out")).otherwise(F.col("column"))
    )
    added = (
        given.filter("op = 'withColumn'")
        .groupBy("nb_id", "frame_id", F.col("_out").alias("_name"))
        .agg(
            F.coalesce(F.max(F.when(mine, F.col("ordinal"))), F.max("ordinal") + 1).alias("ordinal"),
            F.array_distinct(F.flatten(F.collect_list(F.when(named, F.col("sources"))))).alias("sources"),
            F.coalesce(F.max("_expr"), F.max(F.when(mine, F.col("transform")))).alias("transform"),
        )
    )
    return kept.select(*FRAME).unionByName(added.withColumnRenamed("_name", "column").select(*FRAME))


PASSTHROUGH = "passthrough"
KNOWN_OPS = (PASSTHROUGH, "select", "groupAgg", "withColumn", "rename", "drop", "join", "union", "unionByName")


def frame_provenance(frame_op: DataFrame, table_column: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provenance of every frame of an operation log, all notebooks at once.

    `frame_op` is (nb_id, frame_id, op, input_frame, input_frame2, args), args an array of
    (out, expr, refs). `read` takes the table's columns (input_frame is the ref). Returns
    (frames, unknown): an operation that cannot be followed makes its frame unknown, and
    with it everything built on that frame. One round per level of the longest chain.
    """
    ops = cut(frame_op)
    columns = table_column.select(
        F.col("ref").alias("input_frame"),
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("column_name").alias("column"),
        F.array(F.struct(F.col("ref").alias("src_ref"), F.col("column_name").alias("src_col"))).alias("sources"),
        F.lit(None).cast("string").alias("transform"),
    )
    frames = cut(ops.filter("op = 'read'").select("nb_id", "frame_id", "input_frame").join(columns, "input_frame").select(*FRAME))
    # A key without a name would need a generated one; such a grouping is unknown.
    broken = (~F.col("op").isin(*KNOWN_OPS)) | (
        (F.col("op") == "groupAgg") & F.exists("args", lambda a: a["out"].isNull() & (a["expr"] == "key"))
    )
    sound = ops.filter("op <> 'read'").filter(~broken)
    present = {r[0] for r in sound.select("op").distinct().collect()}  # at most the nine known verbs
    single, chosen = F.col("op").isin(PASSTHROUGH, "withColumn", "rename", "drop"), F.col("op").isin("select", "groupAgg")
    out = [frames]
    while True:
        pool = reduce(DataFrame.unionByName, out)
        known = pool.select("nb_id", "frame_id").distinct()
        ready = sound.join(known, ["nb_id", "frame_id"], "left_anti").join(
            known.withColumnRenamed("frame_id", "input_frame"), ["nb_id", "input_frame"], "left_semi"
        )
        second = known.select("nb_id", F.col("frame_id").alias("input_frame2"), F.lit(True).alias("_second"))
        ready = ready.join(second, ["nb_id", "input_frame2"], "left").filter("input_frame2 is null or _second")
        fed = cut(feed(ready, pool))
        parts = []
        if present & {PASSTHROUGH, "withColumn", "rename", "drop"}:
            parts.append(single_input_frames(fed.filter(single)))
        if present & {"select", "groupAgg"}:
            mine = sound.filter(chosen).join(fed.select("nb_id", "frame_id").distinct(), ["nb_id", "frame_id"], "left_semi")
            parts.append(project_frames(mine, fed.filter(chosen)))
        if "join" in present:
            parts.append(join_frames(fed.filter("op = 'join'")))
        if present & {"union", "unionByName"}:
            parts.append(union_frames(fed.filter("op in ('union', 'unionByName')")))
        if not parts:
            break
        made = cut(reduce(DataFrame.unionByName, [p.select(*FRAME) for p in parts]))
        if made.isEmpty():
            break
        out.append(made)
        if len(out) > 8:
            out = [cut(reduce(DataFrame.unionByName, out))]
    frames = reduce(DataFrame.unionByName, out)
    known = frames.select("nb_id", "frame_id").distinct()
    unknown = ops.select("nb_id", "frame_id").join(known, ["nb_id", "frame_id"], "left_anti")
    return frames, unknown


def frame_flows(frames: DataFrame) -> DataFrame:
    """One row per column and source; a column without a source keeps a row with nulls."""
    return frames.select("nb_id", "frame_id", "ordinal", "column", "transform", F.explode_outer("sources").alias("_s")).select(
        "nb_id", "frame_id", "ordinal", "column", "_s.src_ref", "_s.src_col", "transform"
    )


# --- statements -------------------------------------------------------------

def merge_star(statement: DataFrame, table_column: DataFrame) -> DataFrame:
    """SET * / INSERT *: every source column into its namesake; only columns the target has, when its schema is known.
    `statement` is (stmt_id, target_ref, source_ref)."""
    cols = table_column.select("ref", "column_name")
    fed = join_hot(statement, cols.withColumnRenamed("ref", "source_ref"), ["source_ref"])
    has = cols.select(F.col("ref").alias("target_ref"), "column_name", F.lit(True).alias("_has"))
    known = cols.select(F.col("ref").alias("target_ref"), F.lit(True).alias("_known")).distinct()
    checked = fed.join(has, ["target_ref", "column_name"], "left").join(known, "target_ref", "left")
    return checked.filter("_known is null or _has").select(
        "stmt_id",
        F.col("target_ref").alias("to_table"),
        F.col("column_name").alias("to_column"),
        F.col("source_ref").alias("from_table"),
        F.col("column_name").alias("from_column"),
        F.lit(None).cast("string").alias("transform"),
    ).distinct()


def merge_assignments(assignment: DataFrame, alias: DataFrame) -> DataFrame:
    """Explicit MERGE assignments. `assignment` is (stmt_id, ordinal, target_ref, to_column, expr, is_column,
    refs array of (alias, column), n_columns, n_values); `alias` (stmt_id, alias, ref). An unqualified or
    unknown alias leaves the owner null; an INSERT of unequal widths is dropped whole."""
    paired = assignment.filter("coalesce(to_column, '') <> '' and n_columns <=> n_values")
    one = paired.select(
        "stmt_id",
        "ordinal",
        F.col("target_ref").alias("to_table"),
        "to_column",
        F.when(~F.col("is_column"), F.col("expr")).alias("transform"),
        F.explode("refs").alias("_r"),
    ).select("*", "_r.alias", F.col("_r.column").alias("from_column")).drop("_r")
    owned = one.join(alias.select("stmt_id", "alias", F.col("ref").alias("from_table")), ["stmt_id", "alias"], "left")
    return dedup(owned.drop("alias"), ["stmt_id"])


def write_only(access: DataFrame) -> DataFrame:
    """UPDATE and DELETE: table access only; the target is not among the reads."""
    rows = access.filter("verb in ('update', 'delete')")
    target = rows.filter("access = 'write'").select("stmt_id", "ref")
    reads = rows.filter("access = 'read'").select("stmt_id", "ref").distinct().join(target, ["stmt_id", "ref"], "left_anti")
    return reads.select("stmt_id", F.lit("read").alias("access"), "ref").union(
        target.distinct().select("stmt_id", F.lit("write").alias("access"), "ref")
    )


def dedup(flow: DataFrame, scope: list[str]) -> DataFrame:
    """One row per edge, with the transform of the first one."""
    first = F.min(F.struct("ordinal", "transform")).alias("_f")
    return flow.groupBy(*scope, *FLOW_KEY).agg(first).select(*scope, *FLOW_KEY, F.col("_f.transform").alias("transform"))


def prefer_statements(flow: DataFrame) -> DataFrame:
    """Where a statement already resolved a target, flows reasoned from a frame chain are discarded for it."""
    resolved = flow.filter("engine = 'sql'").select("nb_id", "to_table").distinct()
    chain = flow.filter("engine <> 'sql'").join(resolved, ["nb_id", "to_table"], "left_anti")
    return flow.filter("engine = 'sql'").unionByName(chain.select(*flow.columns))


def resolve_owner(flow: DataFrame, reads: DataFrame, table_column: DataFrame) -> DataFrame:
    """Null owners by name: the one read table of the run that has the column; none or several leave it null."""
    having = reads.select("run_id", "ref").distinct().join(table_column.select("ref", F.col("column_name").alias("from_column")), "ref")
    only = (
        having.groupBy("run_id", "from_column")
        .agg(F.min("ref").alias("_owner"), F.max("ref").alias("_last"))
        .filter("_owner = _last")
        .drop("_last")
    )
    return flow.join(only, ["run_id", "from_column"], "left").withColumn("from_table", F.coalesce("from_table", "_owner")).drop("_owner")


def attribute_flows(output: DataFrame, expression: DataFrame, owner: DataFrame) -> DataFrame:
    """Output columns to source relations by attribute id.

    `output` is (plan_id, column, attr_id); `expression` (plan_id, column, expr, refs array of (attr_id, name));
    `owner` (plan_id, attr_id, ref). A computed column lists every attribute it references, owned or not,
    and beats a passthrough; a passthrough needs an owned id. Other columns get no edge at all.
    """
    refs = expression.filter(F.size("refs") > 0)
    single = (F.size("refs") == 1) & (F.get("refs", F.lit(0))["name"] == F.col("column"))
    computed = (
        refs.select("plan_id", "column", F.when(~single, F.col("expr")).alias("transform"), F.explode("refs").alias("_r"))
        .select("plan_id", "column", "transform", "_r.attr_id", F.col("_r.name").alias("from_column"))
        .join(owner.select("plan_id", "attr_id", F.col("ref").alias("from_table")), ["plan_id", "attr_id"], "left")
        .select("plan_id", F.col("column").alias("to_column"), "from_table", "from_column", "transform")
        .distinct()
    )
    carried = (
        output.join(refs.select("plan_id", "column").distinct(), ["plan_id", "column"], "left_anti")
        .join(owner.select("plan_id", "attr_id", F.col("ref").alias("from_table")), ["plan_id", "attr_id"])
        .select("plan_id", F.col("column").alias("to_column"), "from_table", F.col("column").alias("from_column"), F.lit(None).cast("string").alias("transform"))
        .distinct()
    )
    return computed.unionByName(carried)


# --- schemas ----------------------------------------------------------------

def output_schema(output: DataFrame, given: DataFrame) -> DataFrame:
    """Columns of written tables: all outputs in the order first seen, also untraced ones;
    a schema that was supplied is never overwritten. `output` is (run_id, ref, ordinal, column_name)."""
    fresh = output.join(given.select("run_id", "ref").distinct(), ["run_id", "ref"], "left_anti")
    return fresh.groupBy("run_id", "ref", "column_name").agg(F.min("ordinal").alias("ordinal"))


def carry_schemas(requested: DataFrame, seen: DataFrame, live: DataFrame) -> DataFrame:
    """(sequence_id, step, ref, status, from_step) per requested read.

    `requested` is (sequence_id, step, ref); `seen` (sequence_id, step, ref) the schemas a step observed,
    non-empty ones; `live` (sequence_id, step, ref) what the live lookup answered. Live is never overridden;
    a gap takes the schema of the latest earlier step.
    """
    answered = live.select("sequence_id", "step", "ref").distinct().withColumn("_live", F.lit(True))
    earlier = seen.select("sequence_id", "ref", F.col("step").alias("_from")).distinct()
    gap = requested.distinct().join(answered, ["sequence_id", "step", "ref"], "left")
    # As-of: a read and the observations of its table in one order, the last observation before it.
    events = gap.filter("_live is null").select("sequence_id", "ref", "step", F.lit(1).alias("_kind"), F.lit(None).cast("int").alias("_from")).unionByName(
        earlier.select("sequence_id", "ref", F.col("_from").alias("step"), F.lit(2).alias("_kind"), F.col("_from").cast("int").alias("_from"))
    )
    carried = running_last(events, ["sequence_id", "ref"], ["step", "_kind"], "_from", "from_step").filter("_kind = 1")
    filled = carried.select(
        "sequence_id", "step", "ref", F.when(F.col("from_step").isNotNull(), "carried").otherwise("unresolved").alias("status"), "from_step"
    )
    return gap.filter("_live").select(
        "sequence_id", "step", "ref", F.lit("resolved").alias("status"), F.lit(None).cast("int").alias("from_step")
    ).unionByName(filled)


def lookup_schemas(refs: DataFrame, spaces: DataFrame, dirs: DataFrame) -> DataFrame:
    """(nb_id, ref, workspace_id, table_dir, reason): where each read table's schema is to be found.

    `refs` is (nb_id, workspace_id, ref) with the notebook's own workspace; `spaces` (key, workspace_id) by
    lower-cased name and id; `dirs` (workspace_id, short, table_dir). File refs are not looked up; a foreign
    workspace is the ref's own, an unknown one falls back to the notebook's. Every miss says why.
    """
    parts = refs.distinct().withColumn("_p", ref_parts("ref")).filter("_p.kind = 'table'")
    keyed = parts.select("nb_id", "workspace_id", "ref", F.lower("_p.workspace").alias("key"), F.lower("_p.table").alias("short"))
    placed = keyed.join(spaces.select("key", F.col("workspace_id").alias("_ws")), "key", "left").withColumn(
        "workspace_id", F.coalesce(F.when(F.col("key") != "", F.col("_ws")), "workspace_id")
    )
    found = placed.join(dirs, ["workspace_id", "short"], "left")
    reason = F.when(F.coalesce("workspace_id", F.lit("")) == "", "workspace could not be resolved to an id").when(
        F.col("table_dir").isNull(), F.concat(F.lit("no table of that name in workspace "), "workspace_id")
    )
    return found.select("nb_id", "ref", "workspace_id", "table_dir", reason.alias("reason"))
