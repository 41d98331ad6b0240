"""Graph walks over transition tables, for all models and all starts at once.

Every walk is a loop of joins. A level is cut into the checkpoint folder, so the
plan stays one join deep whatever the number of levels, and a lost executor
re-reads a level instead of recomputing the walk.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.operators import depth
from heddle.session import Dealt, Passing, cut, cut_by, placed

M = "model_id"
#: Rows a task below which a level of a walk is moved again rather than dealt to a file a task.
SMALL = 2_000


def live_edges(transition: DataFrame, entity: DataFrame, by: str = "target") -> DataFrame:
    """Transitions whose two ends exist; the others take part in no walk. They come out dealt by `by`, "target" or "source", which what
    follows is keyed by, so that it need not move them again."""
    ids = entity.select(M, "entity_id")
    for end in ("source", "target") if by == "target" else ("target", "source"):
        transition = transition.join(ids.withColumnRenamed("entity_id", end), [M, end], "left_semi")
    return transition


def dangling(transition: DataFrame, entity: DataFrame) -> DataFrame:
    """Transitions with a missing end, with the end that is missing."""
    ids = entity.select(M, F.col("entity_id"), F.lit(True).alias("_there"))
    s = ids.select(M, F.col("entity_id").alias("source"), F.col("_there").alias("_s"))
    t = ids.select(M, F.col("entity_id").alias("target"), F.col("_there").alias("_t"))
    return (
        transition.join(s, [M, "source"], "left")
        .join(t, [M, "target"], "left")
        .filter(F.col("_s").isNull() | F.col("_t").isNull())
        .select(
            M,
            "transition_id",
            F.when(F.col("_s").isNull() & F.col("_t").isNull(), "both")
            .when(F.col("_s").isNull(), "source")
            .otherwise("target")
            .alias("missing"),
        )
    )


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(model, node, nxt) in walking direction: downstream, upstream or both."""
    move = lambda a, b: F.struct(F.col(a).alias("node"), F.col(b).alias("nxt"))
    down, up = move("source", "target"), move("target", "source")
    if direction == "downstream":  # renamed, not exploded: edges that are dealt by their node stay so
        return edges.select(M, F.col("source").alias("node"), F.col("target").alias("nxt")).distinct()
    if direction == "upstream":
        return edges.select(M, F.col("target").alias("node"), F.col("source").alias("nxt")).distinct()
    if direction == "both":
        return edges.select(M, F.inline(F.array(down, up))).distinct()
    raise ValueError(f"direction {direction!r} is none of downstream, upstream, both")


def _by(direction: str) -> str:
    """The end that a walk in this direction leaves from."""
    return "target" if direction == "upstream" else "source"


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def reachable(seeds: DataFrame, step: DataFrame | Dealt, max_hops: int | None = None) -> DataFrame:
    """(model, start, node, hops): every node reached from each start, with the
    start itself at 0 hops. `seeds` is (model, start, node), or (model, node) for one walk from all of
    them; `step` is oriented.

    Levels that are not small are stored dealt by their keys: what a round finds is moved to them, they are not moved to it."""
    if not isinstance(step, Dealt):
        step = Dealt(step, M, "node")
    keys = [c for c in (M, "start", "node") if c in seeds.columns]
    parts = int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    frontier = cut_by(seeds.select(*keys).distinct(), *keys)
    levels = [frontier.withColumn("hops", F.lit(0))]
    hops = 0
    while max_hops is None or hops < max_hops:
        hops += 1
        found = step.join(frontier).select(*keys[:-1], F.col("nxt").alias("node")).distinct()
        for level in levels:
            found = found.join(level.select(*keys), keys, "left_anti")
        frontier = cut_by(found, *keys) if frontier.count() > parts * SMALL else cut(found)
        if frontier.isEmpty():
            break
        levels.append(frontier.withColumn("hops", F.lit(hops)))
        if len(levels) > 12:
            levels = [cut_by(_union(levels), *keys)]
    return _union(levels)


def descendants(seeds: DataFrame, entity: DataFrame) -> DataFrame:
    """Seeds and everything contained in them: (model, start, node, hops)."""
    step = entity.filter(F.col("parent_id").isNotNull()).select(
        M, F.col("parent_id").alias("node"), F.col("entity_id").alias("nxt")
    )
    return reachable(seeds, step)


def ancestors(entity: DataFrame) -> DataFrame:
    """(model, entity, ancestor, distance), nearest first; an id is never its own ancestor."""
    step = entity.filter(F.col("parent_id").isNotNull()).select(
        M, F.col("entity_id").alias("node"), F.col("parent_id").alias("nxt")
    )
    seeds = entity.select(M, F.col("entity_id").alias("start"), F.col("entity_id").alias("node"))
    return (
        reachable(seeds, step)
        .filter("hops > 0")
        .select(M, F.col("start").alias("entity_id"), F.col("node").alias("ancestor_id"), F.col("hops").alias("distance"))
    )


def entity_paths(entity: DataFrame, up: DataFrame) -> DataFrame:
    """Addressing path of each entity: names from the object down, joined with
    ``/``; ``/`` and ``\\`` inside a name are escaped; layers have an empty path.
    `up` is what `ancestors` returned. A path is as long as the nesting is deep."""
    named = entity.select(M, F.col("entity_id").alias("ancestor_id"), "kind", "name")
    own = entity.select(M, "entity_id", "kind", "name", F.lit(0).alias("distance"))
    above = up.join(named, [M, "ancestor_id"]).select(M, "entity_id", "kind", "name", "distance")
    escaped = F.regexp_replace("name", r"([/\\])", r"\\$1")
    parts = own.union(above).filter("kind <> 'layer'").select(M, "entity_id", "distance", escaped.alias("name"))
    made = parts.groupBy(M, "entity_id").agg(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name")).alias("p"))
    return entity.select(M, "entity_id").join(
        made.select(M, "entity_id", F.array_join(F.sort_array("p")["name"], "/").alias("address")), [M, "entity_id"], "left"
    ).withColumn("address", F.coalesce("address", F.lit("")))


def impact_reach(starts: DataFrame, entity: DataFrame, transition: DataFrame, direction: str = "downstream") -> DataFrame:
    """(model, start, entity, layer_name): the complete reachable set of each start."""
    edges = live_edges(transition, entity, _by(direction))
    seeds = starts.select(M, "start", F.col("start").alias("node"))
    hit = reachable(seeds, oriented(edges, direction)).filter("hops > 0")
    layer = entity.select(M, F.col("entity_id").alias("node"), "layer_name")
    return hit.join(layer, [M, "node"]).select(M, "start", F.col("node").alias("entity_id"), "layer_name")


def impact_tally(reached: DataFrame) -> DataFrame:
    """Reached entities counted per start and layer."""
    layer = F.when(F.coalesce("layer_name", F.lit("")) == "", "(no layer)").otherwise(F.col("layer_name"))
    return reached.groupBy(M, "start", layer.alias("layer_name")).agg(F.count(F.lit(1)).alias("reached"))


def impact_list(reached: DataFrame, entity: DataFrame, limit: int | None = None) -> DataFrame:
    """The report list: reached entities per start by path, with the true total; all unless a `limit` is asked for."""
    named = reached.join(entity.select(M, "entity_id", "path"), [M, "entity_id"])
    total = reached.groupBy(M, "start").agg(F.count(F.lit(1)).alias("total"))
    ranked = placed(named, [M, "start"], ["path", "entity_id"], "position", limit)
    return ranked.join(total, [M, "start"]).select(M, "start", "position", "entity_id", "path", "total")


def impact_by_object(starts: DataFrame, entity: DataFrame, transition: DataFrame) -> DataFrame:
    """(model, start, holder, item): downstream of each start and its contents,
    each hit under the object that holds it; item is null when the hit is the holder."""
    edges = live_edges(transition, entity, "source")
    with Passing(entity.sparkSession) as here:
        inside = here.kept(descendants(starts.select(M, "start", F.col("start").alias("node")), entity).select(M, "start", "node"))
    hit = reachable(inside, oriented(edges, "downstream")).select(M, "start", "node").distinct().join(
        inside, [M, "start", "node"], "left_anti"
    )
    holder = entity.select(
        M,
        F.col("entity_id").alias("node"),
        F.when(F.col("kind") == "attribute", F.col("object_id")).otherwise(F.col("entity_id")).alias("holder_id"),
        F.when(F.col("kind") == "attribute", F.col("name")).alias("item"),
    )
    return hit.join(holder, [M, "node"]).select(M, "start", "holder_id", F.col("node").alias("entity_id"), "item")


def neighbourhood(seeds: DataFrame, entity: DataFrame, transition: DataFrame, direction: str = "both") -> DataFrame:
    """(model, start, entity): descend into the seeds, follow edges, add containers of what was reached."""
    edges = live_edges(transition, entity, _by(direction))
    with Passing(entity.sparkSession) as here:
        inside = descendants(seeds.select(M, "start", F.col("start").alias("node")), entity)
        touched = here.kept(reachable(inside.select(M, "start", "node"), oriented(edges, direction)).select(M, "start", "node").distinct())
    up = entity.filter(F.col("parent_id").isNotNull()).select(
        M, F.col("entity_id").alias("node"), F.col("parent_id").alias("nxt")
    )
    held = reachable(touched, up)
    return held.select(M, "start", F.col("node").alias("entity_id")).distinct()


def prune(keep: DataFrame, entity: DataFrame, transition: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The model reduced to kept ids: a kept entity needs every container kept,
    a layer needs a kept object, an edge needs both ends kept."""
    kept = entity.join(keep.select(M, "entity_id"), [M, "entity_id"], "left_semi")
    # The flattened table knows an attribute's layer, object and parent chain; an
    # attribute under a dropped group goes with it, one nesting level per pass.
    # An orphan in the incoming table (a parent id that is no row) is dropped too.
    while True:
        alive = kept.select(M, F.col("entity_id").alias("parent_id"))
        orphans = cut(kept.filter(F.col("parent_id").isNotNull()).join(alive, [M, "parent_id"], "left_anti"))
        if orphans.isEmpty():
            break
        kept = cut(kept.join(orphans.select(M, "entity_id"), [M, "entity_id"], "left_anti"))
    filled = kept.filter("kind = 'object'").select(M, F.col("parent_id").alias("entity_id")).distinct()
    kept = kept.filter("kind <> 'layer'").unionByName(
        kept.filter("kind = 'layer'").join(filled, [M, "entity_id"], "left_semi").select(*kept.columns)
    )
    ids = keep.select(M, "entity_id").distinct()
    edges = transition.join(ids.withColumnRenamed("entity_id", "source"), [M, "source"], "left_semi").join(
        ids.withColumnRenamed("entity_id", "target"), [M, "target"], "left_semi"
    )
    return kept, edges


def components(nodes: DataFrame, edges: DataFrame, group: str = M) -> DataFrame:
    """(group, node, component): smallest node id connected to the node, directions ignored.

    Edges are contracted: in a round every node joins the neighbour (or itself) that comes first in an order drawn anew by hash, and edges
    inside what has joined leave. That takes away a constant share of the nodes whatever the shape, so the rounds are few
    and each moves only the edges that are left. The first is a partial aggregate: a hub costs no more than its
    edges. Nodes find their component back through the rounds' tables.
    """
    nodes = nodes.select(group, "node").distinct()
    with Passing(nodes.sparkSession) as here:
        left = cut(edges.select(group, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).filter("a <> b").distinct())
        joins: list[DataFrame] = []
        while not left.isEmpty():
            place = lambda x, r=len(joins): F.struct(F.xxhash64(F.lit(r), F.col(x)).alias("at"), F.col(x).alias("to"))
            ends = F.inline(F.array(F.struct(F.col("a").alias("node"), place("b").alias("other")), F.struct(F.col("b").alias("node"), place("a").alias("other"))))
            first = left.select(group, ends).groupBy(group, "node").agg(F.min("other").alias("other"))
            joined = cut(first.select(group, "node", F.least("other", place("node"))["to"].alias("to")))
            joins.append(joined)
            ends = [joined.select(group, F.col("node").alias(x), F.col("to").alias(f"to_{x}")) for x in "ab"]
            moved = left.join(ends[0], [group, "a"]).join(ends[1], [group, "b"]).filter("to_a <> to_b")
            left = cut(moved.select(group, F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
        if not joins:
            return nodes.withColumn("component", F.col("node"))
        found = joins[-1]
        for joined in reversed(joins[:-1]):
            later = found.select(group, F.col("node").alias("to"), F.col("to").alias("_root"))
            found = joined.join(later, [group, "to"], "left").select(group, "node", F.coalesce("_root", "to").alias("to"))
        found = here.kept(found)
    least = found.groupBy(group, "to").agg(F.min(F.least("node", "to")).alias("component"))
    named = found.join(least, [group, "to"]).select(group, "node", "component")
    return nodes.join(named, [group, "node"], "left").select(group, "node", F.coalesce("component", "node").alias("component"))


def longest_path(nodes: DataFrame, edges: DataFrame, group: str = M, max_rounds: int | None = None) -> DataFrame:
    """(group, node, depth) as `depth.longest_path` has it."""
    return depth.longest_path(nodes, edges, group, max_rounds)


def _order(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}ordinal"), F.col(f"{prefix}hop"))


def _walk(
    entity: DataFrame, transition: DataFrame, direction: str, to_layer: str | None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, goals) of a trace: edges(model, node, nxt, hop, ordinal) in walking direction."""
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    edges = cut(live_edges(transition, entity).select(
        M, F.col(ends[0]).alias("node"), F.col(ends[1]).alias("nxt"), F.col("transition_id").alias("hop"), "ordinal"
    ))
    nodes = entity.select(M, F.col("entity_id").alias("node"))
    if to_layer is None:
        goals = nodes.join(edges.select(M, "node").distinct(), [M, "node"], "left_anti")
    else:
        goals = entity.filter(F.lower(F.trim("layer_name")) == to_layer.strip().lower()).select(
            M, F.col("entity_id").alias("node")
        )
    return edges, nodes, cut(goals)


def _steps(entity: DataFrame, transition: DataFrame, direction: str, to_layer: str | None) -> tuple[Dealt, DataFrame, DataFrame]:
    """(steps, nodes, goals) of a trace: steps(model, node, nxt, hop, ordinal, goal) are the edges in walking direction after which a goal can
    still be reached, with whether they lead to one, dealt by the node they leave.

    Edges are moved twice: to the end they arrive at, along which one sweep goes back for all starts, and, as far as that reached them,
    to the end they leave. An end that is missing where they leave is no goal and nothing arrives at it, so it can stay in the sweep.
    """
    ends = ("source", "target") if direction == "downstream" else ("target", "source")
    nodes = entity.select(M, F.col("entity_id").alias("node"))
    hop = [F.col("transition_id").alias("hop"), "ordinal"]
    arriving = transition.select(M, F.col(ends[1]).alias("node"), F.col(ends[0]).alias("nxt"), *hop)
    with Passing(entity.sparkSession) as here:
        back = Dealt(arriving.join(nodes, [M, "node"], "left_semi"), M, "node", among=arriving)
        if to_layer is None:
            goals = nodes.join(back.rows().select(M, F.col("nxt").alias("node")).distinct(), [M, "node"], "left_anti")
        else:
            goals = entity.filter(F.lower(F.trim("layer_name")) == to_layer.strip().lower()).select(
                M, F.col("entity_id").alias("node")
            )
        goals = here.kept(goals)
        alive = reachable(goals, back).filter("hops > 0")
        ahead = goals.withColumn("goal", F.lit(True)).union(alive.select(M, "node", F.lit(False)))
        found = back.join(ahead).select(M, F.col("nxt").alias("node"), F.col("node").alias("nxt"), "hop", "ordinal", "goal")
        leaving = transition.select(M, F.col(ends[0]).alias("node"))
        with here.outside():
            steps = Dealt(found.join(nodes, [M, "node"], "left_semi"), M, "node", among=leaving)
    return steps, nodes, goals


def trace_edges(
    starts: DataFrame, entity: DataFrame, transition: DataFrame, direction: str = "downstream", to_layer: str | None = None
) -> DataFrame:
    """(model, start, transition_id, node, nxt, goal): the edges on walks from each start to a goal, in walking
    direction. All paths run along these; there are at most as many per start as edges, however many paths."""
    step, nodes, goals = _steps(entity, transition, direction, to_layer)
    first = starts.select(M, "start").distinct().join(nodes.withColumnRenamed("node", "start"), [M, "start"], "left_semi")
    # A start that is a goal still goes on; any other goal ends the walk. No edge leaves a goal that is a sink.
    onward = step if to_layer is None else step.rows().join(goals, [M, "node"], "left_anti").select(M, "node", "nxt").distinct()
    begun = step.join(first.select(M, "start", F.col("start").alias("node")))
    met = reachable(begun.select(M, "start", F.col("nxt").alias("node")), onward).select(M, "start", "node")
    inner = met.join(goals, [M, "node"], "left_anti")
    passed = inner.unionByName(first.select(M, "start", F.col("start").alias("node"))).distinct()
    return (
        step.join(passed)
        .filter("nxt <> start")
        .select(M, "start", F.col("hop").alias("transition_id"), "node", "nxt", "goal")
    )


def _every_path(
    starts: DataFrame, step: Dealt, nodes: DataFrame, max_depth: int | None
) -> tuple[DataFrame, DataFrame]:
    """All simple paths, a level per round along edges that can still reach a goal: the `_steps` of the trace."""
    first = starts.select(M, "start").distinct().join(nodes.withColumnRenamed("node", "start"), [M, "start"], "left_semi")
    first = cut(first)
    frontier = first.select(
        M,
        "start",
        F.col("start").alias("node"),
        F.array("start").alias("nodes"),
        F.expr("cast(array() as array<struct<ordinal: bigint, hop: string>>)").alias("ord"),
    )
    found: list[DataFrame] = []
    late = first.limit(0)
    for depth in count():
        if depth == max_depth:
            late = frontier.select(M, "start").distinct()
            break
        level = cut(
            step.join(frontier)
            .filter(~F.array_contains("nodes", F.col("nxt")))
            .select(
                M,
                "start",
                F.col("nxt").alias("node"),
                F.concat("nodes", F.array("nxt")).alias("nodes"),
                F.concat("ord", F.array(_order())).alias("ord"),
                "goal",
            )
        )
        found.append(level.filter("goal").drop("goal"))
        frontier = level.filter("not goal").drop("goal")
        if frontier.isEmpty():
            break
    every = _union(found) if found else frontier.limit(0)
    if len(found) > 4:  # fewer levels are read where they lie
        every = cut(every)
    paths = placed(every, [M, "start"], ["ord"], "path_no", stored=True).select(M, "start", "path_no", "nodes", F.col("ord")["hop"].alias("hops"))
    totals = every.groupBy(M, "start").agg(F.count(F.lit(1)).alias("_n"))
    status = (
        first.join(totals, [M, "start"], "left")
        .join(late.withColumn("_late", F.lit(True)), [M, "start"], "left")
        .select(M, "start", F.coalesce("_n", F.lit(0)).alias("n_paths"), F.coalesce("_late", F.lit(False)).alias("truncated"))
    )
    return paths, status


def trace_paths(
    starts: DataFrame,
    entity: DataFrame,
    transition: DataFrame,
    direction: str = "downstream",
    to_layer: str | None = None,
    max_paths: int | None = None,
    max_depth: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Simple paths from each start to a goal, numbered in depth-first order; the first `max_paths` if that is given.

    Returns (paths, status): paths(model, start, path_no, nodes, hops) and
    status(model, start, n_paths, truncated).

    A goal is a sink of the walk, or the first entity of `to_layer`. Without
    bounds every path is found, and there can be exponentially many: `trace_edges`
    is the complete answer of bounded size. With `max_paths`, a partial
    path is dropped only when `max_paths` earlier ones are certain to be found:
    finished paths, or partial paths standing on a node that can reach no cycle
    and whose nearest goal lies inside the depth bound. What is dropped would
    have been visited after the last path, so it sets `truncated`.
    """
    if max_paths is None:
        with Passing(entity.sparkSession) as here:  # the levels of the walk are stored, and its steps not needed any more
            step, nodes, _ = _steps(entity, transition, direction, to_layer)
            with here.outside():
                return _every_path(starts, step, nodes, max_depth)
    edges, nodes, goals = _walk(entity, transition, direction, to_layer)
    back = edges.select(M, F.col("nxt").alias("node"), F.col("node").alias("nxt")).distinct()
    distance = (
        reachable(goals.select(M, F.lit("").alias("start"), "node"), back, max_depth)
        .groupBy(M, "node")
        .agg(F.min("hops").alias("to_goal"))
    )
    height = longest_path(
        edges.select(M, "node").union(edges.select(M, "nxt")),
        edges.select(M, F.col("nxt").alias("source"), F.col("node").alias("target")),
        max_rounds=max_depth,
    ).select(M, "node", F.lit(True).alias("acyclic"))
    looped = edges.filter("node = nxt").select(M, "node", F.lit(True).alias("_loop")).distinct()
    facts = cut(
        nodes.join(goals.withColumn("goal", F.lit(True)), [M, "node"], "left")
        .join(distance, [M, "node"], "left")
        .join(height, [M, "node"], "left")
        .join(looped, [M, "node"], "left")
        .select(
            M,
            "node",
            F.coalesce("goal", F.lit(False)).alias("goal"),
            F.when(F.col("acyclic") & F.col("_loop").isNull(), F.col("to_goal")).alias("sure"),
        )
    )
    step = edges.join(facts.select(M, F.col("node").alias("nxt"), "goal", "sure"), [M, "nxt"])
    # Of the children certain to give a path, only the first `max_paths` of a node matter.
    ranked = step.filter("sure is not null").withColumn(
        "_rank", F.row_number().over(W.partitionBy(M, "node").orderBy("ordinal", "hop"))
    )
    counts = step.filter("sure is not null").groupBy(M, "node").agg(F.count(F.lit(1)).alias("_n"))
    short = cut(
        ranked.filter(F.col("_rank") <= max_paths)
        .drop("_rank")
        .unionByName(step.filter("sure is null"))
        .join(counts.filter(F.col("_n") > max_paths).select(M, "node", F.lit(True).alias("more")), [M, "node"], "left")
    )
    deepest = facts.agg(F.max("sure")).first()[0] or 0
    bound = float("inf") if max_depth is None else max_depth

    first = starts.select(M, "start").distinct().join(nodes.withColumnRenamed("node", "start"), [M, "start"], "left_semi")
    frontier = cut(
        first.select(
            M,
            "start",
            F.col("start").alias("node"),
            F.array("start").alias("nodes"),
            F.expr("cast(array() as array<struct<ordinal: bigint, hop: string>>)").alias("ord"),
            F.lit(False).alias("goal"),
            F.lit(None).cast("int").alias("sure"),
        )
    )
    found: list[DataFrame] = []
    more: list[DataFrame] = []
    per_start = W.partitionBy(M, "start").orderBy("ord")
    for depth in count():
        done = frontier.filter("goal") if depth else frontier.limit(0)
        partial = frontier.filter("not goal") if depth else frontier
        if depth:
            found.append(done)
        if depth == bound:
            more.append(partial.select(M, "start").distinct())
            break
        if depth:
            certain = _union(
                [f.select(M, "start", "ord") for f in found]
                + [partial.filter(F.col("sure") <= F.lit(bound - depth)).select(M, "start", "ord")]
            )
            last = (
                certain.withColumn("_rank", F.row_number().over(per_start))
                .filter(F.col("_rank") <= max_paths)
                .groupBy(M, "start")
                .agg(F.max("ord").alias("_last"), F.count(F.lit(1)).alias("_n"))
                .filter(F.col("_n") == max_paths)
                .drop("_n")
            )
            judged = cut(
                partial.join(last, [M, "start"], "left").withColumn(
                    "_late", F.col("_last").isNotNull() & (F.col("ord") > F.col("_last"))
                ).drop("_last")
            )
            more.append(judged.filter("_late").select(M, "start").distinct())
            partial = judged.filter("not _late").drop("_late")
        exact = depth + 1 + deepest <= bound
        moves = short if exact else step.withColumn("more", F.lit(None).cast("boolean"))
        if exact:
            more.append(
                partial.join(short.filter("more").select(M, "node").distinct(), [M, "node"], "left_semi")
                .select(M, "start")
                .distinct()
            )
        frontier = cut(
            partial.drop("goal", "sure")
            .join(moves, [M, "node"])
            .filter(~F.array_contains("nodes", F.col("nxt")))
            .select(
                M,
                "start",
                F.col("nxt").alias("node"),
                F.concat("nodes", F.array("nxt")).alias("nodes"),
                F.concat("ord", F.array(_order())).alias("ord"),
                "goal",
                "sure",
            )
        )
        if frontier.isEmpty():
            break
    every = cut(_union(found)) if found else frontier
    kept = cut(
        every.withColumn("path_no", F.row_number().over(per_start))
        .filter(F.col("path_no") <= max_paths)
        .select(M, "start", "path_no", "nodes", F.col("ord")["hop"].alias("hops"))
    )
    totals = every.groupBy(M, "start").agg(F.count(F.lit(1)).alias("_n"))
    flags = _union(more).distinct().withColumn("_more", F.lit(True)) if more else first.limit(0).withColumn("_more", F.lit(True))
    status = (
        first.join(totals, [M, "start"], "left")
        .join(flags, [M, "start"], "left")
        .select(
            M,
            "start",
            F.least(F.coalesce("_n", F.lit(0)), F.lit(max_paths)).alias("n_paths"),
            (F.coalesce("_more", F.lit(False)) | (F.coalesce("_n", F.lit(0)) > max_paths)).alias("truncated"),
        )
    )
    return kept, status


def trace_hops(paths: DataFrame, transition: DataFrame, prop: DataFrame) -> DataFrame:
    """One row per hop, always in edge direction, with what is recorded about the edge."""
    wanted = (
        prop.filter(F.col("key").isin("Transform", "Source", "Via"))
        .groupBy(M, F.col("entity_id").alias("transition_id"))
        .agg(
            F.max(F.when(F.col("key") == "Transform", F.nullif("value", F.lit("")))).alias("transform"),
            F.max(F.when(F.col("key") == "Source", F.nullif("value", F.lit("")))).alias("claim"),
            F.max(F.when(F.col("key") == "Via", F.nullif("value", F.lit("")))).alias("via"),
        )
    )
    hops = paths.select(M, "start", "path_no", F.posexplode("hops").alias("hop_no", "transition_id"))
    return (
        hops.join(transition.select(M, "transition_id", "source", "target"), [M, "transition_id"])
        .join(wanted, [M, "transition_id"], "left")
        .withColumn("derived", F.col("claim").isNotNull())
    )


def trace_levels(paths: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Level of each path and of each start: attribute, object or mixed."""
    kinds = entity.select(M, F.col("entity_id").alias("node"), "kind")
    seen = paths.select(M, "start", "path_no", F.explode("nodes").alias("node")).join(kinds, [M, "node"])

    def level(kind: str) -> Column:
        low, high = F.min(kind), F.max(kind)
        return F.when((low == high) & low.isin("attribute", "object"), low).otherwise("mixed").alias("level")

    per_path = seen.groupBy(M, "start", "path_no").agg(level("kind"))
    # Where every entity has a kind, so has every path, and a start's level is that of all the nodes on its paths.
    if entity.filter("kind is null").isEmpty():
        return per_path, seen.groupBy(M, "start").agg(level("kind"))
    return per_path, per_path.groupBy(M, "start").agg(level("level"))


def trace_with_fallback(
    starts: DataFrame, entity: DataFrame, transition: DataFrame, direction: str = "downstream", **bounds
) -> tuple[DataFrame, DataFrame]:
    """Paths at the start's own level, else those of the object that owns it.

    status adds `answered`: own, object, cut_short (stopped before finding any)
    or none — a search limit is never reported as an absence of lineage.
    """
    if bounds.get("max_paths") is None:  # both traces go along the same steps
        with Passing(entity.sparkSession) as here:
            step, nodes, _ = _steps(entity, transition, direction, bounds.get("to_layer"))
            with here.outside():
                return _with_fallback(lambda begin: _every_path(begin, step, nodes, bounds.get("max_depth")), starts, entity)
    return _with_fallback(lambda begin: trace_paths(begin, entity, transition, direction, **bounds), starts, entity)


def _with_fallback(trace: Callable[[DataFrame], tuple[DataFrame, DataFrame]], starts: DataFrame, entity: DataFrame) -> tuple[DataFrame, DataFrame]:
    paths, status = trace(starts)
    status = cut(status)
    empty = status.filter("n_paths = 0").join(
        entity.filter("kind = 'attribute' and object_id is not null").select(
            M, F.col("entity_id").alias("start"), "object_id"
        ),
        [M, "start"],
    )
    owners = cut(empty.select(M, "start", F.col("object_id").alias("owner")))
    second, second_status = trace(owners.select(M, F.col("owner").alias("start")).distinct())
    borrowed = owners.join(second.withColumnRenamed("start", "owner"), [M, "owner"]).drop("owner")
    coarser = owners.join(
        second_status.filter("n_paths > 0").select(
            M, F.col("start").alias("owner"), F.col("n_paths").alias("_n"), F.col("truncated").alias("_t")
        ),
        [M, "owner"],
    ).drop("owner")
    answer = status.join(coarser, [M, "start"], "left").select(
        M,
        "start",
        F.coalesce("_n", "n_paths").alias("n_paths"),
        F.coalesce("_t", "truncated").alias("truncated"),
        F.when(F.col("n_paths") > 0, "own")
        .when(F.col("_n").isNotNull(), "object")
        .when(F.col("truncated"), "cut_short")
        .otherwise("none")
        .alias("answered"),
    )
    return paths.unionByName(borrowed), answer
