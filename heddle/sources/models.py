"""Model documents and sheets: nested JSON to flat tables, bundles, tabular import."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.graph import M
from heddle.session import cut, join_hot, running_position

# --- nested documents -----------------------------------------------------------

MODEL = (
    "layers array<struct<id: string, name: string, objects: array<struct<id: string, name: string, children: array<string>>>>>, "
    "transitions array<struct<id: string, source: string, target: string>>, properties map<string, map<string, string>>"
)
#: Nesting levels of attributes that one pass over their JSON unfolds.
LEVELS = 4


def _attribute_type(levels: int) -> str:
    """Attributes nested `levels` deep; what is deeper stays JSON text for the next pass."""
    inner = "array<string>"
    for _ in range(levels):
        inner = f"array<struct<id: string, name: string, children: {inner}>>"
    return inner


ENTITY = [M, "entity_id", "kind", "name", "parent_id", "depth", "layer_id", "layer_name", "object_id", "object_name", "has_children", "ordinal", "trail"]


def flatten(doc: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, transitions, properties) of model documents (model_id, doc), attributes nested to any depth.

    `trail` is the names from the layer down; `ordinal` the places on the way down, so that its order is document order.
    """
    d = cut(doc.select(M, F.from_json("doc", MODEL).alias("d")))
    layer = d.select(M, F.posexplode("d.layers").alias("_l", "x")).select(
        M, F.array("_l").alias("ordinal"), F.col("x.id").alias("layer_id"), F.col("x.name").alias("layer_name"), F.col("x.objects").alias("_o")
    )
    text = F.lit(None).cast("string")
    layers = layer.select(
        M, F.col("layer_id").alias("entity_id"), F.lit("layer").alias("kind"), F.col("layer_name").alias("name"), text.alias("parent_id"), F.lit(0).alias("depth"), "layer_id",
        "layer_name", text.alias("object_id"), text.alias("object_name"), (F.size(F.coalesce("_o", F.array())) > 0).alias("has_children"), "ordinal", F.array("layer_name").alias("trail"),
    )
    obj = layer.select("*", F.posexplode("_o").alias("_p", "x"))
    objects = obj.select(
        M, F.col("x.id").alias("entity_id"), F.lit("object").alias("kind"), F.col("x.name").alias("name"), F.col("layer_id").alias("parent_id"), F.lit(1).alias("depth"), "layer_id",
        "layer_name", F.col("x.id").alias("object_id"), F.col("x.name").alias("object_name"), (F.size(F.coalesce("x.children", F.array())) > 0).alias("has_children"),
        F.concat("ordinal", F.array("_p")).alias("ordinal"), F.array("layer_name", "x.name").alias("trail"), F.col("x.children").alias("_json"),
    )
    parts = [layers.select(*ENTITY), objects.select(*ENTITY)]
    schema = _attribute_type(LEVELS)
    parsed = lambda c: F.from_json(F.concat(F.lit("["), F.array_join(c, ","), F.lit("]")), schema)
    pending = cut(objects.filter("has_children").withColumn("_c", parsed("_json")).drop("_json"))
    while not pending.isEmpty():
        rows = pending
        for level in range(LEVELS):
            one = rows.select("*", F.posexplode("_c").alias("_p", "_x")).select(
                M, F.col("_x.id").alias("entity_id"), F.lit("attribute").alias("kind"), F.col("_x.name").alias("name"), F.col("entity_id").alias("parent_id"),
                (F.col("depth") + 1).alias("depth"), "layer_id", "layer_name", "object_id", "object_name", (F.size(F.coalesce("_x.children", F.array())) > 0).alias("has_children"),
                F.concat("ordinal", F.array("_p")).alias("ordinal"), F.array_append("trail", F.col("_x.name")).alias("trail"), F.col("_x.children").alias("_c"),
            )
            parts.append(one.select(*ENTITY))
            rows = one.filter("has_children")
        pending = cut(rows.withColumn("_c", parsed("_c")))
    edges = d.select(M, F.posexplode("d.transitions").alias("ordinal", "t")).select(M, F.col("t.id").alias("transition_id"), "t.source", "t.target", "ordinal")
    bags = d.select(M, F.explode("d.properties").alias("entity_id", "_b")).select(M, "entity_id", F.explode("_b").alias("key", "value"))
    return reduce(DataFrame.unionByName, parts), edges, bags


def bundle_models(bundle: DataFrame, now: int) -> DataFrame:
    """(bundle_id, model_id, created_at, updated_at, name, doc) of bundle files (bundle_id, doc): one model, an array of them, or
    ``{models: [...]}``; values with a name, layers and transitions are kept and get a fresh id and new stamps."""
    shape = F.trim("doc")
    listed = F.when(F.startswith(shape, F.lit("[")), F.from_json("doc", "array<string>"))
    own = F.get_json_object("doc", "$.layers").isNotNull() & F.get_json_object("doc", "$.name").isNotNull()
    wrapped = F.from_json(F.get_json_object("doc", "$.models"), "array<string>")
    rows = bundle.select("bundle_id", F.posexplode(F.coalesce(listed, F.when(own, F.array("doc")), wrapped)).alias("place", "doc"))
    is_list = lambda path: F.startswith(F.coalesce(F.get_json_object("doc", path), F.lit("")), F.lit("["))
    kept = rows.withColumn("name", F.get_json_object("doc", "$.name")).filter(F.col("name").isNotNull() & is_list("$.layers") & is_list("$.transitions"))
    made = F.sha2(F.concat_ws("\u0001", F.col("bundle_id").cast("string"), F.col("place").cast("string"), F.lit(str(now))), 256)
    return kept.select(
        "bundle_id", made.alias("model_id"), F.coalesce(F.get_json_object("doc", "$.createdAt").cast("bigint"), F.lit(now)).alias("created_at"),
        F.lit(now).cast("bigint").alias("updated_at"), "name", "doc",
    )


def read_bundles(spark: SparkSession, path: str, now: int) -> DataFrame:
    """Bundle files of a folder, one JSON value each."""
    files = spark.read.text(path, wholetext=True)
    return bundle_models(files.select(F.input_file_name().alias("bundle_id"), F.col("value").alias("doc")), now)


# --- tabular import ----------------------------------------------------------------

# Headings a sheet may carry, and where rows without a place go.
HEADINGS = (
    "id", "type", "parent", "name", "source", "target", "layer", "object", "attribute", "group", "path", "properties:",
    "source_layer", "source_object", "target_layer", "target_object",
)
IMPORTED = "Imported"


def read_sheet(grid: DataFrame) -> DataFrame:
    """(model, format, row_number, cells map, properties map) of sheets (model, row_no, cells array), blank rows left out.

    The first row is a heading row if a heading is in it; `cells` is keyed by lower-cased heading (the last one of a
    name counts), `properties` holds non-blank cells right of ``PROPERTIES:`` or under ``PROPERTY:x``. row_number counts the
    non-blank rows from 1, headings included.
    """
    filled = grid.filter(F.exists("cells", lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    first = filled.groupBy(M).agg(F.min_by("cells", "row_no").alias("_head"))
    key = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    first = first.withColumn("_keys", F.transform("_head", key))
    headed = F.exists("_keys", lambda k: k.isin(*HEADINGS) | k.startswith("property:"))
    from_ = F.array_position("_keys", "properties:")
    last_of = lambda k: F.size(F.col("_keys")) - F.array_position(F.reverse("_keys"), k)
    structural = lambda k, i: (
        (k != "") & ~k.startswith("property:") & (k != "properties:") & ((from_ == 0) | (i + 1 < from_))
    )
    columns = F.filter(F.transform("_keys", lambda k, i: F.when(structural(k, i), F.struct(k.alias("k"), i.alias("i")))), lambda s: s.isNotNull())
    columns = F.filter(columns, lambda s: s["i"] == last_of(s["k"]))
    named = F.transform("_head", lambda c, i: F.when(
        key(c).startswith("property:"), F.struct(F.substring(F.trim(c), F.lit(10), F.length(c)).alias("k"), i.alias("i"))
    ).when((from_ > 0) & (i + 1 > from_) & (key(c) != ""), F.struct(F.trim(c).alias("k"), i.alias("i"))))
    props = F.filter(named, lambda s: s.isNotNull())
    first = first.select(M, headed.alias("_headed"), columns.alias("_columns"), props.alias("_props"))
    has = lambda *ks: F.exists("_columns", lambda s: s["k"].isin(*ks))
    kind = (
        F.when(~F.col("_headed"), "headerless").when(has("type"), "full").when(has("layer", "object", "attribute"), "simple")
        .when(has("source", "target"), "transitions").otherwise("unknown")
    )
    numbered = running_position(filled.select(M, "row_no", "cells"), [M], [F.col("row_no")], "row_number")
    rows = join_hot(numbered.withColumnRenamed("cells", "_raw"), first.withColumn("format", kind), [M]).filter("not _headed or row_number > 1")
    at = lambda i: F.trim(F.coalesce(F.get("_raw", i), F.lit("")))
    cells = F.when(F.col("_headed"), F.map_from_entries(F.transform("_columns", lambda s: F.struct(s["k"], at(s["i"]))))).otherwise(
        F.create_map(F.lit("name"), at(F.lit(0)))
    )
    bag = F.array_distinct(F.transform("_props", lambda s: s["k"]))
    held = F.filter(F.transform(bag, lambda k: F.struct(k.alias("key"), F.try_element_at(
        F.filter(F.transform(F.filter("_props", lambda s: s["k"] == k), lambda s: at(s["i"])), lambda v: v != ""), F.lit(-1)).alias("value"))), lambda s: s["value"].isNotNull())
    return rows.select(M, "format", F.col("row_number").cast("int").alias("row_number"), cells.alias("cells"), held.alias("properties"))


def _cell(key: str) -> Column:
    return F.coalesce(F.try_element_at("cells", F.lit(key)), F.lit(""))


def _new_id(kind: str, *columns: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}-imp-"), F.sha2(F.concat_ws("\u0001", *columns), 256))


def import_entities(sheet: DataFrame, entity: DataFrame) -> dict[str, DataFrame]:
    """Find-or-create by case-sensitive name under the parent, for sheets as `read_sheet` gives them.

    `entity` is what the models hold already (model, entity_id, kind, name, parent_id, ordinal). Returns `added`
    (model, entity_id, kind, name, parent_id), `rows` (model, row_number, entity_id, declared_id): what each row addresses,
    `properties` (model, entity_id, key, value) and `warnings` (model, row_number, warning). In the TYPE/NAME/PARENT layout a
    parent is an earlier row (its ID or number, the latest one), else an entity id, else a name, the first one; levels
    are resolved one per round.
    """
    base = cut(entity.select(M, "entity_id", "kind", "name", "parent_id", "ordinal"))
    flat = sheet.filter("format in ('simple', 'headerless')")
    simple = flat.filter("format = 'simple'").select(
        M, "row_number", F.lit(None).cast("string").alias("declared_id"), _cell("layer").alias("_l"), _cell("object").alias("_o"), _cell("attribute").alias("_a")
    ).filter("_l <> '' or _o <> '' or _a <> ''")
    bare = flat.filter("format = 'headerless'").select(
        M, "row_number", F.lit(None).cast("string").alias("declared_id"), F.lit(IMPORTED).alias("_l"), F.lit(IMPORTED).alias("_o"), _cell("name").alias("_a")
    ).filter("_a <> ''")
    full = cut(sheet.filter("format = 'full'").select(
        M, "row_number", F.lower(_cell("type")).alias("_type"), _cell("name").alias("_n"), _cell("id").alias("declared_id"), _cell("parent").alias("_p"), "properties"
    ).filter("_type <> 'transition'"))
    nameless = full.filter("_n = ''").select(M, "row_number", F.lit("no NAME").alias("warning"))
    full = full.filter("_n <> ''")
    # Where a PARENT points: the latest earlier row of that id or number, else a known id, else the first known name.
    keys = full.select(M, "row_number", F.explode(F.array_distinct(F.array("declared_id", F.col("row_number").cast("string")))).alias("_p")).filter("_p <> ''")
    child = full.filter("_p <> '' and _type <> 'layer'").select(M, F.col("row_number").alias("_row"), "_p", "_type")
    by_row = child.join(keys, [M, "_p"]).filter("row_number < _row").groupBy(M, "_row").agg(F.max("row_number").alias("_prow"))
    ids = base.select(M, F.col("entity_id").alias("_p"), F.col("entity_id").alias("_pid"))
    names = base.groupBy(M, F.col("name").alias("_p")).agg(F.min_by("entity_id", "ordinal").alias("_pname"))
    earlier = full.groupBy(M, F.col("_n").alias("_p")).agg(F.min("row_number").alias("_nrow"))
    found = child.join(by_row, [M, "_row"], "left").join(ids, [M, "_p"], "left").join(names, [M, "_p"], "left").join(earlier, [M, "_p"], "left")
    points = found.select(
        M, F.col("_row").alias("row_number"),
        F.coalesce("_prow", F.when(F.col("_pid").isNull() & F.col("_pname").isNull() & (F.col("_nrow") < F.col("_row")), F.col("_nrow"))).alias("_prow"),
        F.when(F.col("_prow").isNull(), F.coalesce("_pid", "_pname")).alias("_base"),
    )
    placed = cut(full.select(M, "row_number", "declared_id", "_type", "_n", "_p").join(points, [M, "row_number"], "left"))

    # (model, kind, name, parent_id) -> id: the model's own entity, else a made-up id that the same row always gets.
    own = base.groupBy(M, "kind", "name", F.coalesce("parent_id", F.lit("")).alias("_parent")).agg(F.min_by("entity_id", "ordinal").alias("_have"))

    def ensure(rows: DataFrame, kind: str) -> DataFrame:
        """Add `entity_id` for (model, name, _parent); `fresh` says the model did not have it."""
        held = own.filter(F.col("kind") == kind).drop("kind")
        made = _new_id(kind[0], M, "_parent", "name")
        out = rows.join(held, [M, "name", "_parent"], "left")
        return out.withColumn("entity_id", F.coalesce("_have", made)).withColumn("fresh", F.col("_have").isNull()).drop("_have").withColumn("kind", F.lit(kind))

    out: list[DataFrame] = []
    addressed: list[DataFrame] = []

    def chain(rows: DataFrame) -> DataFrame:
        """Layer, object and attribute of rows (model, row_number, declared_id, _l, _o, _a); blank levels end the chain."""
        spot = rows.withColumn("_l", F.when(F.col("_l") == "", IMPORTED).otherwise(F.col("_l"))).withColumn(
            "_o", F.when((F.col("_o") == "") & (F.col("_a") != ""), IMPORTED).otherwise(F.col("_o"))
        )
        for kind, column in (("layer", "_l"), ("object", "_o"), ("attribute", "_a")):
            parent = F.lit("") if kind == "layer" else F.col("entity_id")
            here = spot.filter(F.col(column) != "").select(
                M, "row_number", "declared_id", "_l", "_o", "_a", F.col(column).alias("name"), parent.alias("_parent")
            )
            done = cut(ensure(here, kind))
            out.append(done)
            nxt = {"layer": "_o", "object": "_a", "attribute": None}[kind]
            stop = done if nxt is None else done.filter(F.col(nxt) == "")
            addressed.append(stop.select(M, "row_number", "declared_id", "entity_id"))
            spot = done.drop("name", "_parent", "fresh", "kind")
        return spot

    chain(simple.unionByName(bare))
    # Full layout. Attributes whose parent cannot hold attributes go to Imported with a warning.
    layer_rows = placed.filter("_type = 'layer'").select(M, "row_number", "declared_id", F.col("_n").alias("name"), F.lit("").alias("_parent"))
    layers = cut(ensure(layer_rows, "layer"))
    out.append(layers)
    known_layers = base.filter("kind = 'layer'").select(M, F.col("entity_id").alias("_lid"), F.col("name").alias("_lname")).union(
        layers.filter("fresh").select(M, "entity_id", "name")
    ).distinct()
    rows_done = layers.select(M, F.col("row_number").alias("_prow"), F.col("entity_id").alias("_pent"), F.lit("layer").alias("_pkind"))
    objects = placed.filter("_type = 'object'").join(rows_done, [M, "_prow"], "left").withColumn("_want", F.coalesce("_pent", "_base"))
    by_id = known_layers.select(M, F.col("_lid").alias("_want"), F.col("_lid").alias("_a1"))
    by_name = known_layers.groupBy(M, F.col("_lname").alias("_p")).agg(F.min("_lid").alias("_a2"))
    objects = objects.join(by_id, [M, "_want"], "left").join(by_name, [M, "_p"], "left")
    imported = known_layers.filter(F.col("_lname") == IMPORTED).groupBy(M).agg(F.min("_lid").alias("_imp"))
    objects = join_hot(objects, imported, [M], "left")
    default = F.coalesce("_imp", _new_id("l", M, F.lit(""), F.lit(IMPORTED)))
    objects = objects.withColumn("_parent", F.coalesce("_a1", "_a2", default)).withColumn("_loose", F.coalesce("_a1", "_a2").isNull())
    holders = objects.filter("_loose").select(M, F.col("row_number"), F.lit(None).cast("string").alias("declared_id"), F.lit(IMPORTED).alias("name"), F.lit("").alias("_parent"))
    out.append(ensure(holders, "layer"))
    made = cut(ensure(objects.select(M, "row_number", "declared_id", F.col("_n").alias("name"), "_parent"), "object"))
    out.append(made)
    addressed += [layers.select(M, "row_number", "declared_id", "entity_id"), made.select(M, "row_number", "declared_id", "entity_id")]
    can_hold = base.filter("kind <> 'layer'").select(M, F.col("entity_id").alias("_base"), F.lit(True).alias("_ok"))
    left = cut(placed.filter("_type not in ('layer', 'object')").join(can_hold, [M, "_base"], "left"))
    ready = left.filter("_ok").withColumn("_parent", F.col("_base"))
    holding = made.select(M, F.col("row_number").alias("_prow"), F.col("entity_id").alias("_parent"))
    waiting = left.filter("_ok is null")
    while True:
        now = waiting.join(holding, [M, "_prow"]).select(M, "row_number", "declared_id", F.col("_n").alias("name"), "_parent")
        if ready is not None:
            now = now.unionByName(ready.select(M, "row_number", "declared_id", F.col("_n").alias("name"), "_parent"))
            ready = None
        done = cut(ensure(now, "attribute"))
        if done.isEmpty():
            break
        out.append(done)
        addressed.append(done.select(M, "row_number", "declared_id", "entity_id"))
        waiting = cut(waiting.join(done.select(M, "row_number"), [M, "row_number"], "left_anti"))
        holding = done.select(M, F.col("row_number").alias("_prow"), F.col("entity_id").alias("_parent"))
        # An unresolved parent's own children wait for it: it is placed below, then they are.
        if waiting.join(holding, [M, "_prow"], "left_semi").isEmpty():
            rest = waiting.join(waiting.select(M, F.col("row_number").alias("_prow")), [M, "_prow"], "left_anti")
            lost = cut(rest)
            if lost.isEmpty():
                break
            chain(lost.select(M, "row_number", "declared_id", F.lit(IMPORTED).alias("_l"), F.lit(IMPORTED).alias("_o"), F.col("_n").alias("_a")))
            holding = cut(addressed[-1]).select(M, F.col("row_number").alias("_prow"), F.col("entity_id").alias("_parent"))
            nameless = nameless.union(lost.select(M, "row_number", F.lit("unresolved PARENT").alias("warning")))
            waiting = cut(waiting.join(lost.select(M, "row_number"), [M, "row_number"], "left_anti"))
    lost = cut(waiting)
    if not lost.isEmpty():
        chain(lost.select(M, "row_number", "declared_id", F.lit(IMPORTED).alias("_l"), F.lit(IMPORTED).alias("_o"), F.col("_n").alias("_a")))
        nameless = nameless.union(lost.select(M, "row_number", F.lit("unresolved PARENT").alias("warning")))
    every = reduce(DataFrame.unionByName, [o.select(M, "entity_id", "kind", "name", "_parent", "fresh") for o in out])
    added = every.filter("fresh").select(M, "entity_id", "kind", "name", F.nullif("_parent", F.lit("")).alias("parent_id")).distinct()
    rows = cut(reduce(DataFrame.unionByName, addressed))
    bag = sheet.filter("size(properties) > 0").select(M, "row_number", F.inline("properties"))
    last = rows.join(bag, [M, "row_number"]).groupBy(M, "entity_id", "key").agg(F.max_by("value", "row_number").alias("value"))
    return {"added": added, "rows": rows, "properties": last, "warnings": nameless}


def import_transitions(sheet: DataFrame, rows: DataFrame, entity: DataFrame, transition: DataFrame, implicit: bool = True) -> tuple[DataFrame, DataFrame]:
    """(transitions, warnings) from SOURCE and TARGET cells, comma lists crossed.

    `rows` is what `import_entities` addressed; `entity` every entity after it (model, entity_id, kind, name, layer_name,
    object_name, object_id, ordinal). An end is looked up in its scope columns first (an object of that name, else an attribute inside),
    then as a row id (the last row of it), an entity id, and a name: the first of several, with a warning. Explicit rows need
    both ends; on the others the row's own entity is one end. No self loops, nothing twice.
    """
    lists = lambda k: F.filter(F.transform(F.split(_cell(k), ","), lambda s: F.trim(s)), lambda s: s != "")
    explicit = (F.col("format") == "transitions") | (F.lower(_cell("type")) == "transition")
    asked = sheet.filter("format <> 'headerless'").select(
        M, "row_number", explicit.alias("_explicit"), lists("source").alias("_s"), lists("target").alias("_t"),
        *[_cell(f"{side}_{part}").alias(f"_{side}_{part}") for side in ("source", "target") for part in ("layer", "object")],
    ).filter("size(_s) > 0 or size(_t) > 0")
    if not implicit:
        asked = asked.filter("_explicit")
    asked = cut(asked)
    short = asked.filter("_explicit and (size(_s) = 0 or size(_t) = 0)").select(M, "row_number", F.lit("needs both ends").alias("warning"))
    asked = asked.filter("not _explicit or (size(_s) > 0 and size(_t) > 0)")
    entity = cut(entity.select(M, "entity_id", "kind", "name", "layer_name", "object_name", "ordinal"))
    local = rows.select(M, "row_number", "entity_id", F.explode(F.array_distinct(F.array(F.coalesce("declared_id", F.lit("")), F.col("row_number").cast("string")))).alias("_ref"))
    local = local.filter("_ref <> ''").groupBy(M, "_ref").agg(F.max_by("entity_id", "row_number").alias("_local"))
    ids = entity.select(M, F.col("entity_id").alias("_ref"), F.col("entity_id").alias("_id"))
    names = entity.groupBy(M, F.col("name").alias("_ref")).agg(F.min_by("entity_id", "ordinal").alias("_name"), F.count(F.lit(1)).alias("_n"))
    part = entity.filter("kind <> 'layer'").withColumnRenamed("name", "_ref")
    owner = F.when(F.col("kind") == "object", F.col("_ref")).otherwise(F.col("object_name"))
    rank = F.struct(F.when(F.col("kind") == "object", 0).otherwise(1), "ordinal")
    scoped = [
        part.groupBy(M, "_ref", F.col("layer_name").alias("_layer"), owner.alias("_object")).agg(F.min_by("entity_id", rank).alias("_in")),
        part.groupBy(M, "_ref", F.col("layer_name").alias("_layer")).agg(F.min_by("entity_id", rank).alias("_in")).withColumn("_object", F.lit("")),
        part.groupBy(M, "_ref", owner.alias("_object")).agg(F.min_by("entity_id", rank).alias("_in")).withColumn("_layer", F.lit("")),
    ]
    scope = reduce(DataFrame.unionByName, scoped)

    def ends(side: str) -> DataFrame:
        one = asked.select(M, "row_number", "_explicit", F.explode(f"_{side[0]}").alias("_ref"), F.col(f"_{side}_layer").alias("_layer"), F.col(f"_{side}_object").alias("_object"))
        hit = one.join(local, [M, "_ref"], "left").join(ids, [M, "_ref"], "left").join(names, [M, "_ref"], "left").join(scope, [M, "_ref", "_layer", "_object"], "left")
        end = F.coalesce("_in", "_local", "_id", "_name")
        many = F.coalesce("_in", "_local", "_id").isNull() & (F.col("_n") > 1)
        return cut(hit.select(M, "row_number", "_explicit", F.lit(side).alias("_side"), "_ref", end.alias("_end"), many.alias("_many")))

    source, target = ends("source"), ends("target")
    end = lambda df, c: df.select(M, "row_number", F.col("_end").alias(c))
    crossed = end(source.filter("_explicit"), "source").join(end(target.filter("_explicit"), "target"), [M, "row_number"])
    own = rows.select(M, "row_number", F.col("entity_id").alias("_self")).distinct()
    into = end(source.filter("not _explicit"), "source").join(own, [M, "row_number"]).withColumnRenamed("_self", "target")
    out = end(target.filter("not _explicit"), "target").join(own, [M, "row_number"]).withColumnRenamed("_self", "source")
    pairs = crossed.unionByName(into).unionByName(out).filter("source is not null and target is not null and source <> target")
    fresh = pairs.select(M, "source", "target").distinct().join(transition.select(M, "source", "target"), [M, "source", "target"], "left_anti")
    both = source.union(target)
    missing = both.filter("_end is null").join(own, [M, "row_number"], "left").filter("_explicit or _self is not null").select(
        M, "row_number", F.when(F.col("_explicit"), "failed to find endpoint").otherwise(F.concat(F.lit("unknown "), F.upper("_side"))).alias("warning")
    )
    several = both.filter("_many").select(M, "row_number", F.concat(F.lit("first of several: "), "_ref").alias("warning"))
    edges = fresh.withColumn("transition_id", _new_id("t", M, "source", "target"))
    return edges, short.union(missing).union(several).distinct()
