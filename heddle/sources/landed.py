"""Landed platform metadata to lineage tables: catalogues, listings, table logs, notebooks,
pipelines, BI scans, governance hits and definition sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.refs import make_ref
from heddle.session import keyed

# --- catalogue --------------------------------------------------------------

WORKSPACE = (
    "id string, displayName string, items array<struct<id: string, displayName: string, type: string, "
    "tables: array<struct<name: string>>>>"
)


def catalog_entries(raw: DataFrame) -> DataFrame:
    """Workspaces, items and lakehouse tables as one index; `raw` is (doc), a workspace as JSON.
    An unreadable workspace (no item list) keeps its own row."""
    ws = raw.select(F.from_json("doc", WORKSPACE).alias("w")).select("w.*").filter("coalesce(id, '') <> ''")
    name = lambda df: F.coalesce(F.nullif("displayName", F.lit("")), "id")
    ws = ws.select(F.col("id").alias("workspace_id"), name(ws).alias("workspace_name"), "items")
    text = lambda: F.lit(None).cast("string")
    spaces = ws.select(
        F.lit("workspace").alias("kind"), "workspace_id", "workspace_name", F.col("workspace_id").alias("id"),
        F.col("workspace_name").alias("name"), text().alias("item_type"), text().alias("lakehouse_id"), text().alias("lakehouse_name"),
    )
    item = ws.select("workspace_id", "workspace_name", F.explode("items").alias("i")).select("workspace_id", "workspace_name", "i.*")
    item = item.filter("coalesce(id, '') <> ''").withColumn("name", name(item)).withColumn(
        "item_type", F.coalesce(F.nullif("type", F.lit("")), F.lit("Unknown"))
    )
    low = F.lower("item_type")
    items = item.select(
        F.when(low.isin("notebook", "lakehouse"), low).otherwise("item").alias("kind"), "workspace_id", "workspace_name", "id", "name",
        "item_type", text().alias("lakehouse_id"), text().alias("lakehouse_name"),
    )
    table = item.filter(low == "lakehouse").select(
        "workspace_id", "workspace_name", F.col("id").alias("lakehouse_id"), F.col("name").alias("lakehouse_name"), F.explode("tables.name").alias("t")
    )
    tables = table.filter("coalesce(t, '') <> ''").select(
        F.lit("table").alias("kind"), "workspace_id", "workspace_name", F.col("t").alias("id"), F.col("t").alias("name"),
        F.lit("Table").alias("item_type"), "lakehouse_id", "lakehouse_name",
    )
    return spaces.unionByName(items).unionByName(tables)


# --- storage listings and table logs -----------------------------------------

LOG_DIR = r"^.*?/Tables/(.*)/_delta_log$"


def listing_tables(listing: DataFrame, scope: str) -> DataFrame:
    """(scope, name, format): tables of a storage listing (scope, path); a schema folder stays in the name."""
    rel = F.filter(F.split(F.regexp_extract("path", LOG_DIR, 1), "/"), lambda s: s != "")
    rows = listing.filter(F.rlike("path", F.lit(LOG_DIR))).select(scope, F.array_join(rel, ".").alias("name"))
    return rows.filter("name <> ''").distinct().withColumn("format", F.lit("delta"))


def table_dir_index(listing: DataFrame) -> DataFrame:
    """(workspace_id, short, table_dir): the first listed table of a short name, first lakehouse first.
    `listing` is (workspace_id, lakehouse_ordinal, ordinal, path)."""
    dirs = listing.filter(F.col("path").endswith("/_delta_log")).withColumn("table_dir", F.regexp_replace("path", "/_delta_log$", ""))
    short = F.lower(F.element_at(F.split("table_dir", "/"), -1))
    first = F.min_by("table_dir", F.struct("lakehouse_ordinal", "ordinal")).alias("table_dir")
    return dirs.groupBy("workspace_id", short.alias("short")).agg(first)


# Log types and the DDL types they stand for.
DDL_TYPES = {
    "long": "bigint",
    "integer": "int",
    "short": "smallint",
    "byte": "tinyint",
    "float": "float",
    "double": "double",
    "string": "string",
    "boolean": "boolean",
    "binary": "binary",
    "date": "date",
    "timestamp": "timestamp",
    "timestamp_ntz": "timestamp",
}


def ddl_type(log_type: Column | str) -> Column:
    """DDL of a log type: decimals as they are, nested types (JSON objects) and unknown ones as string."""
    text = F.col(log_type) if isinstance(log_type, str) else log_type
    table = F.create_map(*[F.lit(x) for pair in DDL_TYPES.items() for x in pair])
    return F.when(F.startswith(text, F.lit("decimal")), text).otherwise(F.coalesce(F.try_element_at(table, text), F.lit("string")))


FIELDS = "fields array<struct<name: string, type: string>>"


def log_schema(log: DataFrame) -> DataFrame:
    """(table_dir, ordinal, column_name, data_type) from log lines (table_dir, version, line_no, line):
    the newest commit that carries a schema; the last schema line inside it. Malformed lines are skipped."""
    meta = log.select("table_dir", "version", "line_no", F.get_json_object("line", "$.metaData.schemaString").alias("_s"), F.get_json_object("line", "$.metaData").alias("_m"))
    last = (
        meta.filter("_m is not null")
        .groupBy("table_dir", "version")
        .agg(F.max_by(F.coalesce("_s", F.lit("")), "line_no").alias("_s"))
        .withColumn("_f", F.from_json("_s", FIELDS)["fields"])
        .withColumn("_f", F.filter("_f", lambda f: F.coalesce(f["name"], F.lit("")) != ""))
        .filter(F.size("_f") > 0)
    )
    newest = last.groupBy("table_dir").agg(F.max_by("_f", "version").alias("_f"))
    return newest.select("table_dir", F.posexplode("_f").alias("ordinal", "_c")).select(
        "table_dir", "ordinal", F.col("_c.name").alias("column_name"), ddl_type(F.col("_c.type")).alias("data_type")
    )


# --- notebooks ----------------------------------------------------------------

BANNER = r"(?m)^#\s*(?:CELL|MARKDOWN)\s*\*+\s*$"
KINDS = r"(?m)^#\s*(CELL|MARKDOWN)\s*\*+\s*$"
LAKEHOUSE_NAME = r'"default_lakehouse_name"\s*:\s*"([^"]+)"'
IPYNB = "cells array<struct<cell_type: string, source: string>>"


def payload_text(payload: Column) -> Column:
    """Text of a base64 part: null where it is no base64, bytes that are no UTF-8 replaced; one bad part stops no other."""
    return F.make_valid_utf8(F.try_to_binary(payload, F.lit("base64")).cast("string"))


def notebook_text(definition: DataFrame) -> DataFrame:
    """(nb_id, lakehouse, text) of a definition (nb_id, lakehouse, parts array of (path, payload)):
    the canonical content part, else the first code part; no code part, no row."""
    path = lambda p: F.lower(F.coalesce(p["path"], F.lit("")))
    code = F.filter("parts", lambda p: path(p).endswith(".py") | path(p).endswith(".ipynb"))
    best = F.filter(code, lambda p: path(p).isin("notebook-content.py", "notebook-content.ipynb"))
    chosen = F.coalesce(F.get(best, F.lit(0)), F.get(code, F.lit(0)))
    return definition.select("nb_id", "lakehouse", payload_text(chosen["payload"]).alias("text")).filter("text is not null")


def _is_json(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^\s*\{")) & F.contains(text, F.lit('"cells"'))


def notebook_cells(definition: DataFrame) -> DataFrame:
    """(nb_id, cell_index, source): code cells of both encodings; markdown, metadata lines and blanks dropped."""
    rows = notebook_text(definition)
    script = rows.filter(~_is_json(F.col("text"))).select(
        "nb_id",
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(KINDS), 1).alias("kind"), F.slice(F.split("text", BANNER), 2, 1 << 30).alias("body")
        ).alias("_z"),
    )
    script = script.select(
        "nb_id", F.transform(F.filter("_z", lambda z: z["kind"] == "CELL"), lambda z: z["body"]).alias("_c")
    )
    bare = lambda s: F.regexp_replace(
        F.array_join(F.filter(F.split(s, r"\r?\n"), lambda ln: ~F.ltrim(ln).startswith("# META")), "\n"), r"^\s+|\s+$", ""
    )
    script = script.select("nb_id", F.filter(F.transform("_c", bare), lambda s: s != "").alias("_c"))
    cells = rows.filter(_is_json(F.col("text"))).select("nb_id", F.from_json("text", IPYNB)["cells"].alias("_j"))
    lines = T.ArrayType(T.StringType())
    joined = lambda c: F.coalesce(
        F.when(F.startswith(c["source"], F.lit("[")), F.array_join(F.from_json(c["source"], lines), "")), c["source"], F.lit("")
    )
    json = cells.select(
        "nb_id",
        F.filter(F.transform(F.filter("_j", lambda c: c["cell_type"] == "code"), joined), lambda s: F.trim(s) != "").alias("_c"),
    )
    return script.unionByName(json).select("nb_id", F.posexplode("_c").alias("cell_index", "source"))


def default_lakehouse(definition: DataFrame) -> DataFrame:
    """(nb_id, lakehouse): the one given, else the first one named in the raw text, else null."""
    found = F.nullif(F.regexp_extract("text", LAKEHOUSE_NAME, 1), F.lit(""))
    return notebook_text(definition).select("nb_id", F.coalesce(F.nullif("lakehouse", F.lit("")), found).alias("lakehouse"))


# --- pipelines ----------------------------------------------------------------

_DATASET = (
    "struct<datasetSettings: struct<typeProperties: struct<table: string, location: struct<fileName: string, folderPath: string>>, "
    "linkedService: struct<name: string, properties: struct<typeProperties: struct<workspaceId: string, artifactId: string>>>>>"
)
_SIDE = "struct<name: string, path: string>"
ACTIVITY = (
    "array<struct<name: string, type: string, dependsOn: array<string>, inputs: array<struct<referenceName: string>>, "
    "outputs: array<struct<referenceName: string>>, typeProperties: struct<notebookId: string, notebook: struct<id: string>, "
    f"pipelineId: string, pipeline: struct<referenceName: string>, workspaceId: string, source: {_DATASET}, sink: {_DATASET}, "
    f"translator: struct<mappings: array<struct<source: {_SIDE}, sink: {_SIDE}>>>>>>"
)
PIPELINE = f"activities {ACTIVITY}, properties struct<activities: {ACTIVITY}>"


def pipeline_activities(definition: DataFrame) -> DataFrame:
    """Activities of pipeline definitions (pipeline_id, parts); nameless ones dropped, dependencies as objects or names."""
    part = F.get(F.filter("parts", lambda p: F.lower(F.coalesce(p["path"], F.lit(""))).endswith("pipeline-content.json")), F.lit(0))
    doc = F.from_json(payload_text(part["payload"]), PIPELINE)
    rows = definition.select("pipeline_id", doc.alias("d")).select(
        "pipeline_id", F.posexplode(F.coalesce("d.properties.activities", "d.activities")).alias("ordinal", "a")
    )
    named = lambda d: F.when(F.startswith(d, F.lit("{")), F.get_json_object(d, "$.activity")).otherwise(d)
    deps = F.filter(F.transform(F.coalesce("a.dependsOn", F.expr("cast(array() as array<string>)")), named), lambda d: F.coalesce(d, F.lit("")) != "")
    return rows.filter("coalesce(a.name, '') <> ''").select(
        "pipeline_id",
        "ordinal",
        "a.name",
        F.coalesce(F.nullif("a.type", F.lit("")), F.lit("Unknown")).alias("type"),
        deps.alias("depends_on"),
        F.coalesce("a.typeProperties.notebookId", "a.typeProperties.notebook.id").alias("notebook_id"),
        F.coalesce("a.typeProperties.pipelineId", "a.typeProperties.pipeline.referenceName").alias("child_pipeline_id"),
        F.col("a.typeProperties.workspaceId").alias("workspace_id"),
        F.col("a.inputs").alias("inputs"),
        F.col("a.outputs").alias("outputs"),
        "a.typeProperties.source",
        "a.typeProperties.sink",
        F.col("a.typeProperties.translator.mappings").alias("mappings"),
    )


def _dataset(activity: DataFrame, side: str, names: DataFrame, workspace: str, out: str) -> DataFrame:
    """Add the ref of a copy's source or sink, null when it names no table."""
    base = f"{side}.datasetSettings"
    props, linked = f"{base}.typeProperties", f"{base}.linkedService"
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    table = F.coalesce(clean(f"{props}.table"), clean(F.coalesce(F.nullif(f"{props}.location.fileName", F.lit("")), f"{props}.location.folderPath")))
    rows = activity.withColumn("_t", table)
    lookup = names.select(F.col("guid").alias("_g"), F.col("name").alias("_name"))
    for c, field in (("_w", "workspaceId"), ("_l", "artifactId")):
        raw = clean(f"{linked}.properties.typeProperties.{field}")
        rows = rows.withColumn("_raw", raw).withColumn("_k", keyed(F.lower("_raw"))).join(lookup, F.col("_k") == F.col("_g"), "left").withColumn(
            c, F.coalesce("_name", "_raw")
        ).drop("_raw", "_k", "_g", "_name")
    lake = F.coalesce("_l", clean(f"{linked}.name"))
    ref = F.when(F.col("_t").isNotNull(), make_ref("_t", lake, F.coalesce(F.col("_w"), F.col(workspace))))
    return rows.withColumn(out, ref).drop("_t", "_w", "_l")


def _copies(activity: DataFrame, names: DataFrame, workspace: str) -> DataFrame:
    copy = activity.filter("lower(type) = 'copy'")
    return _dataset(_dataset(copy, "source", names, workspace, "source_ref"), "sink", names, workspace, "sink_ref")


def copy_table_lineage(activity: DataFrame, names: DataFrame, workspace: str = "default_workspace") -> DataFrame:
    """(pipeline_id, ordinal, access, ref) of copies; declared dataset names only where nothing inline resolves."""
    rows = _copies(activity, names, workspace)

    def side(ref: str, listed: str, access: str) -> DataFrame:
        given = F.filter(F.transform(F.col(listed)["referenceName"], lambda n: F.trim(n)), lambda n: F.coalesce(n, F.lit("")) != "")
        fallback = F.transform(given, lambda n: make_ref(n, F.lit(""), F.col(workspace)))
        return rows.select("pipeline_id", "ordinal", F.lit(access).alias("access"), F.explode(
            F.when(F.col(ref).isNotNull(), F.array(ref)).otherwise(fallback)
        ).alias("ref"))

    return side("source_ref", "inputs", "read").unionByName(side("sink_ref", "outputs", "write")).distinct()


PATH_LEAF = r"""\[\s*['"][^'"]+['"]\s*\]|(?U)\.\w+$"""


def _mapped(side: Column) -> Column:
    last = F.try_element_at(F.regexp_extract_all(F.coalesce(side["path"], F.lit("")), F.lit(PATH_LEAF), 0), F.lit(-1))
    leaf = F.regexp_replace(last, r"""^\[\s*['"]|['"]\s*\]$|^\.""", "")
    return F.coalesce(F.nullif(F.trim(side["name"]), F.lit("")), F.nullif(leaf, F.lit("")))


def copy_column_flows(activity: DataFrame, names: DataFrame, workspace: str = "default_workspace") -> DataFrame:
    """Column flows of copies that name their sink; a pair missing either column is dropped."""
    rows = _copies(activity, names, workspace).filter("sink_ref is not null")
    pair = rows.select("pipeline_id", "ordinal", "source_ref", "sink_ref", F.explode("mappings").alias("m"))
    return pair.select(
        "pipeline_id",
        "ordinal",
        F.col("sink_ref").alias("to_table"),
        _mapped(F.col("m.sink")).alias("to_column"),
        F.col("source_ref").alias("from_table"),
        _mapped(F.col("m.source")).alias("from_column"),
        F.lit(None).cast("string").alias("transform"),
    ).filter("to_column is not null and from_column is not null")


# --- BI scans -----------------------------------------------------------------

SCAN = (
    "datasourceInstances array<struct<datasourceId: string, datasourceType: string, connectionDetails: map<string, string>>>, "
    "workspaces array<struct<id: string, name: string, state: string, "
    "datasets: array<struct<id: string, name: string, datasourceUsages: array<struct<datasourceInstanceId: string>>>>, "
    "reports: array<struct<id: string, name: string, datasetId: string>>, "
    "dashboards: array<struct<id: string, displayName: string, name: string, tiles: array<struct<reportId: string>>>>>>"
)


def bi_scan(raw: DataFrame) -> dict[str, DataFrame]:
    """Datasources, datasets, reports, dashboards and notes of scan payloads (scan_id, doc).
    Entries without an id are dropped; a workspace that is not active gives a note only."""
    doc = raw.select("scan_id", F.from_json("doc", SCAN).alias("d"))
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    source = doc.select("scan_id", F.explode("d.datasourceInstances").alias("s")).select(
        "scan_id",
        clean("s.datasourceId").alias("id"),
        F.coalesce(F.trim("s.datasourceType"), F.lit("")).alias("kind"),
        F.map_filter("s.connectionDetails", lambda k, v: F.coalesce(F.trim(v), F.lit("")) != "").alias("details"),
    ).filter("id is not null")
    ws = doc.select("scan_id", F.explode("d.workspaces").alias("w")).withColumn("_state", F.coalesce(clean("w.state"), F.lit("Unknown")))
    active = ws.filter("lower(_state) = 'active'").select("scan_id", F.coalesce(F.trim("w.id"), F.lit("")).alias("workspace_id"), "w")
    note = ws.filter("lower(_state) <> 'active'").select(
        "scan_id", F.coalesce(clean("w.name"), F.trim("w.id"), F.lit("")).alias("workspace"), F.col("_state").alias("state")
    )

    def part(field: str) -> DataFrame:
        rows = active.select("scan_id", "workspace_id", F.explode(f"w.{field}").alias("x"))
        return rows.withColumn("id", clean("x.id")).filter("id is not null")

    dataset = part("datasets").select(
        "scan_id", "workspace_id", "id", F.coalesce(clean("x.name"), "id").alias("name"),
        F.filter(F.transform("x.datasourceUsages.datasourceInstanceId", lambda s: F.trim(s)), lambda s: F.coalesce(s, F.lit("")) != "").alias("datasource_ids"),
    )
    report = part("reports").select(
        "scan_id", "workspace_id", "id", F.coalesce(clean("x.name"), "id").alias("name"), F.coalesce(F.trim("x.datasetId"), F.lit("")).alias("dataset_id")
    )
    tiles = F.filter(F.transform("x.tiles.reportId", lambda s: F.trim(s)), lambda s: F.coalesce(s, F.lit("")) != "")
    dashboard = part("dashboards").select(
        "scan_id", "workspace_id", "id", F.coalesce(clean("x.displayName"), clean("x.name"), "id").alias("name"), F.array_distinct(tiles).alias("report_ids")
    )
    return {"datasource": source, "dataset": dataset, "report": report, "dashboard": dashboard, "note": note}


# --- governance catalogue -------------------------------------------------------

# Catalogue entity types and the node kinds they stand for.
NODE_KINDS = {
    "fabric_workspace": "workspace",
    "fabric_lakehouse": "lakehouse",
    "fabric_lake_warehouse": "lakehouse",
    "fabric_warehouse": "lakehouse",
    "fabric_lakehouse_table": "table",
    "fabric_warehouse_table": "table",
    "fabric_warehouse_view": "table",
    "fabric_synapse_notebook": "notebook",
}
ENDPOINT_TYPE = "fabric_lake_warehouse"
WORKSPACE_OF = r"(?i)/groups/([0-9a-f-]{36})"
CONTAINER_OF = r"(?i)/(?:lakehouses|lakewarehouses|warehouses)/([0-9a-f-]{36})"


def governance_nodes(hit: DataFrame) -> DataFrame:
    """(node_id, kind, name, parent_id) of catalogue hits (ordinal, id, entityType, name, displayText, qualifiedName)."""
    kinds = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])
    found = lambda p: F.nullif(F.lower(F.regexp_extract(F.coalesce("qualifiedName", F.lit("")), p, 1)), F.lit(""))
    rows = hit.withColumn("kind", F.try_element_at(kinds, F.col("entityType"))).filter("kind is not null")
    rows = rows.select(
        "ordinal",
        F.col("id").alias("node_id"),
        "kind",
        found(WORKSPACE_OF).alias("_ws"),
        found(CONTAINER_OF).alias("_container"),
        F.concat(
            F.coalesce(F.nullif("name", F.lit("")), F.nullif("displayText", F.lit("")), "id"),
            F.when(F.col("entityType") == ENDPOINT_TYPE, " (SQL endpoint)").otherwise(""),
        ).alias("name"),
    ).withColumn("_own", F.coalesce("_container", "_ws"))
    # The first workspace or container hit of a GUID stands for it; a later container of it is folded away.
    holder = rows.filter("kind in ('workspace', 'lakehouse') and _own is not null")
    first = holder.groupBy("_own").agg(F.min_by("node_id", "ordinal").alias("_first"), F.min("ordinal").alias("_at"))
    known = rows.join(first, "_own", "left").filter(~((F.col("kind") == "lakehouse") & F.coalesce(F.col("ordinal") > F.col("_at"), F.lit(False))))
    up = F.when(F.col("kind") == "lakehouse", F.col("_ws")).otherwise(F.coalesce("_container", "_ws"))
    parents = first.select(F.col("_own").alias("_up"), F.col("_first").alias("_parent"))
    return known.withColumn("_up", up).join(parents, "_up", "left").select(
        "node_id", "kind", "name", F.when(F.col("_parent") != F.col("node_id"), F.col("_parent")).alias("parent_id")
    )


ENTITY = (
    "entity struct<guid: string, relationshipAttributes: struct<columns: array<struct<guid: string, displayText: string, qualifiedName: string>>, "
    "tabular_schema: struct<guid: string>>>, "
    "referredEntities map<string, struct<attributes: struct<dataType: string, data_type: string, type: string>>>"
)


def governance_columns(entity: DataFrame) -> DataFrame:
    """(entity_id, ordinal, column_guid, column_name, data_type) from entity details (entity_id, doc): its own columns,
    else those of its schema entity. Names are decoded."""
    d = entity.select("entity_id", F.from_json("doc", ENTITY).alias("d"))
    rel = "d.entity.relationshipAttributes"
    own = d.select("entity_id", F.posexplode(f"{rel}.columns").alias("ordinal", "c"), F.col("d.referredEntities").alias("_r"))
    kind = F.try_element_at(F.col("_r"), F.coalesce("c.guid", F.lit("")))["attributes"]
    raw = F.coalesce(F.nullif("c.displayText", F.lit("")), F.nullif("c.qualifiedName", F.lit("")))
    cols = own.select(
        "entity_id",
        "ordinal",
        F.col("c.guid").alias("column_guid"),
        F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw).alias("column_name"),
        F.coalesce(kind["dataType"], kind["data_type"], kind["type"]).alias("data_type"),
    ).filter("column_name is not null")
    bare = d.select("entity_id", F.col(f"{rel}.tabular_schema.guid").alias("_via")).join(
        cols.select("entity_id").distinct(), "entity_id", "left_anti"
    )
    lent = bare.join(cols.withColumnRenamed("entity_id", "_via"), "_via").select(*cols.columns)
    return cols.unionByName(lent)


def governance_edges(relation: DataFrame, node: DataFrame) -> DataFrame:
    """(source, target, kind): relations of kept table nodes whose two ends were kept, once each.
    `relation` is (node_id, fromEntityId, toEntityId)."""
    tables = node.filter("kind = 'table'").select("node_id")
    ids = node.select("node_id")
    rows = relation.join(tables, "node_id", "left_semi").select(F.col("fromEntityId").alias("source"), F.col("toEntityId").alias("target"))
    return (
        rows.join(ids.withColumnRenamed("node_id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("node_id", "target"), "target", "left_semi")
        .select("source", "target")
        .distinct()
        .withColumn("kind", F.lit("derives"))
    )


# --- definition sheets ------------------------------------------------------------

# Header wordings of the two columns.
NAME_HEADERS = ("name", "column", "columnname", "field", "fieldname", "attribute")
TEXT_HEADERS = ("description", "definition", "comment", "businessdefinition", "meaning")
CAMEL = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def folded(name: Column) -> Column:
    """A name as compared: letters and digits in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.coalesce(name, F.lit(""))), CAMEL, " ")), "[^0-9a-z]+", "")


def definition_sheet(sheet: DataFrame) -> DataFrame:
    """(table_guid, row_no, name, description) of sheet rows (table_guid, row_no, a, b): rows with both cells,
    without the header-like rows that lead them."""
    rows = sheet.select("table_guid", "row_no", F.trim("a").alias("name"), F.trim("b").alias("description")).filter(
        "coalesce(name, '') <> '' and coalesce(description, '') <> ''"
    )
    header = folded(F.col("name")).isin(*NAME_HEADERS) | folded(F.col("description")).isin(*TEXT_HEADERS)
    start = rows.filter(~header).groupBy("table_guid").agg(F.min("row_no").alias("_start"))
    return rows.join(start, "table_guid").filter("row_no >= _start").drop("_start")


def read_definition_sheets(spark, path: str) -> DataFrame:
    """CSV sheets, one table per file, named after its GUID; quoted cells may hold line breaks and doubled quotes. A sheet is read by
    one task, in its order."""
    cells = spark.read.csv(path, schema="a string, b string", multiLine=True, quote='"', escape='"', encoding="UTF-8")
    cells = cells.select(
        F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.csv)?$", 1).alias("table_guid"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("a", "^\ufeff", "").alias("a"),
        "b",
    )
    first = cells.groupBy("table_guid").agg(F.min("at").alias("first"))
    return definition_sheet(cells.join(first, "table_guid").select("table_guid", (F.col("at") - F.col("first")).cast("int").alias("row_no"), "a", "b"))
