"""Registered source queries. Metadata documents are composed from the driver tables, one
small document per entity, and read back; the oracles go by the rows they came from."""

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from heddle.session import cut, ensure_checkpoint_dir
from heddle.sources import folders, landed

from .registry import query


@query("src_catalog_entries", """
SELECT 'workspace' AS kind, concat('w', c_custkey) AS workspace_id, c_name AS workspace_name, concat('w', c_custkey) AS id, c_name AS name,
  cast(NULL AS varchar) AS item_type, cast(NULL AS varchar) AS lakehouse_id, cast(NULL AS varchar) AS lakehouse_name FROM customer
UNION ALL SELECT 'lakehouse', concat('w', c_custkey), c_name, concat('lh', c_custkey), 'Bronze', 'Lakehouse', NULL, NULL FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'notebook', concat('w', c_custkey), c_name, concat('nb', c_custkey), concat('nb', c_custkey), 'Notebook', NULL, NULL FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'item', concat('w', c_custkey), c_name, 'x', c_mktsegment, 'Unknown', NULL, NULL FROM customer WHERE c_acctbal >= 0
UNION ALL SELECT 'table', concat('w', c_custkey), c_name, concat('t', c_nationkey), concat('t', c_nationkey), 'Table', concat('lh', c_custkey), 'Bronze' FROM customer WHERE c_acctbal >= 0
""")
def _(t):
    raw = t.sql("""SELECT concat('{"id":"w', c_custkey, '","displayName":"', c_name, '"', CASE WHEN c_acctbal >= 0 THEN concat(',"items":[{"id":"lh', c_custkey,
        '","displayName":"Bronze","type":"Lakehouse","tables":[{"name":"t', c_nationkey, '"},{"name":""}]},{"id":"nb', c_custkey, '","type":"Notebook"},{"type":"Report"},{"id":"x","displayName":"', c_mktsegment, '"}]')
        ELSE '' END, '}') AS doc FROM customer UNION ALL SELECT '{"displayName":"no id"}'""")
    return landed.catalog_entries(raw)


@query("src_storage_listing_tables", """
SELECT DISTINCT l_suppkey AS scope, CASE WHEN l_linenumber > 3 THEN concat('dbo.t', l_partkey) ELSE concat('t', l_partkey) END AS name, 'delta' AS format FROM lineitem WHERE l_linenumber <> 7""")
def _(t):
    listing = t.sql("""SELECT l_suppkey AS scope, concat('lh', l_suppkey, CASE WHEN l_linenumber = 7 THEN '/Files/' ELSE '/Tables/' END, CASE WHEN l_linenumber > 3 THEN 'dbo/' ELSE '' END, 't', l_partkey, '/_delta_log') AS path FROM lineitem
        UNION ALL SELECT l_suppkey, concat('lh/Tables/t', l_partkey, '/part-0.parquet') FROM lineitem""")
    return landed.listing_tables(listing, "scope")


@query("src_table_dir_index", """
SELECT concat('w', s_nationkey) AS workspace_id, concat('t', l_partkey) AS short, arg_min(concat('lh', l_suppkey, '/Tables/s', l_linenumber, '/T', l_partkey), (l_suppkey, l_linenumber)) AS table_dir
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def _(t):
    listing = t.sql("""SELECT concat('w', s_nationkey) AS workspace_id, l_suppkey AS lakehouse_ordinal, l_linenumber AS ordinal,
        concat('lh', l_suppkey, '/Tables/s', l_linenumber, '/T', l_partkey, '/_delta_log') AS path FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
    return landed.table_dir_index(listing)


# A log per customer, a commit per order; paid orders change the schema, others only add files.
LOG = """SELECT concat('T', o_custkey) AS table_dir, o_orderkey AS version, v.line_no, CASE v.line_no WHEN 1 THEN '{"commitInfo":{}}' WHEN 2 THEN '{broken'
  WHEN 3 THEN CASE WHEN o_orderstatus = 'F' THEN concat('{"metaData":{"id":"x","schemaString":"{\\\\"fields\\\\":[{\\\\"name\\\\":\\\\"old\\\\",\\\\"type\\\\":\\\\"long\\\\"}]}"}}') ELSE '{"add":{}}' END
  ELSE CASE WHEN o_orderstatus = 'F' THEN concat('{"metaData":{"id":"y","schemaString":"{\\\\"fields\\\\":[{\\\\"name\\\\":\\\\"c', o_orderkey, '\\\\",\\\\"type\\\\":\\\\"long\\\\"},{\\\\"name\\\\":\\\\"n\\\\",\\\\"type\\\\":{\\\\"type\\\\":\\\\"struct\\\\"}},{\\\\"name\\\\":\\\\"\\\\",\\\\"type\\\\":\\\\"long\\\\"},{\\\\"name\\\\":\\\\"d\\\\",\\\\"type\\\\":\\\\"decimal(9,2)\\\\"},{\\\\"name\\\\":\\\\"z\\\\",\\\\"type\\\\":\\\\"timestamp_ntz\\\\"}]}"}}') ELSE '{"add":{}}' END END AS line
  FROM orders CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(line_no)"""


@query("src_delta_log_schema", """
SELECT concat('T', ck) AS table_dir, v.ordinal, v.column_name, v.data_type FROM (SELECT o_custkey AS ck, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
 LATERAL (VALUES (0, concat('c', k), 'bigint'), (1, 'n', 'string'), (2, 'd', 'decimal(9,2)'), (3, 'z', 'timestamp')) AS v(ordinal, column_name, data_type)""")
def _(t):
    return landed.log_schema(t.sql(LOG.replace("\\\\", "\\\\\\\\").replace("\\\\\\\\\"", "\\\\\"")))


@query("src_delta_type_to_ddl", """
SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'bigint' WHEN 1 THEN 'int' WHEN 2 THEN concat('decimal(', p_size, ',2)') WHEN 3 THEN 'string' WHEN 4 THEN 'timestamp' WHEN 5 THEN 'string' ELSE 'tinyint' END AS ddl FROM part""")
def _(t):
    kind = """CASE p_size % 7 WHEN 0 THEN 'long' WHEN 1 THEN 'integer' WHEN 2 THEN concat('decimal(', p_size, ',2)') WHEN 3 THEN '{"type":"array"}'
              WHEN 4 THEN 'timestamp_ntz' WHEN 5 THEN 'geometry' ELSE 'byte' END"""
    return t.base("part").select("p_partkey", landed.ddl_type(F.expr(kind)).alias("ddl"))


def _definitions(t):
    return t.sql(r"""SELECT doc_id AS nb_id, CASE WHEN doc_id % 5 = 0 THEN 'Given' END AS lakehouse, array(
          named_struct('path', '.platform', 'payload', 'e30='),
          named_struct('path', CASE WHEN doc_id % 2 = 0 THEN 'Notebook-content.py' ELSE 'notebook-content.ipynb' END, 'payload', base64(encode(
             CASE WHEN doc_id % 2 = 0 THEN concat('# META "default_lakehouse_name" : "LH', doc_id, '"\nspark.table("head")\n# CELL ********************\n\nspark.table("a', doc_id, '")\n# META {}\nx = 1\n\n# MARKDOWN ****\n# FROM prose\n# CELL **\n   \n# CELL ***\n', body, '\n')
             ELSE concat('{"cells":[{"cell_type":"markdown","source":["FROM x"]},{"cell_type":"code","source":["a', doc_id, '\\n","b"]},{"cell_type":"code","source":"  "},{"cell_type":"code","source":', body_json, '}]}') END, 'UTF-8')))) AS parts
        FROM (SELECT doc_id, body, regexp_extract(to_json(named_struct('v', body)), '(?s)^.{5}(.*).$', 1) AS body_json
              FROM (SELECT doc_id, concat('x', coalesce(text, ''), 'y') AS body FROM documents))""")


@query("src_notebook_cells", """
WITH d AS (SELECT doc_id AS nb_id, concat('x', CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) ELSE coalesce(text, '') END, 'y') AS body FROM documents)
SELECT nb_id, 0 AS cell_index, CASE WHEN nb_id % 2 = 0 THEN concat('spark.table("a', nb_id, '")', chr(10), 'x = 1') ELSE concat('a', nb_id, chr(10), 'b') END AS source FROM d
UNION ALL SELECT nb_id, 1, body FROM d""")
def _(t):
    return landed.notebook_cells(_definitions(t))


@query("src_default_lakehouse", """
SELECT doc_id AS nb_id, CASE WHEN doc_id % 5 = 0 THEN 'Given' WHEN doc_id % 2 = 0 THEN concat('LH', doc_id) END AS lakehouse FROM documents""")
def _(t):
    return landed.default_lakehouse(_definitions(t))


# One pipeline per order line: a copy, a notebook and a call; every third keeps its activities at the top.
PIPELINES = r"""SELECT concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS pipeline_id, concat('Home', l_suppkey) AS default_workspace, l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln,
  array(named_struct('path', 'pipeline-content.json', 'payload', base64(encode(concat(CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '{"properties":' END,
  '{"activities":[{"name":"cp","type":"COPY","dependsOn":[],"inputs":[{"referenceName":"in', l_partkey, '"}],"typeProperties":{"source":{"datasetSettings":{"typeProperties":',
  CASE WHEN l_linenumber = 1 THEN '{}' WHEN l_linenumber = 2 THEN concat('{"location":{"fileName":"f', l_partkey, '.csv"}}') ELSE concat('{"table":"t', l_partkey, '"}') END,
  ',"linkedService":{"name":"Lnk","properties":{"typeProperties":{"workspaceId":"', lpad(l_suppkey % 25, 8, '0'), '-dddd-eeee-ffff-', lpad(l_suppkey % 25, 12, '0'), '","artifactId":"', lpad(l_suppkey, 8, '0'), '-aaaa-bbbb-CCCC-', lpad(l_suppkey, 12, '0'), '"}}}}},
  "sink":{"datasetSettings":{"typeProperties":{"table":"s', l_suppkey, '"},"linkedService":{"name":" Sink "}}},
  "translator":{"mappings":[{"source":{"name":"a', l_linenumber, '"},"sink":{"path":"$[\'x\'][\'b\']"}},{"source":{"path":"$.q.c"},"sink":{"name":"d"}},{"source":{"ordinal":1},"sink":{"name":"e"}}]}}},
  {"name":"nb","type":"TridentNotebook","dependsOn":[{"activity":"cp"},"other"],"typeProperties":{"notebook":{"id":"n', l_partkey, '"}}},
  {"type":"Wait"},{"name":"call","typeProperties":{"pipeline":{"referenceName":"p', l_suppkey, '"},"workspaceId":"w1"}}]}', CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '}' END), 'UTF-8')))) AS parts
  FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem)"""
LI = "(SELECT DISTINCT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, concat(l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber) AS pipeline_id FROM lineitem)"


def _activities(t):
    made = t.sql(PIPELINES)
    return landed.pipeline_activities(made).join(made.select("pipeline_id", "default_workspace"), "pipeline_id")


@query("src_pipeline_activities", f"""
SELECT pipeline_id, v.ordinal, v.name, v.type, v.depends_on, v.notebook_id, v.child_pipeline_id, v.workspace_id FROM {LI}, LATERAL (VALUES
  (0, 'cp', 'COPY', '', NULL, NULL, NULL), (1, 'nb', 'TridentNotebook', 'cp,other', concat('n', pk), NULL, NULL), (3, 'call', 'Unknown', '', NULL, concat('p', sk), 'w1'))
  AS v(ordinal, name, type, depends_on, notebook_id, child_pipeline_id, workspace_id)""")
def _(t):
    return _activities(t).select(
        "pipeline_id", "ordinal", "name", "type", F.array_join("depends_on", ",").alias("depends_on"), "notebook_id", "child_pipeline_id", "workspace_id"
    )


SOURCE_REF = """concat('NATION_', sk % 25, '/', CASE WHEN sk % 2 = 0 THEN concat('Lake_', sk) ELSE concat(lpad(cast(sk AS varchar), 8, '0'), '-aaaa-bbbb-CCCC-', lpad(cast(sk AS varchar), 12, '0')) END,
   '/', CASE WHEN ln = 2 THEN concat('f', pk, '.csv') ELSE concat('t', pk) END)"""


@query("src_copy_table_lineage", f"""
SELECT pipeline_id, 0 AS ordinal, 'read' AS access, CASE WHEN ln = 1 THEN concat('Home', sk, '//in', pk) ELSE {SOURCE_REF} END AS ref FROM {LI}
UNION ALL SELECT pipeline_id, 0, 'write', concat('Home', sk, '/Sink/s', sk) FROM {LI}""")
def _(t):
    return landed.copy_table_lineage(_activities(t), t("b_guid_name"))


@query("src_copy_column_flows", f"""
SELECT pipeline_id, 0 AS ordinal, concat('Home', sk, '/Sink/s', sk) AS to_table, v.to_column, CASE WHEN ln > 1 THEN {SOURCE_REF} END AS from_table, v.from_column, cast(NULL AS varchar) AS transform
FROM {LI}, LATERAL (VALUES ('b', concat('a', ln)), ('d', 'c')) AS v(to_column, from_column)""")
def _(t):
    return landed.copy_column_flows(_activities(t), t("b_guid_name"))


# One scan per customer: two reports, a dashboard over them, a dataset with two sources.
def bi_parts(t):
    raw = t.sql(r"""SELECT c_custkey AS scan_id, concat('{"datasourceInstances":[{"datasourceId":"ds', c_custkey, '","datasourceType":"Sql","connectionDetails":{"server":"srv","database":"Lake_', c_custkey % 40, '","path":" "}},
       {"datasourceId":"f', c_custkey, '","datasourceType":"File","connectionDetails":{"path":"a\\\\NATION_', c_nationkey, '\\\\x"}},{"datasourceId":" "}],
       "workspaces":[{"id":"w', c_custkey, '","name":"', c_name, '","state":"', CASE WHEN c_acctbal < 0 THEN 'Deleted' ELSE 'Active' END, '",
       "datasets":[{"id":"d', c_custkey, '","name":" ","datasourceUsages":[{"datasourceInstanceId":"f', c_custkey, '"},{"datasourceInstanceId":"ds', c_custkey, '"}]},{"name":"none"}],
       "reports":[{"id":"r', c_custkey, '","name":"', c_mktsegment, '","datasetId":"d', CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END, c_custkey, '"},{"id":"q', c_custkey, '"}],
       "dashboards":[{"id":"b', c_custkey, '","name":"n","displayName":"D","tiles":[{"reportId":"q', c_custkey, '"},{"reportId":"r', c_custkey, '"},{"reportId":"q', c_custkey, '"},{}]}]}]}') AS doc FROM customer""")
    return landed.bi_scan(raw)


@query("src_bi_scan", """
WITH a AS (SELECT * FROM customer WHERE c_acctbal >= 0)
SELECT c_custkey AS scan_id, 'datasource' AS part, v.id, v.name, v.extra FROM customer, LATERAL (VALUES (concat('ds', c_custkey), 'Sql', 'database,server'), (concat('f', c_custkey), 'File', 'path')) AS v(id, name, extra)
UNION ALL SELECT c_custkey, 'dataset', concat('d', c_custkey), concat('d', c_custkey), concat('f', c_custkey, ',ds', c_custkey) FROM a
UNION ALL SELECT c_custkey, 'report', concat('r', c_custkey), c_mktsegment, concat('d', CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE '' END, c_custkey) FROM a
UNION ALL SELECT c_custkey, 'report', concat('q', c_custkey), concat('q', c_custkey), '' FROM a
UNION ALL SELECT c_custkey, 'dashboard', concat('b', c_custkey), 'D', concat('q', c_custkey, ',r', c_custkey) FROM a
UNION ALL SELECT c_custkey, 'note', c_name, 'Deleted', '' FROM customer WHERE c_acctbal < 0""")
def _(t):
    p = bi_parts(t)
    pick = lambda part, i, n, x: p[part].select("scan_id", F.lit(part).alias("part"), F.col(i).alias("id"), F.col(n).alias("name"), x.alias("extra"))
    return (
        pick("datasource", "id", "kind", F.array_join(F.sort_array(F.map_keys("details")), ","))
        .union(pick("dataset", "id", "name", F.array_join("datasource_ids", ",")))
        .union(pick("report", "id", "name", F.col("dataset_id")))
        .union(pick("dashboard", "id", "name", F.array_join("report_ids", ",")))
        .union(pick("note", "workspace", "state", F.lit("")))
    )


# Governance hits: nations are workspaces, suppliers lakehouses (scanned twice when even) and endpoints, parts tables.
HITS = """SELECT n_nationkey AS ordinal, concat('ws', n_nationkey) AS id, 'fabric_workspace' AS entityType, n_name AS name, cast(NULL AS string) AS displayText,
   concat('https://x/groups/', lpad(n_nationkey, 8, '0'), '-0000-0000-0000-00000000000A') AS qualifiedName FROM nation
 UNION ALL SELECT 1000 + s_suppkey, concat('lh', s_suppkey), 'fabric_lakehouse', '', s_name, concat('https://x/groups/', lpad(s_nationkey, 8, '0'), '-0000-0000-0000-00000000000a/lakehouses/', lpad(s_suppkey, 8, '0'), '-1111-0000-0000-000000000000') FROM supplier
 UNION ALL SELECT 500000000 + s_suppkey, concat('dup', s_suppkey), 'fabric_warehouse', s_name, '', concat('https://x/groups/', lpad(s_nationkey, 8, '0'), '-0000-0000-0000-00000000000a/warehouses/', lpad(s_suppkey, 8, '0'), '-1111-0000-0000-000000000000') FROM supplier WHERE s_suppkey % 2 = 0
 UNION ALL SELECT 600000000 + s_suppkey, concat('ep', s_suppkey), 'fabric_lake_warehouse', s_name, '', concat('https://x/groups/', lpad(s_nationkey, 8, '0'), '-0000-0000-0000-00000000000a/lakewarehouses/', lpad(s_suppkey, 8, '0'), '-2222-0000-0000-000000000000') FROM supplier
 UNION ALL SELECT 700000000 + l_suppkey, concat('t', l_suppkey, '_', l_partkey), 'fabric_lakehouse_table', concat('p', l_partkey), '', concat('https://x/groups/', lpad(s_nationkey, 8, '0'), '-0000-0000-0000-00000000000a/lakehouses/', lpad(s_suppkey, 8, '0'), '-1111-0000-0000-000000000000/tables/p') FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey
 UNION ALL SELECT 1, concat('nb', c_custkey), 'fabric_synapse_notebook', c_name, '', concat('https://x/groups/', lpad(c_nationkey, 8, '0'), '-0000-0000-0000-00000000000a/synapsenotebooks/', lpad(c_custkey, 8, '0'), '-3333-0000-0000-000000000000') FROM customer
 UNION ALL SELECT 2, concat('r', r_regionkey), 'powerbi_report', r_name, '', '' FROM region"""


@query("src_governance_nodes", """
SELECT concat('ws', n_nationkey) AS node_id, 'workspace' AS kind, n_name AS name, cast(NULL AS varchar) AS parent_id FROM nation
UNION ALL SELECT concat('lh', s_suppkey), 'lakehouse', s_name, concat('ws', s_nationkey) FROM supplier
UNION ALL SELECT concat('ep', s_suppkey), 'lakehouse', concat(s_name, ' (SQL endpoint)'), concat('ws', s_nationkey) FROM supplier
UNION ALL SELECT DISTINCT concat('t', l_suppkey, '_', l_partkey), 'table', concat('p', l_partkey), concat('lh', l_suppkey) FROM lineitem
UNION ALL SELECT concat('nb', c_custkey), 'notebook', c_name, concat('ws', c_nationkey) FROM customer""")
def _(t):
    return landed.governance_nodes(t.sql(HITS))


@query("src_governance_columns", """
SELECT concat('t', p_partkey) AS entity_id, v.ordinal, v.column_guid, v.column_name, v.data_type FROM part, LATERAL (VALUES
 (0, concat('c', p_partkey), p_name, 'int'), (1, concat('u', p_partkey), 'b', NULL)) AS v(ordinal, column_guid, column_name, data_type) WHERE p_partkey % 3 <> 0
UNION ALL SELECT concat(k, p_partkey), 0, concat('k', p_partkey), 'q', p_type FROM part, (VALUES ('t'), ('s')) AS x(k) WHERE p_partkey % 3 = 0""")
def _(t):
    return landed.governance_columns(t.sql("""
        SELECT concat('t', p_partkey) AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN concat('{"entity":{"guid":"t","relationshipAttributes":{"columns":[],"tabular_schema":{"guid":"s', p_partkey, '"}}}}')
          ELSE concat('{"entity":{"relationshipAttributes":{"columns":[{"guid":"c', p_partkey, '","displayText":"', replace(p_name, ' ', '%20'), '"},{"guid":"u', p_partkey, '","qualifiedName":"b"},{"guid":"z"}]}},"referredEntities":{"c', p_partkey, '":{"attributes":{"data_type":"int"}}}}') END AS doc FROM part
        UNION ALL SELECT concat('s', p_partkey), concat('{"entity":{"relationshipAttributes":{"columns":[{"guid":"k', p_partkey, '","displayText":"q"}]}},"referredEntities":{"k', p_partkey, '":{"attributes":{"type":"', p_type, '"}}}}') FROM part WHERE p_partkey % 3 = 0"""))


@query("src_governance_edges", """
SELECT DISTINCT concat('s', l_suppkey) AS source, concat('p', l_partkey) AS target, 'derives' AS kind FROM lineitem WHERE l_suppkey % 3 <> 0 AND l_partkey % 4 <> 0""")
def _(t):
    relation = t.sql("""SELECT concat(CASE WHEN l_linenumber < 3 THEN 's' ELSE 'p' END, CASE WHEN l_linenumber < 3 THEN l_suppkey ELSE l_partkey END) AS node_id,
        concat('s', l_suppkey) AS fromEntityId, concat('p', l_partkey) AS toEntityId FROM lineitem
        UNION ALL SELECT concat('n', l_suppkey), concat('s', l_suppkey), concat('p', l_partkey) FROM lineitem""")
    node = t.sql("SELECT concat('s', s_suppkey) AS node_id, 'table' AS kind FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT concat('p', p_partkey), 'table' FROM part WHERE p_partkey % 4 <> 0 UNION ALL SELECT concat('n', s_suppkey), 'notebook' FROM supplier")
    return landed.governance_edges(relation, node)


@query("src_definition_sheet", """
SELECT DISTINCT l_orderkey AS table_guid, l_linenumber AS row_no, concat('col', l_linenumber) AS name, 'about' AS description FROM lineitem WHERE l_linenumber IN (3, 5, 6, 7)
UNION ALL SELECT DISTINCT l_orderkey, 4, 'Column Name', 'x' FROM lineitem WHERE l_linenumber = 4 AND l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 3)""")
def _(t):
    return landed.definition_sheet(t.sql("""SELECT DISTINCT l_orderkey AS table_guid, l_linenumber AS row_no, CASE l_linenumber WHEN 1 THEN 'Field Name' WHEN 2 THEN '  ' WHEN 4 THEN 'Column Name' ELSE concat(' col', l_linenumber) END AS a,
        CASE l_linenumber WHEN 4 THEN 'x' WHEN 2 THEN 'y' ELSE 'about ' END AS b FROM lineitem"""))


# --- folders: written and read as files ------------------------------------------------

def _folder(t, files):
    """The files(path, content) written to a folder of their own in the checkpoint folder, and read back, once: what follows reads them several times."""
    ensure_checkpoint_dir(t.spark)
    root = f"{t.spark.sparkContext._jsc.sc().getCheckpointDir().get()}/folder-{uuid.uuid4().hex}"
    folders.write_files(files, root)
    return cut(folders.read_files(t.spark, root))


def _checkpoints(rows):
    """Checkpoint files (path, content) with one metadata row each."""

    def pack(batches):
        for batch in batches:
            made = []
            for schema in batch.column("schema").to_pylist():
                out = pa.BufferOutputStream()
                pq.write_table(pa.table({"txn": pa.array([None, None], pa.string()), "metaData": [None, {"id": "x", "schemaString": schema}]}), out)
                made.append(out.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(made, pa.binary())], ["path", "content"])

    return rows.mapInArrow(pack, "path string, content binary")


# A log per customer. Its paid orders are version 7, which states schemas and ends with a broken byte; others are later commits that only
# add files. Every third customer has a checkpoint, of version 9. Names without a version belong to no log.
@query("src_log_folder", """
SELECT concat('lh', c_nationkey, '/Tables/T', c_custkey) AS table_dir, v.ordinal, v.column_name, v.data_type
FROM (SELECT c_custkey, c_nationkey, max(o_orderkey) AS k FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2),
 LATERAL (VALUES (0, concat('c', k), 'bigint'), (1, 'n', 'string'), (2, 'd', 'decimal(9,2)'), (3, 'z', 'timestamp')) AS v(ordinal, column_name, data_type)
WHERE c_custkey % 3 <> 0
UNION ALL SELECT concat('lh', c_nationkey, '/Tables/T', c_custkey), 0, concat('k', c_custkey), 'int' FROM customer WHERE c_custkey % 3 = 0""")
def _(t):
    lines = t.sql(LOG.replace("\\\\", "\\\\\\\\").replace("\\\\\\\\\"", "\\\\\"")).withColumnRenamed("table_dir", "name")
    orders = t.sql("""SELECT concat('T', o_custkey) AS name, o_orderkey AS version, concat('lh', c_nationkey, '/Tables/T', o_custkey, '/_delta_log/',
        lpad(CASE o_orderstatus WHEN 'F' THEN '7' WHEN 'O' THEN '8' ELSE '11' END, 20, '0'), '.json') AS path FROM orders JOIN customer ON o_custkey = c_custkey""")
    commit = lines.join(orders, ["name", "version"]).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("version", "line_no", "line"))).alias("l"))
    commits = commit.select("path", F.concat(F.encode(F.array_join("l.line", "\n"), "UTF-8"), F.unhex(F.lit("0AFF7B"))).alias("content"))
    others = t.sql("SELECT concat('lh', c_nationkey, '/Tables/T', c_custkey, '/_delta_log/', v.n) AS path, encode('{\"metaData\":{\"schemaString\":\"{}\"}}', 'UTF-8') AS content FROM customer CROSS JOIN (VALUES ('_last_checkpoint'), ('draft.json')) AS v(n) WHERE c_custkey % 5 = 0")
    stated = t.sql("""SELECT concat('lh', c_nationkey, '/Tables/T', c_custkey, '/_delta_log/', lpad('9', 20, '0'), '.checkpoint.parquet') AS path,
        concat('{"fields":[{"name":"k', c_custkey, '","type":"integer"}]}') AS schema FROM customer WHERE c_custkey % 3 = 0""")
    files = commits.unionByName(others).unionByName(_checkpoints(stated))
    return landed.log_schema(folders.log_lines(_folder(t, files)))


# Notebooks as folders of parts; one in seven also as a JSON document, with a part that is no base64.
@query("src_definition_folder", """
WITH d AS (SELECT concat('nb', doc_id) AS nb_id, doc_id % 2 = 0 AS script, doc_id, concat('x', CASE WHEN doc_id % 2 = 0 THEN replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) ELSE coalesce(text, '') END, 'y') AS body FROM documents)
SELECT nb_id, 0 AS cell_index, CASE WHEN script THEN concat('spark.table("a', doc_id, '")', chr(10), 'x = 1') ELSE concat('a', doc_id, chr(10), 'b') END AS source FROM d
UNION ALL SELECT nb_id, 1, body FROM d
UNION ALL SELECT concat('json', doc_id), 0, 'y = 2' FROM documents WHERE doc_id % 7 = 0""")
def _(t):
    part = _definitions(t).select(F.concat(F.lit("nb"), "nb_id").alias("nb_id"), F.explode("parts").alias("p"))
    files = part.select(F.concat_ws("/", "nb_id", "p.path").alias("path"), F.unbase64("p.payload").alias("content"))
    single = t.sql(r"""SELECT concat('json', doc_id, '.json') AS path, encode(concat('{"definition":{"parts":[{"path":"other.py","payload":"%%%"},{"path":"notebook-content.py","payload":"',
        base64(encode('# CELL ****\ny = 2\n', 'UTF-8')), '"}]}}'), 'UTF-8') AS content FROM documents WHERE doc_id % 7 = 0
        UNION ALL SELECT concat('bad', doc_id, '.json'), encode('{"definition":{"parts":[{"path":"a.py","payload":"%%%"}]}}', 'UTF-8') FROM documents WHERE doc_id % 11 = 0
        UNION ALL SELECT concat('none', doc_id, '.json'), encode('no json', 'UTF-8') FROM documents WHERE doc_id % 13 = 0""")
    found = folders.definitions(_folder(t, files.unionByName(single)))
    return landed.notebook_cells(found.select(F.col("item").alias("nb_id"), F.lit(None).cast("string").alias("lakehouse"), "parts"))


@query("src_catalog_folder", """
SELECT 'workspace' AS kind, concat('w', c_custkey) AS workspace_id, concat(c_name, chr(65533)) AS workspace_name, concat('w', c_custkey) AS id, concat(c_name, chr(65533)) AS name,
  cast(NULL AS varchar) AS item_type, cast(NULL AS varchar) AS lakehouse_id, cast(NULL AS varchar) AS lakehouse_name FROM customer
UNION ALL SELECT 'lakehouse', concat('w', c_custkey), concat(c_name, chr(65533)), concat('lh', c_custkey), 'Bronze', 'Lakehouse', NULL, NULL FROM customer
UNION ALL SELECT 'table', concat('w', c_custkey), concat(c_name, chr(65533)), concat('t', c_nationkey), concat('t', c_nationkey), 'Table', concat('lh', c_custkey), 'Bronze' FROM customer""")
def _(t):
    doc = t.sql("""SELECT concat('w', c_custkey, '.json') AS path, concat(encode(concat('{"id":"w', c_custkey, '","displayName":"', c_name), 'UTF-8'), unhex('FF'),
        encode(concat('","items":[{"id":"lh', c_custkey, '","displayName":"Bronze","type":"Lakehouse","tables":[{"name":"t', c_nationkey, '"}]}]}'), 'UTF-8')) AS content FROM customer""")
    return landed.catalog_entries(folders.documents(_folder(t, doc)))
