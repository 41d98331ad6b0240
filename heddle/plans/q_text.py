"""Registered queries over references, code text and plan text.

The oracles state what each spelling must come to, from the keys it was composed of."""

from pyspark.sql import functions as F

from heddle.functions import code, plantext, refs
from heddle.session import cut

from .registry import query

# --- references -------------------------------------------------------------

EXPECTED_REF = """CASE ln
  WHEN 1 THEN concat('Ws', nk, '/Home', nk, '/t_', pk)
  WHEN 2 THEN concat('Ws', nk, '/Lk', sk, '/t_', pk)
  WHEN 3 THEN concat('W 50%25/Lk', sk, '/t_', pk)
  WHEN 4 THEN concat('NATION_', nk, '/', CASE WHEN sk % 2 = 0 THEN concat('Lake_', sk)
       ELSE concat(lpad(cast(sk AS varchar), 8, '0'), '-AAAA-bbbb-cccc-', lpad(cast(sk AS varchar), 12, '0')) END, '/t_', pk)
  WHEN 5 THEN concat('Shop/Lk', sk, '/t_', pk)
  WHEN 6 THEN concat('Ws', nk, '/Home', nk, '/Files%2Flanding%2Ft_', pk, '%2F*.csv')
  ELSE concat('Ws', nk, '/Home', nk, '/t_', pk) END"""


def _qualified(t):
    return refs.qualify(t("b_rawref"), "raw", "ws", "lh", t("b_guid_name"))


@query("ref_qualify", f"SELECT pk, sk, ln, {EXPECTED_REF} AS ref FROM b_rawref")
def _(t):
    return _qualified(t).select("pk", "sk", "ln", "ref")


@query("ref_path_leaf", """
SELECT DISTINCT raw, CASE WHEN ln = 6 THEN concat('Files/landing/t_', pk, '/*.csv') WHEN ln IN (2, 3) THEN raw ELSE concat('t_', pk) END AS leaf
FROM b_rawref""")
def _(t):
    rows = t("b_rawref").select("raw").distinct()
    return rows.select("raw", refs.path_leaf(F.filter(F.split(refs.clean_raw("raw"), "/"), lambda s: s != "")).alias("leaf"))


@query("ref_make", "SELECT p_partkey, concat(replace(p_name, ' ', '%2F'), '/', '100%25', '/', p_type) AS ref FROM part")
def _(t):
    return t.base("part").select(
        "p_partkey", refs.make_ref(F.col("p_type"), F.lit("100%"), F.replace("p_name", F.lit(" "), F.lit("/"))).alias("ref")
    )


@query("ref_parse", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'w/1' END AS workspace,
       CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_brand END AS lakehouse,
       CASE p_partkey % 3 WHEN 2 THEN concat(p_name, '/50%') ELSE p_name END AS "table" FROM part""")
def _(t):
    ref = F.expr("""CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_brand, '/', p_name)
                    ELSE concat('w%2f1/', p_brand, '/', p_name, '/50%25') END""")
    return t.base("part").select("p_partkey", refs.parse_ref(ref).alias("p")).select("p_partkey", "p.*")


@query("ref_kind", f"""
SELECT DISTINCT {EXPECTED_REF} AS ref, ln <> 99 AS resolved, CASE WHEN ln = 6 THEN 'file' ELSE 'table' END AS kind FROM b_rawref""")
def _(t):
    return _qualified(t).select("ref").distinct().select("ref", refs.ref_parts("ref").alias("p")).select("ref", "p.resolved", "p.kind")


@query("ref_as_ref", f"""
WITH r AS (SELECT pk, sk, ln, nk, {EXPECTED_REF} AS ref FROM b_rawref)
SELECT pk, sk, ln, 'raw' AS given, CASE WHEN ln >= 6 THEN (CASE ln WHEN 6 THEN concat('Files/landing/t_', pk, '/*.csv')
       ELSE concat('/mnt/Tables/t_', pk, '/part-0001.snappy.parquet') END)
       WHEN ln = 5 THEN concat('"abfss://onelake@acct.example/Shop/Lk', sk, '.Lakehouse/Tables/dbo/t_', pk, '/"') ELSE ref END AS ref FROM r
UNION ALL SELECT pk, sk, ln, 'ref', ref FROM r""")
def _(t):
    made = _qualified(t)
    again = made.select("pk", "sk", "ln", F.lit("ref").alias("given"), F.col("ref").alias("raw"), "ws", "lh")
    rows = made.select("pk", "sk", "ln", F.lit("raw").alias("given"), "raw", "ws", "lh").union(again)
    return refs.as_ref(rows, "raw", "ws", "lh", t("b_guid_name")).select("pk", "sk", "ln", "given", "ref")


@query("ref_workspaces_referenced", """
SELECT l_orderkey AS nb_id, concat(lpad(cast(s_nationkey AS varchar), 8, '0'), CASE WHEN min(l_linenumber) % 2 = 0 THEN '-DDDD' ELSE '-dddd' END,
       '-eeee-ffff-', lpad(cast(s_nationkey AS varchar), 12, '0')) AS guid
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey, s_nationkey""")
def _(t):
    cells = t.sql("""SELECT l_orderkey AS nb_id, l_linenumber AS cell_index,
        concat('spark.read.load("abfss://', lpad(s_nationkey, 8, '0'), CASE WHEN l_linenumber % 2 = 0 THEN '-DDDD' ELSE '-dddd' END,
               '-eeee-ffff-', lpad(s_nationkey, 12, '0'), '@acct/x/Tables/y") # abfss://plain@acct') AS source
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
    return refs.workspaces_referenced(cells)


@query("ref_view_key", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN lower(replace(p_name, ' ', '_')) WHEN 1 THEN lower(p_type) ELSE '' END AS view_key FROM part""")
def _(t):
    raw = F.expr("""CASE p_partkey % 5 WHEN 0 THEN concat(' `', upper(replace(p_name, ' ', '_')), '`')
        WHEN 1 THEN concat('GLOBAL_temp.', p_type) WHEN 2 THEN concat('a.', p_type) WHEN 3 THEN concat('x/', p_type) ELSE p_name END""")
    return t.base("part").select("p_partkey", refs.view_key(raw).alias("view_key"))


@query("ref_guid_names", """
SELECT concat('cu-', c_custkey) AS guid, coalesce(n_name, c_name) AS name
FROM customer LEFT JOIN nation ON n_nationkey = c_custkey AND n_nationkey % 2 = 0
WHERE coalesce(n_name, c_name) <> ''""")
def _(t):
    spaces = t.sql("SELECT concat('CU-', cast(n_nationkey AS string)) AS id, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE '' END AS name FROM nation")
    items = t.sql("SELECT concat('Cu-', cast(c_custkey AS string)) AS id, c_name AS name FROM customer")
    return refs.guid_names(spaces, items)


@query("ref_guid_resolved", """
SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN concat('Lake_', s_suppkey)
  ELSE concat(lpad(cast(s_suppkey AS varchar), 8, '0'), '-AAAA-BBBB-CCCC-', lpad(cast(s_suppkey AS varchar), 12, '0')) END AS name FROM supplier""")
def _(t):
    rows = t.sql("SELECT s_suppkey, concat(' ', lpad(s_suppkey, 8, '0'), '-AAAA-BBBB-CCCC-', lpad(s_suppkey, 12, '0')) AS id FROM supplier")
    return refs.named(rows, "id", t("b_guid_name"), "name").select("s_suppkey", "name")


ASSETS = """SELECT p_partkey, CASE WHEN p_size > 25 THEN concat('https://x/groups/1/lakehouses/2/tables/dbo%252F', replace(p_name, ' ', '%2520'), '/') ELSE '' END AS qn,
  upper(p_name) AS name FROM part"""


@query("ref_asset_name", "SELECT p_partkey, lower(p_name) AS asset_key FROM part")
def _(t):
    return t.sql(ASSETS).select("p_partkey", refs.asset_name("qn", "name").alias("asset_key"))


@query("ref_unambiguous_names", """
SELECT asset_key, min(c_custkey) AS c_custkey FROM (
  SELECT c_custkey, concat('k', cast(round(c_acctbal) AS bigint)) AS asset_key FROM customer) GROUP BY 1 HAVING count(*) = 1""")
def _(t):
    keyed = t.sql("SELECT c_custkey, concat('k', cast(round(c_acctbal) AS bigint)) AS asset_key FROM customer")
    return refs.unambiguous(keyed, "asset_key", "c_custkey")


@query("ref_visible_only", """
SELECT l_orderkey AS request_id, min(l_linenumber * 1000000 + l_partkey) AS ordinal,
  arg_min(concat(CASE WHEN l_linenumber % 2 = 0 THEN 'W-' ELSE 'w-' END, s_nationkey), l_linenumber * 1000000 + l_partkey) AS id
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE s_nationkey <= c_nationkey GROUP BY l_orderkey, s_nationkey""")
def _(t):
    asked = t.sql("""SELECT l_orderkey AS request_id, l_linenumber * 1000000 + l_partkey AS ordinal,
        concat(CASE WHEN l_linenumber % 2 = 0 THEN 'W-' ELSE 'w-' END, s_nationkey) AS id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""")
    visible = t.sql("""SELECT o_orderkey AS request_id, concat('w-', n_nationkey) AS id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON n_nationkey <= c_nationkey""")
    return refs.visible_only(asked, visible)


# --- code text --------------------------------------------------------------

def _named(prefix):
    return f"""SELECT nb_id, cell_index, 'read' AS access, concat('Ws', nk, '/Raw/t_', pk) AS ref, 'Raw.t_' || pk AS raw FROM c WHERE cell_index = 1
UNION SELECT nb_id, cell_index, 'read', concat('Shop/Lk', sk, '/t_', pk), concat('abfss://onelake@acct/Shop/Lk', sk, '.Lakehouse/Tables/t_', pk) FROM c WHERE cell_index = 2
UNION SELECT nb_id, cell_index, 'read', concat('Ws', nk, '/Home/t_', pk), concat('t_', pk) FROM c WHERE cell_index IN (3, 7)
UNION SELECT nb_id, cell_index, 'read', concat('Ws', nk, '/Home/dim_', sk), concat('dim_', sk) FROM c WHERE cell_index = 3
UNION SELECT nb_id, cell_index, 'write', concat('Ws', nk, '/Home/out_', sk), concat('out_', sk) FROM c WHERE cell_index = 4
UNION SELECT nb_id, cell_index, 'write', concat('Ws', nk, '/Home/t_', pk), concat('t_', pk) FROM c WHERE cell_index = 5
UNION SELECT nb_id, cell_index, 'read', concat('Ws', nk, '/Home/stage_', sk), concat('stage_', sk) FROM c WHERE cell_index = 5
UNION SELECT nb_id, cell_index, 'write', concat('Ws', nk, '/Home/Files%2Fout%2Ff_', sk), concat('Files/out/f_', sk) FROM c WHERE cell_index = 6
UNION SELECT nb_id, cell_index, 'write', concat('Ws', nk, '/Gold/g_', sk), concat('Gold.g_', sk) FROM c WHERE cell_index = 7"""


CELLS = """c AS (SELECT l_orderkey AS nb_id, l_linenumber AS cell_index, c_nationkey AS nk, l_partkey AS pk, l_suppkey AS sk
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
acc AS (""" + _named("") + ")"


def _access(t):
    return code.table_access(t("b_cell"), t("b_notebook"), t("b_guid_name"))


@query("code_table_access", f"WITH {CELLS} SELECT DISTINCT nb_id, cell_index, access, ref FROM acc")
def _(t):
    return _access(t).select("nb_id", "cell_index", "access", "ref").distinct()


@query("code_read_minus_write", f"""WITH {CELLS}
SELECT DISTINCT nb_id, access, ref FROM acc a
WHERE access = 'write' OR NOT EXISTS (SELECT 1 FROM acc w WHERE w.access = 'write' AND w.nb_id = a.nb_id AND w.ref = a.ref)""")
def _(t):
    return code.read_minus_write(_access(t))


@query("code_view_names_excluded", f"""WITH {CELLS}
SELECT nb_id, cell_index, access, ref FROM acc WHERE NOT (raw LIKE 't@_%' ESCAPE '@' AND coalesce(try_cast(substr(raw, 3) AS bigint), 1) % 3 = 0)""")
def _(t):
    view = t.sql("SELECT DISTINCT nb_id, concat('t_', cast(pk AS string)) AS view_key FROM b_cell WHERE pk % 3 = 0")
    return code.without_views(_access(t), view).select("nb_id", "cell_index", "access", "ref")


COLUMN_MAPS = """
SELECT l_orderkey AS nb_id, l_linenumber AS cell_index, v.* FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
 LATERAL (VALUES
  (3, 2, 0, 'a.qty', 'qty', NULL, concat('SELECT a.qty, a.price * ', l_suppkey, ' AS total, * , b.ünit FROM')),
  (3, 2, 1, concat('a.price * ', l_suppkey), 'total', concat('a.price * ', l_suppkey, ' AS total'), concat('SELECT a.qty, a.price * ', l_suppkey, ' AS total, * , b.ünit FROM')),
  (3, 2, 3, 'b.ünit', 'ünit', NULL, concat('SELECT a.qty, a.price * ', l_suppkey, ' AS total, * , b.ünit FROM')),
  (5, 2, 0, 'k', 'k', NULL, 'SELECT k, v FROM'), (5, 2, 1, 'v', 'v', NULL, 'SELECT k, v FROM'),
  (7, 1, 0, 'k', 'k', NULL, concat('SELECT', chr(10), ' k FROM'))) AS v(n, line, ordinal, from_column, to_column, transform, snippet)
WHERE v.n = l_linenumber
""".replace("v.*", "v.line, v.ordinal, v.from_column, v.to_column, v.transform, v.snippet")


@query("code_select_column_maps", COLUMN_MAPS)
def _(t):
    return code.select_column_maps(t("b_cell"))


def _code_graph(t):
    ws = t.sql("SELECT concat('m', n_nationkey) AS graph_id, concat('M', n_nationkey) AS name FROM nation")
    declared = t.sql("""SELECT concat('m', n_nationkey) AS graph_id, concat('table.t_', p_partkey) AS node_id, 'table' AS kind,
        concat('t_', p_partkey) AS name, concat('workspace.m', n_nationkey) AS parent_id FROM part JOIN nation ON p_partkey % 2 = 0""")
    return code.code_graph(ws, declared, t("b_notebook").select("graph_id", "nb_id", "name"), t("b_cell"))


@query("code_edge_columns", f"""WITH {CELLS},
w AS (SELECT DISTINCT nb_id, lower(CASE WHEN raw LIKE 'Files/%' THEN split_part(raw, '/', 3) WHEN raw LIKE 'abfss%' THEN concat('t_', split_part(raw, '/t_', 2))
   WHEN raw LIKE '%.%' THEN split_part(raw, '.', 2) ELSE raw END) AS name FROM acc WHERE access = 'write'),
m AS ({COLUMN_MAPS})
SELECT graph_id, concat('notebook.nb_', w.nb_id) AS source, concat('table.', w.name) AS target, concat('notebook.nb_', w.nb_id) AS via, b.name AS notebook,
  m.cell_index, m.line, m.snippet, m.ordinal, m.from_column, m.to_column, m.transform
FROM w JOIN m ON w.nb_id = m.nb_id JOIN b_notebook b ON w.nb_id = b.nb_id""")
def _(t):
    return code.edge_columns(_code_graph(t)[1], t("b_notebook"), t("b_cell"))


@query("code_graph_build", f"""WITH {CELLS},
s AS (SELECT nb_id, access, lower(CASE WHEN raw LIKE 'Files/%' THEN split_part(raw, '/', 3) WHEN raw LIKE 'abfss%' THEN concat('t_', split_part(raw, '/t_', 2))
   WHEN raw LIKE '%.%' THEN split_part(raw, '.', 2) ELSE raw END) AS name FROM acc),
w AS (SELECT DISTINCT nb_id, name FROM s WHERE access = 'write'),
e AS (SELECT nb_id, name, 'writes' AS kind FROM w UNION ALL SELECT DISTINCT nb_id, name, 'reads' FROM s WHERE access = 'read' AND (nb_id, name) NOT IN (SELECT nb_id, name FROM w)),
g AS (SELECT e.*, graph_id FROM e JOIN b_notebook b ON e.nb_id = b.nb_id)
SELECT graph_id, 'edge' AS part, kind, CASE kind WHEN 'reads' THEN concat('table.', name) ELSE concat('notebook.nb_', nb_id) END AS a,
       CASE kind WHEN 'reads' THEN concat('notebook.nb_', nb_id) ELSE concat('table.', name) END AS b, false AS inferred FROM g
UNION ALL SELECT DISTINCT graph_id, 'node', 'table', concat('table.', name), NULL, true FROM g WHERE NOT (name LIKE 't@_%' ESCAPE '@' AND coalesce(try_cast(substr(name, 3) AS bigint), 1) % 2 = 0)
UNION ALL SELECT graph_id, 'node', 'notebook', concat('notebook.', name), concat('workspace.', graph_id), false FROM b_notebook
UNION ALL SELECT concat('m', n_nationkey), 'node', 'workspace', concat('workspace.m', n_nationkey), NULL, false FROM nation
UNION ALL SELECT concat('m', n_nationkey), 'node', 'table', concat('table.t_', p_partkey), concat('workspace.m', n_nationkey), false FROM nation, part WHERE p_partkey % 2 = 0
""")
def _(t):
    nodes, edges = _code_graph(t)
    e = edges.select("graph_id", F.lit("edge").alias("part"), "kind", F.col("source").alias("a"), F.col("target").alias("b"), F.lit(False).alias("inferred"))
    return e.union(nodes.select("graph_id", F.lit("node"), "kind", "node_id", "parent_id", "inferred"))


FEATURES = """SELECT lid, nb_id, cell_index, CASE WHEN cell_index IN (3, 5) THEN 1 ELSE 0 END AS stmts, cell_index = 4 OR cell_index = 6 AS fw,
  cell_index = 6 AS dyn, cell_index = 7 AS bad FROM b_cell"""


@query("code_cell_features", f"""
SELECT nb_id, cell_index, cast(stmts AS bigint) AS sql_statements, stmts > 0 AS is_sql, fw AS frame_write, dyn AS dynamic_sql, bad AS unparsable FROM ({FEATURES})""")
def _(t):
    return code.cell_features(t("b_cell"))


@query("code_coverage_rollup", f"""
WITH {CELLS}, f AS ({FEATURES}),
w AS (SELECT DISTINCT nb_id, ref, split_part(ref, '/', 3) AS leaf FROM acc WHERE access = 'write'),
u AS (SELECT nb_id, count(*) AS writes, count(*) FILTER (leaf LIKE 'out%') AS covered, string_agg(ref, ',' ORDER BY ref) FILTER (leaf NOT LIKE 'out%') AS missing FROM w GROUP BY 1)
SELECT f.nb_id, count(*) AS cells, cast(sum(stmts) AS bigint) AS sql_statements, count(*) FILTER (stmts > 0) AS sql_cells, count(*) FILTER (fw) AS frame_write_cells,
  count(*) FILTER (dyn) AS dynamic_sql_cells, count(*) FILTER (bad) AS unparsable_cells, coalesce(max(u.writes), 0) AS writes,
  coalesce(max(u.covered), 0) AS writes_covered, coalesce(max(missing), '') AS uncovered
FROM f LEFT JOIN u ON f.nb_id = u.nb_id GROUP BY f.nb_id""")
def _(t):
    access = cut(_access(t))  # read several times
    flow = access.filter("ref like '%/out@_%' escape '@'").select("nb_id", F.col("ref").alias("to_table"))
    rollup, missing = code.coverage_rollup(code.cell_features(t("b_cell")), access, flow)
    listed = missing.groupBy("nb_id").agg(F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("uncovered"))
    return rollup.join(listed, "nb_id", "left").fillna("", "uncovered")


# --- plan text --------------------------------------------------------------

def _context(t):
    return t.sql("SELECT execution_id, 'Ws' AS workspace, 'Home' AS lakehouse FROM b_execution")


def _refs(t):
    block = plantext.blocks(t("b_execution"))
    return block, plantext.node_refs(block, _context(t), t("b_guid_name"))


@query("plan_blocks", """
SELECT lid AS execution_id, v.node_no, v.node_name, cast(v.body_length AS integer) AS body_length FROM b_line,
LATERAL (VALUES (1, 1, 'Scan parquet', 110 + length(cast(pk AS varchar)) + 15), (1, 2, 'Execute InsertIntoHadoopFsRelationCommand', 0), (2, 1, concat('Scan delta spark_catalog.bronze.t_', pk), 0),
 (2, 2, 'LocalTableScan', 0), (2, 3, 'CreateTableAsSelectExec', 0), (3, 1, 'BatchScan', 0), (3, 2, 'Execute OptimizeTableCommand', 0),
 (5, 1, 'MergeIntoCommandEdge', 0), (5, 2, 'DataSourceV2Relation', 0), (6, 1, 'Execute AppendDataExecV1', 0), (6, 2, 'HashAggregate', 0)) AS v(n, node_no, node_name, body_length)
WHERE v.n = ln""".replace("cast(v.body_length AS integer) AS body_length", "1 AS body_found"))
def _(t):
    rows = plantext.blocks(t("b_execution"))
    return rows.select("execution_id", "node_no", "node_name", F.when(F.length("body") > 0, 1).otherwise(0).alias("body_found"))


@query("plan_node_class", """
SELECT lid AS execution_id, v.node_no, v.class FROM b_line,
LATERAL (VALUES (1, 1, 'read'), (1, 2, 'write'), (2, 1, 'read'), (2, 2, ''), (2, 3, 'write'), (3, 1, 'read'), (3, 2, 'skip'), (5, 1, 'write'), (5, 2, 'read'),
 (6, 1, 'write'), (6, 2, '')) AS v(n, node_no, class) WHERE v.n = ln""")
def _(t):
    return plantext.blocks(t("b_execution")).select("execution_id", "node_no", plantext.node_class("node_name").alias("class"))


@query("plan_paths", """
SELECT lid AS execution_id, 1 AS node_no, concat('Shop/Raw/t_', pk) AS ref FROM b_line WHERE ln = 1
UNION ALL SELECT lid, 2, concat('Shop/Out/o_', sk) FROM b_line WHERE ln = 1""")
def _(t):
    return _refs(t)[1].filter("rank = 1").select("execution_id", "node_no", "ref").distinct()


@query("plan_identifiers", """
SELECT lid AS execution_id, v.node_no, v.rank, v.pos, v.ref FROM b_line, LATERAL (VALUES
 (1, 2, 3, 0, 'Ws/zzz/option'), (2, 1, 2, 0, concat('Ws/bronze/t_', pk)), (2, 3, 3, 0, concat('Ws/silver/o_', sk)), (2, 3, 3, 1, 'Ws/silver/other'),
 (5, 1, 3, 0, concat('Ws/silver/o_', sk)), (5, 2, 3, 0, concat('Ws/silver/o_', sk))) AS v(n, node_no, rank, pos, ref) WHERE v.n = ln""")
def _(t):
    return _refs(t)[1].filter("rank > 1").select("execution_id", "node_no", "rank", "pos", "ref")


PLAN_ACCESS = """SELECT lid AS execution_id, v.access, v.ref FROM b_line, LATERAL (VALUES
 (1, 'read', concat('Shop/Raw/t_', pk)), (1, 'write', concat('Shop/Out/o_', sk)), (2, 'read', concat('Ws/bronze/t_', pk)), (2, 'write', concat('Ws/silver/o_', sk)),
 (5, 'write', concat('Ws/silver/o_', sk))) AS v(n, access, ref) WHERE v.n = ln"""


@query("plan_access", PLAN_ACCESS)
def _(t):
    return plantext.access(_refs(t)[1])


@query("plan_unrecognised", "SELECT lid AS execution_id, 'BatchScan' AS node_name FROM b_line WHERE ln = 3")
def _(t):
    return plantext.unrecognised(*_refs(t))


@query("plan_access_simple", "SELECT lid AS execution_id, 'read' AS access, concat('Shop/Raw/t_', pk) AS ref FROM b_line WHERE ln = 4")
def _(t):
    return plantext.access_simple(t("b_execution"), _context(t), t("b_guid_name"))
