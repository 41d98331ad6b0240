"""Registered graph and model assembly queries."""

from pyspark.sql import functions as F

from heddle.operators import assemble as am
from heddle.operators.depth import longest_path, strong_components
from heddle.session import cut

from .q_sources import bi_parts
from .registry import query

# Workspaces are nations, lakehouses suppliers, tables part names in them, notebooks orders, pipelines customers.
GRAPH = {
    "workspace": "SELECT concat('w', n_nationkey) AS graph_id, n_name AS name FROM nation",
    "lakehouse": "SELECT concat('w', s_nationkey) AS graph_id, concat('lh', s_suppkey) AS id, s_name AS name FROM supplier",
    "table": "SELECT DISTINCT concat('w', s_nationkey) AS graph_id, concat('lh', s_suppkey) AS lakehouse_id, concat('T', l_partkey % 50) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey % 2 = 0",
    "notebook": "SELECT concat('w', c_nationkey) AS graph_id, concat('nb', o_orderkey) AS id, concat('nb ', o_orderkey) AS name FROM orders JOIN customer ON o_custkey = c_custkey",
    "access": """SELECT concat('w', c_nationkey) AS graph_id, concat('nb', o_orderkey) AS notebook_id, CASE WHEN l_linenumber > 4 THEN 'write' ELSE 'read' END AS access, concat(n_name, '/', s_name, '/T', l_partkey % 50) AS ref
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "pipeline": "SELECT concat('w', c_nationkey) AS graph_id, concat('pl', c_custkey) AS id, c_name AS name FROM customer",
    "activity": "SELECT concat('w', c_nationkey) AS graph_id, concat('pl', c_custkey) AS pipeline_id, concat(CASE WHEN o_orderstatus = 'P' THEN 'gone' ELSE 'nb' END, o_orderkey) AS notebook_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "activity_access": "SELECT concat('w', c_nationkey) AS graph_id, concat('pl', c_custkey) AS pipeline_id, 'write' AS access, CASE WHEN c_acctbal < 0 THEN 'x/y/' ELSE concat('Ext//', c_mktsegment) END AS ref FROM customer",
    "other": "SELECT concat('w', n_nationkey) AS graph_id, concat('r', n_nationkey) AS id, n_name AS name, 'Report' AS item_type FROM nation",
}


def _graph(t):
    return am.workspace_graph(**{k: t.sql(v) for k, v in GRAPH.items()})


KNOWN_TABLES = """kt AS (SELECT DISTINCT s_nationkey AS n, concat('w', s_nationkey) AS graph_id, s_suppkey, concat('table.', lower(concat(n_name, '/', s_name, '/T', l_partkey % 50))) AS node_id
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_partkey % 2 = 0),
ac AS (SELECT DISTINCT concat('w', c_nationkey) AS graph_id, concat('notebook.nb', o_orderkey) AS nb, CASE WHEN l_linenumber > 4 THEN 'writes' ELSE 'reads' END AS kind, concat('table.', lower(concat(n_name, '/', s_name, '/T', l_partkey % 50))) AS tb
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
pa AS (SELECT DISTINCT concat('w', c_nationkey) AS graph_id, concat('pipeline.pl', c_custkey) AS pl, concat('table.ext//', lower(c_mktsegment)) AS tb FROM customer WHERE c_acctbal >= 0),
e AS (SELECT graph_id, CASE kind WHEN 'reads' THEN tb ELSE nb END AS source, CASE kind WHEN 'reads' THEN nb ELSE tb END AS target, kind FROM ac
  UNION ALL SELECT graph_id, pl, tb, 'writes' FROM pa
  UNION ALL SELECT concat('w', c_nationkey), concat('pipeline.pl', c_custkey), concat('notebook.nb', o_orderkey), 'calls' FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P')"""


@query("graph_workspace", f"""
WITH {KNOWN_TABLES},
inf AS (SELECT DISTINCT graph_id, tb FROM (SELECT graph_id, tb FROM ac UNION ALL SELECT graph_id, tb FROM pa) x WHERE NOT EXISTS (SELECT 1 FROM kt WHERE kt.graph_id = x.graph_id AND kt.node_id = x.tb))
SELECT graph_id, 'node' AS part, 'table' AS kind, node_id AS a, concat('lakehouse.lh', s_suppkey) AS b, NULL AS flag FROM kt
UNION ALL SELECT graph_id, 'node', 'table', tb, NULL, 'inferred' FROM inf
UNION ALL SELECT concat('w', n_nationkey), 'node', 'workspace', concat('workspace.w', n_nationkey), NULL, NULL FROM nation
UNION ALL SELECT concat('w', n_nationkey), 'node', 'item', concat('item.r', n_nationkey), concat('workspace.w', n_nationkey), 'opaque:Report' FROM nation
UNION ALL SELECT concat('w', s_nationkey), 'node', 'lakehouse', concat('lakehouse.lh', s_suppkey), concat('workspace.w', s_nationkey), NULL FROM supplier
UNION ALL SELECT concat('w', c_nationkey), 'node', 'notebook', concat('notebook.nb', o_orderkey), concat('workspace.w', c_nationkey), NULL FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('w', c_nationkey), 'node', 'pipeline', concat('pipeline.pl', c_custkey), concat('workspace.w', c_nationkey), NULL FROM customer
UNION ALL SELECT graph_id, 'edge', kind, source, target, NULL FROM e""")
def _(t):
    nodes, edges = _graph(t)
    nothing = F.lit(None).cast("string").alias("flag")
    return nodes.select("graph_id", F.lit("node").alias("part"), "kind", F.col("node_id").alias("a"), F.col("parent_id").alias("b"), "flag").union(
        edges.select("graph_id", F.lit("edge"), "kind", "source", "target", nothing)
    )


@query("graph_item_rollup", f"""
WITH {KNOWN_TABLES},
f AS (SELECT e.graph_id, coalesce('lakehouse.lh' || s.s_suppkey, e.source) AS a, coalesce('lakehouse.lh' || d.s_suppkey, e.target) AS b FROM e
  LEFT JOIN kt s ON s.graph_id = e.graph_id AND s.node_id = e.source LEFT JOIN kt d ON d.graph_id = e.graph_id AND d.node_id = e.target)
SELECT graph_id, a AS "from", b AS "to", count(*) AS count FROM f GROUP BY 1, 2, 3""")
def _(t):
    return am.item_rollup(*_graph(t))[1]


# Two lakes for each scan, one of them the one it may name.
LAKES = """SELECT scan_id, concat('id', s_suppkey) AS id, concat('Lake_', s_suppkey) AS name FROM (SELECT c_custkey AS scan_id, explode(array(c_custkey % 40, (c_custkey + 7) % 40)) AS k FROM customer) JOIN supplier ON s_suppkey = k
UNION ALL SELECT c_custkey, 'idn', 'nation_3' FROM customer"""
SOURCE_HITS = """h AS (SELECT c_custkey AS ck, c_nationkey = 3 AS f, c_custkey % 40 < (SELECT count(*) FROM supplier) AS d, c_custkey % 40 AS k, c_custkey % 3 <> 0 AS joined FROM customer WHERE c_acctbal >= 0)"""


@query("graph_bi_edges", f"""WITH {SOURCE_HITS}
SELECT ck AS scan_id, 'lakehouse.idn' AS source, concat('semanticmodel.d', ck) AS target FROM h WHERE f
UNION ALL SELECT ck, concat('lakehouse.id', k), concat('semanticmodel.d', ck) FROM h WHERE d
UNION ALL SELECT ck, concat('semanticmodel.d', ck), concat('report.r', ck) FROM h WHERE joined
UNION ALL SELECT ck, concat('report.', v.x, ck), concat('dashboard.b', ck) FROM h, (VALUES ('q'), ('r')) AS v(x)""")
def _(t):
    return am.bi_edges(bi_parts(t), t.sql(LAKES))


@query("graph_bi_consumers", f"""WITH {SOURCE_HITS}, v AS (SELECT *, CASE WHEN f THEN 'Nation_3 ' WHEN d AND k % 2 = 0 THEN concat('LAKE_', k) END AS via FROM h)
SELECT ck AS scan_id, concat('d', ck) AS id, 'semanticmodel' AS kind, via FROM v WHERE via IS NOT NULL
UNION ALL SELECT ck, concat('r', ck), 'report', via FROM v WHERE via IS NOT NULL AND joined
UNION ALL SELECT ck, concat('b', ck), 'dashboard', via FROM v WHERE via IS NOT NULL AND joined""")
def _(t):
    written = t.sql("SELECT c_custkey AS scan_id, 'Nation_3 ' AS name FROM customer UNION ALL SELECT c_custkey, concat('LAKE_', s_suppkey) FROM customer JOIN supplier ON s_suppkey % 2 = 0 AND s_suppkey = c_custkey % 40")
    return am.bi_consumers(bi_parts(t), written).drop("name")


# Customers run their nation's pipeline, nations their region's; a customer's also calls itself and one that is not there.
NESTED = """SELECT 'W' AS workspace_id, concat('P', c_custkey) AS pipeline_id, v.ordinal, v.name, 'X' AS type, v.deps AS depends_on,
   CASE v.name WHEN 'call' THEN concat('q', c_nationkey) WHEN 'self' THEN concat('p', c_custkey) WHEN 'ghost' THEN 'none' END AS child_pipeline_id, cast(NULL AS string) AS child_workspace_id
 FROM customer CROSS JOIN (SELECT inline(array(named_struct('ordinal', 0, 'name', 'a', 'deps', cast(array() AS array<string>)), named_struct('ordinal', 1, 'name', 'call', 'deps', array('a')),
   named_struct('ordinal', 2, 'name', 'b', 'deps', array('call')), named_struct('ordinal', 3, 'name', 'ghost', 'deps', array('b', 'zz')), named_struct('ordinal', 4, 'name', 'self', 'deps', cast(array() AS array<string>))))) v
 UNION ALL SELECT 'W', concat('Q', n_nationkey), v.ordinal, v.name, 'X', v.deps, CASE v.name WHEN 'z' THEN concat('R', n_regionkey) END, 'w' FROM nation
 CROSS JOIN (SELECT inline(array(named_struct('ordinal', 0, 'name', 'x', 'deps', cast(array() AS array<string>)), named_struct('ordinal', 1, 'name', 'y', 'deps', array('x')), named_struct('ordinal', 2, 'name', 'z', 'deps', array('x'))))) v
 UNION ALL SELECT 'W', concat('R', r_regionkey), v.ordinal, v.name, 'X', v.deps, NULL, NULL FROM region
 CROSS JOIN (SELECT inline(array(named_struct('ordinal', 0, 'name', 'm', 'deps', cast(array() AS array<string>)), named_struct('ordinal', 1, 'name', 'n', 'deps', array('m'))))) v"""

INNER = "('call / x', 'call'), ('call / y', 'call / x'), ('call / z', 'call / x'), ('call / z / m', 'call / z'), ('call / z / n', 'call / z / m'), ('call', 'a'), ('b', 'call / y'), ('b', 'call / z / n'), ('ghost', 'b'), ('ghost', 'zz'), ('a', '')"


@query("graph_pipeline_expand", f"""
WITH inner_rows AS (SELECT * FROM (VALUES {INNER}) AS v(name, dep)),
p AS (SELECT name, dep FROM inner_rows UNION ALL SELECT concat('self / ', name), CASE WHEN dep = '' THEN 'self' ELSE concat('self / ', dep) END FROM inner_rows
  UNION ALL VALUES ('self', ''), ('self / self', 'self'))
SELECT concat('P', c_custkey) AS root, name, dep AS depends_on FROM customer, p
UNION ALL SELECT concat('Q', n_nationkey), v.* FROM nation, (VALUES ('x', ''), ('y', 'x'), ('z', 'x'), ('z / m', 'z'), ('z / n', 'z / m')) AS v(n, d)
UNION ALL SELECT concat('R', r_regionkey), v.* FROM region, (VALUES ('m', ''), ('n', 'm')) AS v(n, d)""")
def _(t):
    activities, deps = am.expand_pipelines(t.sql(NESTED))
    return activities.join(deps, ["workspace_id", "root", "name"], "left").select("root", "name", F.coalesce("depends_on", F.lit("")).alias("depends_on"))


# An activity per line number of an order, each waiting for the next number up.
CHAIN = "SELECT l_orderkey AS pipeline_id, l_linenumber AS ordinal, concat('a', l_linenumber) AS name, array(concat('a', l_linenumber + 1)) AS depends_on FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"
RUNS_OF = "r AS (SELECT *, n - row_number() OVER (PARTITION BY k ORDER BY n) AS run FROM (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem))"


@query("graph_pipeline_waves", f"""WITH {RUNS_OF}, w AS (SELECT k, n, cast(row_number() OVER (PARTITION BY k, run ORDER BY n DESC) AS integer) AS wave FROM r)
SELECT k AS pipeline_id, concat('a', n) AS name, wave, count(*) OVER (PARTITION BY k, wave) > 1 AS concurrent FROM w""")
def _(t):
    return am.pipeline_waves(t.sql(CHAIN))


@query("graph_activity_order", f"""WITH {RUNS_OF}
SELECT k AS pipeline_id, concat('a', n) AS name, cast(row_number() OVER (PARTITION BY k ORDER BY run, n DESC) AS integer) AS position FROM r""")
def _(t):
    return am.activity_order(t.sql(CHAIN))


@query("graph_pipeline_nesting", """
SELECT concat('m', c_nationkey) AS model_id, concat('load ', c_mktsegment) AS path, concat('load ', c_mktsegment) AS name, NULL AS parent_path, false AS is_step FROM customer GROUP BY c_nationkey, c_mktsegment
UNION ALL SELECT concat('m', c_nationkey), concat('load ', c_mktsegment, ' / c', c_custkey), concat('c', c_custkey), concat('load ', c_mktsegment), false FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_mktsegment, c_custkey
UNION ALL SELECT concat('m', c_nationkey), concat('load ', c_mktsegment, ' / c', c_custkey, ' / nb', o_orderkey), concat('nb', o_orderkey), concat('load ', c_mktsegment, ' / c', c_custkey), true FROM customer JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT concat('m', n_nationkey), n_name, n_name, NULL, true FROM nation""".replace("FROM customer GROUP BY c_nationkey, c_mktsegment\n", "FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey, c_mktsegment\n"))
def _(t):
    return am.nested_steps(t.sql("SELECT concat('m', c_nationkey) AS model_id, concat('load ', c_mktsegment, ' / c', c_custkey, ' / nb', o_orderkey) AS name FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT concat('m', n_nationkey), n_name FROM nation"))


# --- runs ---------------------------------------------------------------------------

RUN = "SELECT o_orderkey AS run_id, concat('NB', o_orderkey) AS notebook, concat('Ws', o_custkey % 3) AS workspace FROM orders"
ACC = "SELECT l_orderkey AS run_id, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS access, concat('W/L', l_suppkey, '/T', l_partkey) AS ref FROM lineitem"
COLS = "SELECT l_orderkey AS run_id, concat('W/L', l_suppkey, '/T', l_partkey) AS ref, 0 AS ordinal, concat('c', l_linenumber) AS column_name, 'int' AS data_type FROM lineitem"


@query("graph_run_to_graph", """
WITH a AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber < 4 AS rd, concat('table.w/l', l_suppkey, '/t', l_partkey) AS tb, l_partkey AS pk, concat('notebook.nb', l_orderkey) AS nb FROM lineitem)
SELECT o_orderkey AS run_id, 'workspace' AS part, concat('workspace.ws', o_custkey % 3) AS a, NULL AS b, NULL AS c FROM orders
UNION ALL SELECT o_orderkey, 'notebook', concat('notebook.nb', o_orderkey), concat('workspace.ws', o_custkey % 3), NULL FROM orders
UNION ALL SELECT DISTINCT run_id, 'table', tb, NULL, NULL FROM a
UNION ALL SELECT DISTINCT l_orderkey, 'column', concat('table.w/l', l_suppkey, '/t', l_partkey, '#c', l_linenumber), concat('table.w/l', l_suppkey, '/t', l_partkey), NULL FROM lineitem
UNION ALL SELECT DISTINCT run_id, 'reads', tb, nb, NULL FROM a WHERE rd
UNION ALL SELECT DISTINCT run_id, 'writes', nb, tb, NULL FROM a WHERE NOT rd
UNION ALL SELECT DISTINCT l_orderkey, 'map', concat('notebook.nb', l_orderkey), concat('table.w/l', l_suppkey, '/t', l_partkey), concat('x', l_linenumber, '>c', l_linenumber) FROM lineitem WHERE l_linenumber >= 4""")
def _(t):
    flow = t.sql("SELECT DISTINCT l_orderkey AS run_id, concat('W/L', l_suppkey, '/T', l_partkey) AS to_table, concat('c', l_linenumber) AS to_column, concat('x', l_linenumber) AS from_column, cast(NULL AS string) AS transform FROM lineitem WHERE l_linenumber >= 4")
    nodes, edges, maps = am.run_graph(t.sql(RUN), t.sql(ACC), t.sql(COLS).distinct(), flow)
    nothing = F.lit(None).cast("string").alias("c")
    return (
        nodes.select("run_id", F.col("kind").alias("part"), F.col("node_id").alias("a"), F.col("parent_id").alias("b"), nothing)
        .union(edges.select("run_id", "kind", "source", "target", nothing))
        .union(maps.select("run_id", F.lit("map"), "source", "target", F.concat_ws(">", "from_column", "to_column")))
    )


@query("graph_copy_run", """
SELECT pipeline_id, ref, column_name, min(p) AS position FROM (SELECT l_orderkey AS pipeline_id, concat('S', l_suppkey) AS ref, concat('a', l_partkey % 4) AS column_name, l_linenumber * 2 AS p FROM lineitem WHERE l_returnflag <> 'N'
 UNION ALL SELECT l_orderkey, 'Sink', concat('b', l_partkey % 3), l_linenumber * 2 + 1 FROM lineitem) GROUP BY 1, 2, 3""")
def _(t):
    flow = t.sql("SELECT l_orderkey AS pipeline_id, 0 AS ordinal, l_linenumber AS flow_no, 'Sink' AS to_table, concat('b', l_partkey % 3) AS to_column, CASE WHEN l_returnflag <> 'N' THEN concat('S', l_suppkey) END AS from_table, concat('a', l_partkey % 4) AS from_column FROM lineitem")
    return am.copy_schemas(flow).drop("ordinal")


@query("graph_step_io", """
SELECT DISTINCT o_custkey AS step_id, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS access, concat('W/L', l_suppkey, '/T', l_partkey) AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def _(t):
    return am.step_io(t.sql("SELECT o_custkey AS step_id, o_orderkey AS run_id FROM orders"), t.sql(ACC))


LAKE = "CASE {k} % 6 WHEN 0 THEN 'LH_Bronze_1' WHEN 1 THEN 'silver' WHEN 2 THEN 'Golden' WHEN 3 THEN 'pre-gold' WHEN 4 THEN 'Landing raw' ELSE concat('mart', {k} % 2) END"
RANK = "CASE {k} % 6 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN -1 WHEN 3 THEN 5 WHEN 4 THEN 0 ELSE 9 END"


@query("graph_stage_rank", f"SELECT p_partkey, {RANK.format(k='p_partkey')} AS rank FROM part")
def _(t):
    return t.base("part").select("p_partkey", am.stage_rank(F.expr(LAKE.format(k="p_partkey"))).alias("rank"))


# Graphs per customer: its orders are steps, the suppliers of their lines lakehouses with one table each.
def _run_nodes(t):
    node = t.sql(f"""SELECT o_custkey AS graph_id, o_orderkey * 10 AS ordinal, concat('s', o_orderkey) AS node_id, 'notebook' AS kind, CASE WHEN o_orderstatus = 'F' THEN 'Wf' ELSE '' END AS workspace, cast(NULL AS string) AS lakehouse FROM orders
        UNION ALL SELECT o_custkey, min(l_orderkey * 10 + l_linenumber), concat('t', l_suppkey), 'table', '', {LAKE.format(k='l_suppkey')} FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey""")
    link = t.sql("""SELECT o_custkey AS graph_id, l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS ordinal, CASE WHEN l_linenumber < 4 THEN concat('t', l_suppkey) ELSE concat('s', l_orderkey) END AS source,
        CASE WHEN l_linenumber < 4 THEN concat('s', l_orderkey) ELSE concat('t', l_suppkey) END AS target, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
    return node, link


@query("graph_stage_assign", f"""
WITH l AS (SELECT o_custkey AS g, l_orderkey AS ok, l_suppkey AS sk, l_linenumber AS ln, l_partkey AS pk, {RANK.format(k='l_suppkey')} AS rk FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT g, ok, arg_min(rk, (CASE WHEN ln < 4 THEN 1 ELSE 0 END) * 1000000000000000 + ln * 100000000000000 + pk * 1000000 + sk) AS stage FROM l WHERE rk >= 0 GROUP BY 1, 2),
e AS (SELECT DISTINCT g, concat('t', sk) AS node_id, rk AS stage FROM l UNION ALL SELECT o_custkey, concat('s', o_orderkey), coalesce(stage, -1) FROM orders LEFT JOIN s ON o_orderkey = s.ok)
SELECT g AS graph_id, node_id, stage, cast(dense_rank() OVER (PARTITION BY g ORDER BY stage < 0, stage) - 1 AS integer) AS layer FROM e""")
def _(t):
    return am.assign_stages(*_run_nodes(t))


# Depths on these graphs, which have cycles, by the definition: edges between nodes that reach each other leave, then the longest way.
RUN_DEPTHS = f"""
l AS (SELECT o_custkey AS g, l_orderkey AS ok, l_suppkey AS sk, l_linenumber < 4 AS rd, l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey AS o,
      l_orderkey * 10 + l_linenumber AS seen, {LAKE.format(k='l_suppkey')} AS lake FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT ok, arg_min(lake, o) FILTER (NOT rd) AS lands FROM l GROUP BY 1),
n AS (SELECT o_custkey AS g, concat('s', o_orderkey) AS v, o_orderkey * 10 AS seen, true AS runs,
    CASE WHEN o_orderstatus = 'F' THEN 'Wf' WHEN lands IS NOT NULL THEN concat('lh:', lands) ELSE '' END AS owner FROM orders LEFT JOIN x ON ok = o_orderkey
  UNION ALL SELECT g, concat('t', sk), min(seen), false, concat('lh:', min(lake)) FROM l GROUP BY g, sk),
e AS (SELECT DISTINCT g, CASE WHEN rd THEN concat('t', sk) ELSE concat('s', ok) END AS a, CASE WHEN rd THEN concat('s', ok) ELSE concat('t', sk) END AS b FROM l),
r AS (SELECT g, a, b FROM e UNION SELECT r.g, r.a, e.b FROM r JOIN e ON e.g = r.g AND e.a = r.b),
f AS (SELECT e.g, e.a, e.b FROM e ANTI JOIN r ON r.g = e.g AND r.a = e.b AND r.b = e.a),
d AS (SELECT g, v, 0 AS depth FROM n UNION SELECT d.g, f.b, d.depth + 1 FROM d JOIN f ON f.g = d.g AND f.a = d.v),
m AS (SELECT g, v, max(depth) AS depth FROM d GROUP BY 1, 2)"""


@query("graph_cycle_depth", f"WITH RECURSIVE {RUN_DEPTHS} SELECT g AS graph_id, v AS node_id, depth FROM m")
def _(t):
    node, link = _run_nodes(t)
    return longest_path(node.select("graph_id", F.col("node_id").alias("node")), link, "graph_id").withColumnRenamed("node", "node_id")


@query("graph_cycle_members", f"""
WITH RECURSIVE {RUN_DEPTHS}
SELECT g AS graph_id, a AS node_id, max(b) AS scc FROM (SELECT x.g, x.a, x.b FROM r x JOIN r y ON y.g = x.g AND y.a = x.b AND y.b = x.a) c GROUP BY 1, 2""")
def _(t):
    link = _run_nodes(t)[1].select("graph_id", F.col("source").alias("src"), F.col("target").alias("node"))
    found = cut(strong_components(link, "graph_id"))
    many = found.groupBy("graph_id", "scc").count().filter("count > 1").drop("count")
    return found.join(many, ["graph_id", "scc"]).select("graph_id", F.col("node").alias("node_id"), "scc")


@query("graph_owner_assign", f"""
WITH RECURSIVE {RUN_DEPTHS},
w AS (SELECT n.g, owner, row_number() OVER (PARTITION BY n.g ORDER BY NOT bool_or(runs), owner = '', min(depth), min(seen), owner) - 1 AS layer
      FROM n JOIN m ON m.g = n.g AND m.v = n.v GROUP BY 1, 2)
SELECT n.g AS graph_id, v AS node_id, n.owner, cast(layer AS integer) AS layer FROM n JOIN w ON n.g = w.g AND n.owner = w.owner""")
def _(t):
    return am.assign_owners(*_run_nodes(t), steps_first=True)


# A graph per order without cycles: what it reads, the order's step, what that writes.
LINE_AT = "l_linenumber * 100000000000000 + l_partkey * 1000000 + l_suppkey"
SIDE = "CASE WHEN l_linenumber < 4 THEN 'r' ELSE 'w' END"


@query("graph_owner_layers", f"""
WITH l AS (SELECT o_orderkey AS g, {SIDE} AS side, l_suppkey AS sk, {LINE_AT} AS o, {LAKE.format(k='l_suppkey')} AS lake FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
x AS (SELECT g, bool_or(side = 'r') AS rd, arg_min(lake, o) FILTER (side = 'w') AS lands FROM l GROUP BY 1),
n AS (SELECT o_orderkey AS g, 's' AS node_id, cast(-1 AS bigint) AS seen, true AS runs, CASE WHEN rd THEN 1 ELSE 0 END AS d,
    CASE WHEN o_orderstatus = 'F' THEN 'Wf' WHEN lands IS NOT NULL THEN concat('lh:', lands) ELSE '' END AS owner FROM orders LEFT JOIN x ON g = o_orderkey
  UNION ALL SELECT l.g, concat(side, sk), min(o), false, CASE WHEN side = 'r' THEN 0 WHEN bool_or(rd) THEN 2 ELSE 1 END, concat('lh:', min(lake)) FROM l JOIN x ON l.g = x.g GROUP BY l.g, side, sk),
w AS (SELECT g, owner, row_number() OVER (PARTITION BY g ORDER BY NOT bool_or(runs), owner = '', min(d), min(seen)) - 1 AS layer FROM n GROUP BY 1, 2)
SELECT n.g AS graph_id, node_id, n.owner, cast(layer AS integer) AS layer FROM n JOIN w ON n.g = w.g AND n.owner = w.owner""")
def _(t):
    node = t.sql(f"""SELECT o_orderkey AS graph_id, -1 AS ordinal, 's' AS node_id, 'notebook' AS kind, CASE WHEN o_orderstatus = 'F' THEN 'Wf' ELSE '' END AS workspace, cast(NULL AS string) AS lakehouse FROM orders
        UNION ALL SELECT o_orderkey, min({LINE_AT}), concat({SIDE}, l_suppkey), 'table', '', min({LAKE.format(k='l_suppkey')}) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, {SIDE}, l_suppkey""")
    link = t.sql(f"""SELECT o_orderkey AS graph_id, {LINE_AT} AS ordinal, CASE WHEN l_linenumber < 4 THEN concat('r', l_suppkey) ELSE 's' END AS source,
        CASE WHEN l_linenumber < 4 THEN 's' ELSE concat('w', l_suppkey) END AS target, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
    return am.assign_owners(node, link, steps_first=True)


# One model per customer: steps are orders, tables one per part (read) and per order and supplier (written).
MODEL_ACC = "SELECT o_custkey AS model_id, concat('nb', o_orderkey) AS step, CASE WHEN l_linenumber < 4 THEN 'Read' ELSE 'Write' END AS access, CASE WHEN l_linenumber < 4 THEN concat('W/Raw/P', l_partkey) ELSE concat('W/Out/O', o_orderkey, '_', l_suppkey) END AS ref FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
MODEL_COLS = "SELECT DISTINCT model_id, ref, v.o AS ordinal, v.c AS column_name, 'int' AS data_type FROM ({acc}) CROSS JOIN (VALUES (0, 'id'), (1, 'qty')) AS v(o, c) WHERE ref NOT LIKE '%7'"


def _model_inputs(t):
    step = t.sql("SELECT o_custkey AS model_id, concat('nb', o_orderkey) AS step, o_orderkey AS ordinal, 'notebook' AS kind, 'W' AS workspace FROM orders")
    flow = t.sql(f"SELECT model_id, 1 AS ordinal, step, ref AS to_table, 'qty' AS to_column, 'W/Raw/X' AS from_table, 'amount' AS from_column, 'amount * 2' AS transform FROM ({MODEL_ACC}) WHERE access = 'Write'")
    return step, t.sql(MODEL_ACC), t.sql(MODEL_COLS.format(acc=MODEL_ACC)), flow


@query("graph_model_from_runs", f"""
WITH a AS (SELECT DISTINCT * FROM ({MODEL_ACC})), tb AS (SELECT DISTINCT model_id, ref, access FROM a), c AS ({MODEL_COLS.format(acc=MODEL_ACC)}),
rd AS (SELECT model_id, step, bool_or(access = 'Read') AS r, bool_or(access = 'Write') AS w FROM a GROUP BY 1, 2),
st AS (SELECT o_custkey AS model_id, concat('nb', o_orderkey) AS step, coalesce(r, false) AS r FROM orders LEFT JOIN rd ON rd.model_id = o_custkey AND rd.step = concat('nb', o_orderkey)),
wt AS (SELECT a.model_id, a.ref, max(CASE WHEN st.r THEN 2 ELSE 1 END) AS d FROM a JOIN st ON a.model_id = st.model_id AND a.step = st.step WHERE access = 'Write' GROUP BY 1, 2),
d AS (SELECT model_id, CASE WHEN r THEN 1 ELSE 0 END AS d, true AS s FROM st UNION ALL SELECT model_id, 0, false FROM tb WHERE access = 'Read' UNION ALL SELECT model_id, d, false FROM wt),
ly AS (SELECT model_id, d, bool_or(s) AS s, max(max(d)) OVER (PARTITION BY model_id) AS top FROM d GROUP BY 1, 2)
SELECT model_id, 'layer' AS part, CASE WHEN s THEN 'Notebooks & pipelines' WHEN d = 0 THEN 'Source tables' WHEN d = top THEN 'Output tables' ELSE 'Tables' END AS what, count(*) AS n FROM ly GROUP BY 1, 3
UNION ALL SELECT model_id, 'object', 'all', count(*) FROM (SELECT model_id, step FROM st UNION ALL SELECT model_id, ref FROM tb) GROUP BY 1
UNION ALL SELECT model_id, 'attribute', 'all', count(*) FROM (SELECT model_id FROM a UNION ALL SELECT a.model_id FROM a JOIN c ON a.model_id = c.model_id AND a.ref = c.ref UNION ALL SELECT model_id FROM c) GROUP BY 1
UNION ALL SELECT model_id, 'edge', 'all', count(*) FROM (SELECT model_id FROM a UNION ALL SELECT a.model_id FROM a JOIN c ON a.model_id = c.model_id AND a.ref = c.ref) GROUP BY 1
UNION ALL SELECT a.model_id, 'property', v.k, count(*) FROM a JOIN c ON a.model_id = c.model_id AND a.ref = c.ref, (VALUES ('Derives=X.amount'), ('Transform=amount * 2')) AS v(k) WHERE access = 'Write' AND column_name = 'qty' GROUP BY 1, 3
UNION ALL SELECT model_id, 'property', 'Step', count(*) FROM st GROUP BY 1""")
def _(t):
    entity, edges, props = am.model_from_runs(*_model_inputs(t))
    n = F.count(F.lit(1)).alias("n")
    what = F.when(F.col("kind") == "layer", F.col("name")).otherwise("all").alias("what")
    key = F.when(F.col("key") == "Step", "Step").otherwise(F.concat_ws("=", "key", "value")).alias("what")
    return (
        entity.groupBy("model_id", F.col("kind").alias("part"), what).agg(n)
        .union(edges.groupBy("model_id", F.lit("edge").alias("part"), F.lit("all").alias("what")).agg(n))
        .union(props.filter("key in ('Derives', 'Transform', 'Step')").groupBy("model_id", F.lit("property").alias("part"), key).agg(n))
    )


@query("graph_model_rows", f"""
WITH a AS (SELECT DISTINCT * FROM ({MODEL_ACC})), c AS ({MODEL_COLS.format(acc=MODEL_ACC)}),
rd AS (SELECT model_id, step, bool_or(access = 'Read') AS r FROM a GROUP BY 1, 2),
st AS (SELECT o_custkey AS model_id, o_orderkey AS o, concat('nb', o_orderkey) AS step, CASE WHEN r THEN 1 ELSE 0 END AS d FROM orders LEFT JOIN rd ON rd.model_id = o_custkey AND rd.step = concat('nb', o_orderkey)),
tb AS (SELECT a.model_id, ref, max(CASE WHEN access = 'Write' THEN d + 1 ELSE 0 END) AS d FROM a JOIN st ON a.model_id = st.model_id AND a.step = st.step GROUP BY 1, 2),
d AS (SELECT model_id, d, true AS s FROM st UNION ALL SELECT model_id, d, false FROM tb),
ly AS (SELECT model_id, d, bool_or(s) AS s, max(max(d)) OVER (PARTITION BY model_id) AS top FROM d GROUP BY 1, 2),
io AS (SELECT a.*, concat('io|', step, '|', access, '|', ref) AS io, concat('t|', lower(ref)) AS t, split_part(ref, '/', 3) AS leaf FROM a),
ic AS (SELECT io.*, column_name AS col, data_type, concat(io, '|', column_name) AS here, concat('c|', lower(io.ref), '|', column_name) AS there FROM io JOIN c ON io.model_id = c.model_id AND io.ref = c.ref),
e0 AS (SELECT model_id, access, step, cast(NULL AS varchar) AS col, io AS here, t AS there FROM io UNION ALL SELECT model_id, access, step, col, here, there FROM ic),
e1 AS (SELECT model_id, access, step, col, CASE access WHEN 'Read' THEN there ELSE here END AS source, CASE access WHEN 'Read' THEN here ELSE there END AS target FROM e0),
e AS (SELECT *, concat('e|', source, '|', target) AS id FROM e1)
SELECT model_id, 'layer' AS part, concat('L|', d) AS id, CASE WHEN s THEN 'Notebooks & pipelines' WHEN d = 0 THEN 'Source tables' WHEN d = top THEN 'Output tables' ELSE 'Tables' END AS a, cast(NULL AS varchar) AS b FROM ly
UNION ALL SELECT model_id, 'object', concat('s|', step), step, concat('L|', d) FROM st
UNION ALL SELECT model_id, 'object', concat('t|', lower(ref)), split_part(ref, '/', 3), concat('L|', d) FROM tb
UNION ALL SELECT model_id, 'attribute', io, leaf, concat('s|', step) FROM io UNION ALL SELECT model_id, 'attribute', here, col, io FROM ic
UNION ALL SELECT model_id, 'attribute', concat('c|', lower(ref), '|', column_name), column_name, concat('t|', lower(ref)) FROM c
UNION ALL SELECT model_id, 'edge', id, source, target FROM e
UNION ALL SELECT model_id, 'property', id, 'Source', 'run analysis' FROM e UNION ALL SELECT model_id, 'property', id, 'Access', access FROM e
UNION ALL SELECT model_id, 'property', id, k, CASE k WHEN 'Derives' THEN 'X.amount' WHEN 'Transform' THEN 'amount * 2' ELSE step END FROM e, (VALUES ('Derives'), ('Transform'), ('Via')) AS v(k) WHERE access = 'Write' AND col = 'qty'
UNION ALL SELECT model_id, 'property', io, 'Access', access FROM io UNION ALL SELECT model_id, 'property', here, 'Data type', data_type FROM ic
UNION ALL SELECT model_id, 'property', concat('c|', lower(ref), '|', column_name), 'Data type', data_type FROM c
UNION ALL SELECT model_id, 'property', concat('s|', step), k, CASE k WHEN 'Tags' THEN concat('Notebook, Step ', o) WHEN 'Source' THEN 'run analysis' WHEN 'Step' THEN cast(o AS varchar) ELSE 'W' END FROM st, (VALUES ('Tags'), ('Source'), ('Step'), ('Workspace')) AS v(k)
UNION ALL SELECT model_id, 'property', concat('t|', lower(ref)), k, CASE k WHEN 'Tags' THEN 'Table' WHEN 'Source' THEN 'run analysis' ELSE 'W' END FROM tb, (VALUES ('Tags'), ('Source'), ('Workspace')) AS v(k)""")
def _(t):
    entity, edges, props = am.model_from_runs(*_model_inputs(t))
    return (
        entity.select("model_id", F.col("kind").alias("part"), F.col("entity_id").alias("id"), F.col("name").alias("a"), F.col("parent_id").alias("b"))
        .union(edges.select("model_id", F.lit("edge"), "transition_id", "source", "target"))
        .union(props.select("model_id", F.lit("property"), "entity_id", "key", "value"))
    )


@query("graph_staged_hops", f"""
WITH a AS (SELECT DISTINCT *, split_part(ref, '/', 3) AS leaf FROM ({MODEL_ACC})), c AS ({MODEL_COLS.format(acc=MODEL_ACC)}),
s AS (SELECT model_id, step, string_agg(DISTINCT leaf, ', ' ORDER BY leaf) FILTER (access = 'Read') AS r, string_agg(DISTINCT leaf, ', ' ORDER BY leaf) FILTER (access = 'Write') AS w FROM a GROUP BY 1, 2),
p AS (SELECT a.*, CASE WHEN r IS NOT NULL AND w IS NOT NULL THEN concat('hop|', a.step) ELSE concat('io|', a.step, '|', access, '|', ref) END AS row_id, CASE WHEN r IS NOT NULL AND w IS NOT NULL THEN concat(r, ' → ', w) ELSE concat(leaf, ' (staged)') END AS row_name
  FROM a JOIN s ON a.model_id = s.model_id AND a.step = s.step),
pc AS (SELECT p.*, column_name AS col FROM p JOIN c ON p.model_id = c.model_id AND p.ref = c.ref),
e AS (SELECT model_id, concat(row_id, '|', col) AS here, concat('c|', lower(ref), '|', col) AS there, access FROM pc
  UNION SELECT model_id, row_id, concat('t|', lower(ref)), access FROM p WHERE (model_id, ref) NOT IN (SELECT model_id, ref FROM c))
SELECT DISTINCT model_id, 'entity' AS part, row_id AS a, row_name AS b FROM p UNION ALL SELECT DISTINCT model_id, 'entity', concat(row_id, '|', col), col FROM pc
UNION ALL SELECT DISTINCT model_id, 'edge', CASE access WHEN 'Read' THEN there ELSE here END, CASE access WHEN 'Read' THEN here ELSE there END FROM e""")
def _(t):
    _, access, column, _ = _model_inputs(t)
    rows, edges = am.staged_hops(access, column)
    return rows.select("model_id", F.lit("entity").alias("part"), F.col("entity_id").alias("a"), F.col("name").alias("b")).union(
        edges.select("model_id", F.lit("edge"), "source", "target")
    )
