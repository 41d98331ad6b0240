"""Registered queries over column flows, with the bindings that feed them."""

from pyspark.sql import functions as F

from heddle.operators import flows

from .registry import binding, query

# Four views on top of each other per line; the third is unresolved where the part key divides by 5.
binding("b_view_flow", """
SELECT ok AS nb_id, concat('v', cast(i AS string), '_', lid) AS view_key, 'c' AS column_name,
       CASE WHEN i = 1 THEN concat('Ws/Lk/t_', cast(sk AS string)) ELSE concat('v', cast(i - 1 AS string), '_', lid) END AS source_name,
       'c' AS source_column, CASE WHEN i = ln % 4 + 1 THEN concat('f', cast(i AS string), '(c)') END AS transform, i = 3 AND pk % 5 = 0 AS broken
FROM b_line CROSS JOIN (VALUES (1), (2), (3), (4)) AS v(i)
""")


def _arg(out, expr, *refs):
    """One argument of a frame operation, as a Spark SQL literal."""
    text = lambda x: "cast(NULL AS string)" if x is None else f"'{x}'"
    listed = ", ".join(f"'{r}'" for r in refs)
    return f"named_struct('out', {text(out)}, 'expr', {text(expr)}, 'refs', cast(array({listed}) AS array<string>))"


def _args(*items):
    return "cast(array(" + ", ".join(items) + ") AS array<struct<out: string, expr: string, refs: array<string>>>)"


def _inline(names, *rows):
    """Rows of a Spark SQL ``inline`` with the given column names."""
    made = [", ".join(f"'{n}', {v}" for n, v in zip(names, row)) for row in rows]
    return "inline(array(" + ", ".join(f"named_struct({m})" for m in made) + "))"


def _views(t):
    rows = t("b_view_flow")
    view = rows.select("nb_id", "view_key", (~F.col("broken")).alias("resolved"))
    return rows.withColumnRenamed("column_name", "column").drop("broken"), view


@query("flow_view_flatten", """
SELECT ok AS nb_id, concat('Out_', ln) AS target, 'c' AS "column", concat('Ws/Lk/t_', sk) AS source_name, 'c' AS source_column,
       concat('f', ln % 4 + 1, '(c)') AS transform FROM b_line WHERE pk % 5 <> 0
UNION ALL SELECT ok, concat('Out_', ln), 'k', concat('Ws/Lk/t_', sk), 'k', 'g(k)' FROM b_line
""")
def _(t):
    flow = t.sql("""SELECT ok AS nb_id, concat('Out_', ln) AS target, 'c' AS column, concat('v4_', lid) AS source_name, 'c' AS source_column,
                    cast(NULL AS string) AS transform FROM b_line
        UNION ALL SELECT ok, concat('Out_', ln), 'k', concat('Ws/Lk/t_', sk), 'k', 'g(k)' FROM b_line
        UNION ALL SELECT ok, concat('Out_', ln), 'z', concat('v1_', lid), 'absent', NULL FROM b_line""")
    return flows.flatten_views(flow, *_views(t))


@query("flow_view_base_refs", """
SELECT ok AS nb_id, concat('v', i, '_', lid) AS view_key, concat('Ws/Lk/t_', sk) AS ref FROM b_line, LATERAL (VALUES (1), (2), (3), (4)) AS v(i)
WHERE i < 3 OR pk % 5 <> 0""")
def _(t):
    return flows.view_base_refs(*_views(t))


# One operation log per order: two reads, a join, derived columns and, by priority, an end.
binding("b_frame_table", """
SELECT concat('W/L/c_', cast(c_custkey AS string)) AS ref, v.o AS ordinal, v.c AS column_name, 'string' AS data_type
FROM customer CROSS JOIN (VALUES (1, 'id'), (2, 'qty'), (3, 'price')) AS v(o, c)
UNION ALL
SELECT concat('W/L/n_', cast(n_nationkey AS string)), v.o, v.c, 'string' FROM nation CROSS JOIN (VALUES (1, 'id'), (2, 'name')) AS v(o, c)
""")
binding("b_frame_seed", """
SELECT o_orderkey AS nb_id, concat('W/L/c_', cast(c_custkey AS string)) AS t1, concat('W/L/n_', cast(c_nationkey AS string)) AS t2,
       substr(o_orderpriority, 1, 1) AS pr
FROM orders JOIN customer ON o_custkey = c_custkey
""")

NONE, NO = "cast(NULL AS string)", _args()
FRAME_OPS = "SELECT nb_id, " + _inline(
    ("frame_id", "op", "input_frame", "input_frame2", "args"),
    ("'f1'", "'read'", "t1", NONE, NO),
    ("'f2'", "'read'", "t2", NONE, NO),
    ("'f3'", "'join'", "'f1'", "'f2'", NO),
    ("'f4'", "'withColumn'", "'f3'", NONE, _args(_arg("total", "qty * price", "qty", "price"))),
    ("'f5'", "'rename'", "'f4'", NONE, _args(_arg("label", None, "name"))),
    ("'f6'", "'drop'", "'f5'", NONE, _args(_arg(None, None, "price"))),
    ("'f7'", "CASE WHEN pr = '1' THEN 'explode' ELSE 'passthrough' END", "'f6'", NONE, NO),
    ("'f8'", "'select'", "'f7'", NONE, _args(_arg("id", None, "id"), _arg("twice", "total * 2", "total"), _arg(None, "upper(label)", "label"), _arg("one", "1"))),
    ("'f9'", "CASE pr WHEN '2' THEN 'groupAgg' WHEN '3' THEN 'union' ELSE 'unionByName' END", "'f8'",
     "CASE pr WHEN '2' THEN NULL WHEN '3' THEN 'f2' ELSE 'f6' END",
     f"CASE WHEN pr = '2' THEN {_args(_arg('id', None, 'id'), _arg('s', 'sum(twice)', 'twice'), _arg(None, 'max(one)', 'one'))} ELSE {NO} END"),
    ("'f10'", "'rename'", "'f9'", NONE, _args(_arg("x", None, "nope"))),
) + " FROM b_frame_seed"

FRAMES_EXPECTED = """
WITH s AS (SELECT * FROM b_frame_seed),
e AS (
  SELECT nb_id, v.f AS frame_id, v.c AS "column", CASE v.s WHEN 1 THEN t1 WHEN 2 THEN t2 END AS src_ref, v.sc AS src_col, v.t AS transform, pr
  FROM s, LATERAL (VALUES
   ('f1', 'id', 1, 'id', NULL), ('f1', 'qty', 1, 'qty', NULL), ('f1', 'price', 1, 'price', NULL), ('f2', 'id', 2, 'id', NULL), ('f2', 'name', 2, 'name', NULL),
   ('f3', 'id', 1, 'id', NULL), ('f3', 'id', 2, 'id', NULL), ('f3', 'qty', 1, 'qty', NULL), ('f3', 'price', 1, 'price', NULL), ('f3', 'name', 2, 'name', NULL),
   ('f4', 'id', 1, 'id', NULL), ('f4', 'id', 2, 'id', NULL), ('f4', 'qty', 1, 'qty', NULL), ('f4', 'price', 1, 'price', NULL), ('f4', 'name', 2, 'name', NULL),
   ('f4', 'total', 1, 'qty', 'qty * price'), ('f4', 'total', 1, 'price', 'qty * price'),
   ('f5', 'id', 1, 'id', NULL), ('f5', 'id', 2, 'id', NULL), ('f5', 'qty', 1, 'qty', NULL), ('f5', 'price', 1, 'price', NULL), ('f5', 'label', 2, 'name', NULL),
   ('f5', 'total', 1, 'qty', 'qty * price'), ('f5', 'total', 1, 'price', 'qty * price'),
   ('f6', 'id', 1, 'id', NULL), ('f6', 'id', 2, 'id', NULL), ('f6', 'qty', 1, 'qty', NULL), ('f6', 'label', 2, 'name', NULL),
   ('f6', 'total', 1, 'qty', 'qty * price'), ('f6', 'total', 1, 'price', 'qty * price'),
   ('f7', 'id', 1, 'id', NULL), ('f7', 'id', 2, 'id', NULL), ('f7', 'qty', 1, 'qty', NULL), ('f7', 'label', 2, 'name', NULL),
   ('f7', 'total', 1, 'qty', 'qty * price'), ('f7', 'total', 1, 'price', 'qty * price'),
   ('f8', 'id', 1, 'id', NULL), ('f8', 'id', 2, 'id', NULL), ('f8', 'twice', 1, 'qty', 'total * 2'), ('f8', 'twice', 1, 'price', 'total * 2'), ('f8', 'one', 0, NULL, '1')
  ) AS v(f, c, s, sc, t) WHERE pr <> '1' OR v.f NOT IN ('f7', 'f8')
  UNION ALL
  SELECT nb_id, 'f9', v.c, CASE v.s WHEN 1 THEN t1 WHEN 2 THEN t2 END, v.sc, v.t, pr FROM s, LATERAL (VALUES
   ('2', 'id', 1, 'id', NULL), ('2', 'id', 2, 'id', NULL), ('2', 's', 1, 'qty', 'sum(twice)'), ('2', 's', 1, 'price', 'sum(twice)'),
   ('4', 'id', 1, 'id', NULL), ('4', 'id', 2, 'id', NULL), ('4', 'twice', 1, 'qty', 'total * 2'), ('4', 'twice', 1, 'price', 'total * 2'), ('4', 'one', 0, NULL, '1')
  ) AS v(p, c, s, sc, t) WHERE v.p = CASE WHEN pr = '5' THEN '4' ELSE pr END)
"""


@query("flow_frame_ops", FRAMES_EXPECTED + """
SELECT nb_id, frame_id, "column", src_ref, src_col, transform FROM e
UNION ALL SELECT nb_id, v.f, NULL, NULL, NULL, 'unknown' FROM s, LATERAL (VALUES ('f7', '1'), ('f8', '1'), ('f9', '1'), ('f9', '3'), ('f10', '')) AS v(f, p) WHERE p IN (pr, '')
""")
def _(t):
    frames, unknown = flows.frame_provenance(t.sql(FRAME_OPS), t("b_frame_table"))
    lost = unknown.select("nb_id", "frame_id", *[F.lit(None).cast("string").alias(c) for c in ("column", "src_ref", "src_col")], F.lit("unknown").alias("transform"))
    return flows.frame_flows(frames).drop("ordinal").unionByName(lost)


def _frame(t, sql):
    return t.sql(f"SELECT nb_id, frame_id, ordinal, column, array(struct(src_ref, src_col)) AS sources, cast(NULL AS string) AS transform FROM ({sql})")


TWO_FRAMES = """SELECT DISTINCT l_orderkey AS nb_id, 'a' AS frame_id, l_linenumber AS ordinal, concat('c', l_linenumber) AS column, 'A' AS src_ref, concat('a', l_linenumber) AS src_col FROM lineitem
UNION ALL SELECT DISTINCT l_orderkey, 'b', 8 - l_linenumber, concat('c', l_linenumber + 2), 'B', concat('b', l_linenumber) FROM lineitem"""
OP = "SELECT DISTINCT l_orderkey AS nb_id, 'out' AS frame_id, '{}' AS op, 'a' AS input_frame, 'b' AS input_frame2, cast(NULL AS array<struct<out: string>>) AS args FROM lineitem"


@query("flow_join_provenance", """
WITH l AS (SELECT DISTINCT l_orderkey AS nb_id, l_linenumber AS n FROM lineitem),
c AS (SELECT nb_id, concat('c', n) AS col, 0 AS side, n AS o, 'A' AS src_ref, concat('a', n) AS src_col FROM l
      UNION ALL SELECT nb_id, concat('c', n + 2), 1, 8 - n, 'B', concat('b', n) FROM l),
f AS (SELECT nb_id, col, min(side * 100 + o) AS o FROM c GROUP BY 1, 2),
r AS (SELECT nb_id, col, cast(row_number() OVER (PARTITION BY nb_id ORDER BY o) AS integer) AS ordinal FROM f)
SELECT c.nb_id, 'out' AS frame_id, r.ordinal, c.col AS "column", src_ref, src_col, cast(NULL AS varchar) AS transform FROM c JOIN r ON c.nb_id = r.nb_id AND c.col = r.col
""")
def _(t):
    return flows.frame_flows(flows.join_frames(flows.feed(t.sql(OP.format("join")), _frame(t, TWO_FRAMES))))


@query("flow_union_provenance", """
WITH l AS (SELECT DISTINCT l_orderkey AS nb_id, l_linenumber AS n FROM lineitem)
SELECT nb_id, concat('c', n) AS "column", 'A' AS src_ref, concat('a', n) AS src_col, 'unionByName' AS how FROM l
UNION ALL SELECT a.nb_id, concat('c', a.n), 'B', concat('b', b.n), 'unionByName' FROM l a JOIN l b ON a.nb_id = b.nb_id AND a.n = b.n + 2
UNION ALL SELECT nb_id, concat('c', n), 'A', concat('a', n), 'union' FROM l
UNION ALL SELECT a.nb_id, concat('c', a.n), 'B', concat('b', b.n), 'union'
FROM (SELECT *, row_number() OVER (PARTITION BY nb_id ORDER BY n) AS r FROM l) a JOIN (SELECT *, row_number() OVER (PARTITION BY nb_id ORDER BY n DESC) AS r FROM l) b
  ON a.nb_id = b.nb_id AND a.r = b.r
""")
def _(t):
    frame = _frame(t, TWO_FRAMES)
    out = []
    for how in ("unionByName", "union"):
        made = flows.union_frames(flows.feed(t.sql(OP.format(how)), frame))
        out.append(flows.frame_flows(made).select("nb_id", "column", "src_ref", "src_col", F.lit(how).alias("how")))
    return out[0].union(out[1])


@query("flow_group_agg_provenance", """
WITH l AS (SELECT DISTINCT l_orderkey AS nb_id, l_linenumber AS n FROM lineitem)
SELECT nb_id, 0 AS ordinal, 'c1' AS "column", CASE WHEN h THEN 'A' END AS src_ref, CASE WHEN h THEN 'a1' END AS src_col, cast(NULL AS varchar) AS transform
FROM (SELECT nb_id, bool_or(n = 1) AS h FROM l GROUP BY 1)
UNION ALL SELECT a.nb_id, 2, 'total', CASE WHEN x.n IS NULL THEN NULL ELSE 'A' END, concat('a', x.n), 'sum(c2 + c3)'
FROM (SELECT DISTINCT nb_id FROM l) a LEFT JOIN l x ON a.nb_id = x.nb_id AND x.n IN (2, 3)
""".replace("concat('a', x.n)", "CASE WHEN x.n IS NULL THEN NULL ELSE concat('a', x.n) END"))
def _(t):
    args = _args(_arg("c1", None, "c1"), _arg(None, "count(1)", "c2"), _arg("total", "sum(c2 + c3)", "c2", "c3"))
    op = t.sql(f"SELECT *, {args} AS args FROM (SELECT DISTINCT l_orderkey AS nb_id, 'out' AS frame_id, 'groupAgg' AS op, 'a' AS input_frame, cast(NULL AS string) AS input_frame2 FROM lineitem)")
    return flows.frame_flows(flows.project_frames(op, flows.feed(op, _frame(t, TWO_FRAMES)))).drop("frame_id")


STATEMENTS = "SELECT o_orderkey AS stmt_id, concat('T_', o_custkey) AS target_ref, concat('S_', o_orderpriority) AS source_ref FROM orders"
COLUMNS = """SELECT concat('S_', o_orderpriority) AS ref, concat('k', n_nationkey) AS column_name FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN nation
UNION ALL SELECT concat('T_', c_custkey), concat('k', n_nationkey) FROM customer JOIN nation ON n_regionkey = c_custkey % 5 WHERE c_custkey % 7 <> 0"""


@query("flow_merge_star", """
SELECT o_orderkey AS stmt_id, concat('T_', o_custkey) AS to_table, concat('k', n_nationkey) AS to_column, concat('S_', o_orderpriority) AS from_table,
       concat('k', n_nationkey) AS from_column, cast(NULL AS varchar) AS transform
FROM orders, nation WHERE o_custkey % 7 = 0 OR n_regionkey = o_custkey % 5""")
def _(t):
    return flows.merge_star(t.sql(STATEMENTS), t.sql(COLUMNS))


@query("flow_merge_assignments", """
SELECT DISTINCT ok AS stmt_id, 'T' AS to_table, concat('c', ln) AS to_column, CASE WHEN ln = 2 THEN 'S' WHEN ln = 3 THEN 'T' END AS from_table, concat('x', pk) AS from_column,
       CASE WHEN ln = 3 THEN 'upper(t.x)' END AS transform FROM b_line WHERE ln <> 6""")
def _(t):
    rows = t.sql("""SELECT ok AS stmt_id, ln AS ordinal, 'T' AS target_ref, CASE WHEN ln = 6 THEN '' ELSE concat('c', ln) END AS to_column, 'upper(t.x)' AS expr, ln <> 3 AS is_column,
        array(struct(CASE ln WHEN 2 THEN 's' WHEN 3 THEN 't' WHEN 4 THEN 'who' END AS alias, concat('x', pk) AS column)) AS refs, 1 AS n_columns, 1 AS n_values FROM b_line
        UNION ALL SELECT ok, ln, 'T', 'bad', 'y', true, array(struct('s' AS alias, 'y' AS column)), 2, 1 FROM b_line""")
    alias = t.sql("SELECT o_orderkey AS stmt_id, " + _inline(("alias", "ref"), ("'s'", "'S'"), ("'t'", "'T'")) + " FROM orders")
    return flows.merge_assignments(rows, alias)


@query("flow_write_only", """
SELECT o_orderkey AS stmt_id, 'write' AS access, concat('T_', o_custkey % 3) AS ref FROM orders WHERE o_orderstatus IN ('F', 'O')
UNION SELECT l_orderkey, 'read', concat('T_', l_linenumber) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O') AND l_linenumber <> o_custkey % 3""")
def _(t):
    rows = t.sql("""SELECT o_orderkey AS stmt_id, CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'O' THEN 'delete' ELSE 'insert' END AS verb, 'write' AS access, concat('T_', o_custkey % 3) AS ref FROM orders
        UNION ALL SELECT l_orderkey, CASE o_orderstatus WHEN 'F' THEN 'update' WHEN 'O' THEN 'delete' ELSE 'insert' END, 'read', concat('T_', l_linenumber)
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
    return flows.write_only(rows)


FLOWS = """SELECT l_orderkey AS nb_id, l_orderkey AS run_id, concat('T_', l_linenumber % 3) AS to_table, concat('c', l_partkey % 4) AS to_column,
  CASE WHEN l_suppkey % 2 = 0 THEN concat('S_', l_suppkey % 4) END AS from_table, concat('x', l_linenumber % 2) AS from_column,
  concat('t', l_partkey) AS transform, l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS ordinal, CASE WHEN l_returnflag = 'R' THEN 'sql' ELSE 'chain' END AS engine FROM lineitem"""


@query("flow_dedup", f"""
SELECT nb_id, to_table, to_column, from_table, from_column, arg_min(transform, ordinal) AS transform FROM ({FLOWS}) GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return flows.dedup(t.sql(FLOWS), ["nb_id"])


@query("flow_engine_priority", f"""
WITH f AS ({FLOWS}) SELECT nb_id, to_table, to_column, from_column, engine, ordinal FROM f
WHERE engine = 'sql' OR (nb_id, to_table) NOT IN (SELECT (nb_id, to_table) FROM f WHERE engine = 'sql')""".replace("(SELECT (nb_id, to_table)", "(SELECT nb_id, to_table"))
def _(t):
    return flows.prefer_statements(t.sql(FLOWS)).select("nb_id", "to_table", "to_column", "from_column", "engine", "ordinal")


@query("flow_owner_resolution", f"""
WITH f AS ({FLOWS}), r AS (SELECT DISTINCT l_orderkey AS run_id, concat('R_', l_linenumber) AS ref, l_linenumber % 2 AS x FROM lineitem WHERE l_returnflag <> 'A'),
o AS (SELECT run_id, x, min(ref) AS owner FROM r GROUP BY 1, 2 HAVING count(*) = 1)
SELECT f.run_id, to_table, to_column, coalesce(from_table, owner) AS from_table, from_column, ordinal FROM f LEFT JOIN o ON f.run_id = o.run_id AND f.from_column = concat('x', o.x)""")
def _(t):
    reads = t.sql("SELECT l_orderkey AS run_id, concat('R_', l_linenumber) AS ref FROM lineitem WHERE l_returnflag <> 'A'")
    cols = t.sql("SELECT DISTINCT concat('R_', l_linenumber) AS ref, concat('x', l_linenumber % 2) AS column_name FROM lineitem")
    return flows.resolve_owner(t.sql(FLOWS), reads, cols).select("run_id", "to_table", "to_column", "from_table", "from_column", "ordinal")


@query("flow_attribution", """
SELECT lid AS plan_id, v.to_column, v.from_table, v.from_column, v.transform FROM b_line, LATERAL (VALUES
  ('a', concat('T_', pk), 'a', NULL, true), ('b', concat('S_', sk), 'y', concat('y * ', ln), true), ('b', NULL, 'q', concat('y * ', ln), true), ('c', concat('S_', sk), 'c', NULL, ln > 3)
 ) AS v(to_column, from_table, from_column, transform, ok) WHERE v.ok""")
def _(t):
    out = t.sql("SELECT lid AS plan_id, " + _inline(
        ("column", "attr_id"), ("'a'", "1"), ("'b'", "5"), ("'c'", "CASE WHEN ln > 3 THEN 9 ELSE 3 END"), ("'d'", "99")) + " FROM b_line")
    expr = t.sql("""SELECT lid AS plan_id, 'b' AS column, concat('y * ', ln) AS expr,
            array(named_struct('attr_id', 2, 'name', 'y'), named_struct('attr_id', 77, 'name', 'q')) AS refs FROM b_line
        UNION ALL SELECT lid, 'c', 'c', CASE WHEN ln > 3 THEN array(named_struct('attr_id', 3, 'name', 'c')) ELSE cast(array() AS array<struct<attr_id: int, name: string>>) END FROM b_line""")
    owner = t.sql("SELECT lid AS plan_id, " + _inline(
        ("attr_id", "ref"), ("1", "concat('T_', pk)"), ("2", "concat('S_', sk)"), ("CASE WHEN ln > 3 THEN 3 ELSE 33 END", "concat('S_', sk)")) + " FROM b_line")
    return flows.attribute_flows(out, expr, owner)


@query("flow_output_schema", """
SELECT l_orderkey AS run_id, concat('T_', l_linenumber % 3) AS ref, concat('c', l_partkey % 4) AS column_name, min(l_partkey * 10 + l_linenumber) AS ordinal
FROM lineitem WHERE (l_orderkey, l_linenumber % 3) NOT IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1, 2, 3""")
def _(t):
    out = t.sql("SELECT l_orderkey AS run_id, concat('T_', l_linenumber % 3) AS ref, l_partkey * 10 + l_linenumber AS ordinal, concat('c', l_partkey % 4) AS column_name FROM lineitem")
    given = t.sql("SELECT o_orderkey AS run_id, 'T_1' AS ref FROM orders WHERE o_orderstatus = 'F'")
    return flows.output_schema(out, given)


STEPS = """SELECT user_id AS sequence_id, cast(event_id AS int) AS step, concat('T_', cast(get_json_object(props, '$.k') AS int) % 10) AS ref, event_type, cast(value AS int) % 3 AS v FROM events"""


@query("flow_schema_carry", """
WITH e AS (SELECT user_id AS sequence_id, cast(event_id AS integer) AS step, concat('T_', cast(json_extract_string(props, '$.k') AS integer) % 10) AS ref, event_type FROM events),
r AS (SELECT DISTINCT sequence_id, step, ref FROM e WHERE event_type IN ('view', 'click', 'error'))
SELECT r.sequence_id, r.step, r.ref, CASE WHEN l.step IS NOT NULL THEN 'resolved' WHEN max(s.step) IS NOT NULL THEN 'carried' ELSE 'unresolved' END AS status,
       CASE WHEN l.step IS NULL THEN max(s.step) END AS from_step
FROM r LEFT JOIN e l ON l.sequence_id = r.sequence_id AND l.step = r.step AND l.ref = r.ref AND l.event_type = 'error'
LEFT JOIN e s ON s.sequence_id = r.sequence_id AND s.ref = r.ref AND s.step < r.step AND s.event_type IN ('purchase', 'signup') GROUP BY 1, 2, 3, l.step""")
def _(t):
    rows = t.sql(STEPS)
    kept = lambda *kinds: rows.filter(F.col("event_type").isin(*kinds)).select("sequence_id", "step", "ref")
    return flows.carry_schemas(kept("view", "click", "error"), kept("purchase", "signup"), kept("error"))


@query("flow_schema_lookup", """
WITH r AS (SELECT DISTINCT l_orderkey AS nb_id, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, concat('w', l_orderkey % 3) AS own FROM lineitem),
p AS (SELECT DISTINCT nb_id, concat(CASE WHEN ln = 1 THEN '' ELSE concat('Space', sk) END, '/L/T_', pk) AS ref, pk,
        CASE WHEN ln <> 1 AND sk % 2 = 0 THEN concat('w', sk % 5) ELSE own END AS ws FROM r WHERE ln <> 7)
SELECT nb_id, ref, ws AS workspace_id, CASE WHEN pk % 4 = 0 THEN concat(ws, '/Tables/T_', pk) END AS table_dir,
       CASE WHEN pk % 4 <> 0 THEN concat('no table of that name in workspace ', ws) END AS reason FROM p""")
def _(t):
    rows = t.sql("""SELECT l_orderkey AS nb_id, concat('w', l_orderkey % 3) AS workspace_id, CASE l_linenumber WHEN 1 THEN concat('/L/T_', l_partkey)
        WHEN 7 THEN concat('Space', l_suppkey, '/L/Files%2FT_', l_partkey) ELSE concat('Space', l_suppkey, '/L/T_', l_partkey) END AS ref FROM lineitem""")
    spaces = t.sql("SELECT concat('space', s_suppkey) AS key, concat('w', s_suppkey % 5) AS workspace_id FROM supplier WHERE s_suppkey % 2 = 0")
    dirs = t.sql("""SELECT concat('w', i) AS workspace_id, concat('t_', p_partkey) AS short, concat('w', i, '/Tables/T_', p_partkey) AS table_dir
        FROM part JOIN (VALUES (0), (1), (2), (3), (4)) AS v(i) ON p_partkey % 4 = 0""")
    return flows.lookup_schemas(rows, spaces, dirs)
