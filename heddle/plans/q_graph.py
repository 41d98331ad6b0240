"""Registered graph and model queries. The oracles go by the business keys of the
order tables (which line belongs to which supplier, part, customer), not by
walking the bound graph again."""

from pyspark.sql import functions as F

from heddle.operators import graph as g
from heddle.operators import model as md
from heddle.session import Passing, cut

from .registry import query

M = "model_id"

SOURCE_COLUMNS = """SELECT model_id, entity_id AS start FROM b_entity
WHERE kind = 'attribute' AND layer_name IN ('Landing', 'Bronze') AND NOT has_children"""


@query("impact_reach", """
WITH hits AS (
  SELECT model_id, concat('s:', sk) AS start, lid, ck, pr, ls FROM b_line
  UNION ALL SELECT model_id, concat('p:', pk), lid, ck, pr, ls FROM b_line)
SELECT model_id, start, 'Silver' AS layer_name, count(DISTINCT lid) AS reached FROM hits GROUP BY 1, 2
UNION ALL
SELECT model_id, start, 'Gold', count(DISTINCT concat(ck, '-', pr)) FROM hits WHERE ls = 'O' GROUP BY 1, 2
""")
def _(t):
    reached = g.impact_reach(t.sql(SOURCE_COLUMNS), t("b_entity"), t("b_transition"))
    return g.impact_tally(reached)


@query("impact_list", """
WITH hits AS (
  SELECT model_id, concat('cp:', ck, '-', pr) AS start, sk, pk, lid, ok, ln FROM b_line WHERE ls = 'O'),
up AS (
  SELECT model_id, start, lid AS entity_id, concat('Silver / order_', ok, ' / line_', ln) AS path FROM hits
  UNION SELECT h.model_id, start, concat('s:', h.sk), concat('Landing / ', oname, ' / ', sname)
        FROM hits h JOIN b_model_supplier m ON h.model_id = m.model_id AND h.sk = m.sk
  UNION SELECT h.model_id, start, concat('p:', h.pk), concat('Bronze / ', brand, ' / ', ptype, ' / ', pname)
        FROM hits h JOIN b_model_part m ON h.model_id = m.model_id AND h.pk = m.pk),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_id, start ORDER BY path, entity_id) AS position,
         count(*) OVER (PARTITION BY model_id, start) AS total FROM up)
SELECT model_id, start, position, entity_id, path, total FROM ranked
""")
def _(t):
    starts = t.sql("SELECT model_id, entity_id AS start FROM b_entity WHERE kind = 'attribute' AND layer_name = 'Gold'")
    entity = t("b_entity")
    with Passing(t.spark) as here:
        reached = here.kept(g.impact_reach(starts, entity, t("b_transition"), "upstream"))
    return g.impact_list(reached, entity)


@query("impact_by_object", """
WITH brand_hits AS (
  SELECT DISTINCT l.model_id, concat('b:', m.brand) AS start, ok, lid, ck, pr, ls
  FROM b_line l JOIN b_model_part m ON l.model_id = m.model_id AND l.pk = m.pk)
SELECT model_id, start, concat('o:', ok) AS holder_id, count(DISTINCT lid) AS items FROM brand_hits GROUP BY 1, 2, 3
UNION ALL
SELECT model_id, start, concat('c:', ck), count(DISTINCT pr) FROM brand_hits WHERE ls = 'O' GROUP BY 1, 2, 3
UNION ALL
SELECT o.model_id, concat('o:', o.ok), concat('c:', o.ck), count(DISTINCT l.pr)
FROM b_model_order o LEFT JOIN b_line l ON o.ok = l.ok AND l.ls = 'O' GROUP BY 1, 2, 3
""")
def _(t):
    starts = t.sql("""SELECT model_id, entity_id AS start FROM b_entity
                      WHERE kind = 'object' AND layer_name IN ('Bronze', 'Silver')""")
    hits = g.impact_by_object(starts, t("b_entity"), t("b_transition"))
    return hits.groupBy(M, "start", "holder_id").agg(F.count("item").alias("items"))


PATHS = """
WITH firsts AS (
  SELECT model_id, concat('s:', sk) AS start, concat('t1:', lid) AS hop, ok * 64 + ln * 8 + 1 AS ord, lid, ck, pr, ls FROM b_line
  UNION ALL SELECT model_id, concat('p:', pk), concat('t2:', lid), ok * 64 + ln * 8 + 2, lid, ck, pr, ls FROM b_line),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_id, start ORDER BY ord, hop) AS path_no FROM firsts)
"""


@query("trace_paths", PATHS + """
SELECT model_id, start, path_no,
       concat(start, '>', lid, CASE WHEN ls = 'O' THEN concat('>cp:', ck, '-', pr) ELSE '' END) AS path
FROM ranked
""")
def _(t):
    paths, _ = g.trace_paths(t.sql(SOURCE_COLUMNS), t("b_entity"), t("b_transition"))
    return paths.select(M, "start", "path_no", F.array_join("nodes", ">").alias("path"))


@query("trace_edges", """
WITH l AS (SELECT model_id, concat('s:', sk) AS start, concat('t1:', lid) AS hop, lid, ck, pr, ls FROM b_line
  UNION ALL SELECT model_id, concat('p:', pk), concat('t2:', lid), lid, ck, pr, ls FROM b_line)
SELECT model_id, start, hop AS transition_id, start AS node, lid AS nxt, ls <> 'O' AS goal FROM l
UNION ALL SELECT model_id, start, concat('t3:', lid), lid, concat('cp:', ck, '-', pr), true FROM l WHERE ls = 'O'
""")
def _(t):
    return g.trace_edges(t.sql(SOURCE_COLUMNS), t("b_entity"), t("b_transition"))


@query("trace_hops", PATHS + """
SELECT model_id, start, path_no, 0 AS hop_no, hop AS transition_id, start AS source, lid AS target,
       CASE WHEN hop LIKE 't2:%' AND ls = 'O' THEN concat('amount * ', split_part(lid, '-', 4)) END AS transform,
       CASE WHEN hop LIKE 't2:%' AND rf = 'R' THEN 'notebook run' END AS claim, cast(NULL AS varchar) AS via,
       hop LIKE 't2:%' AND rf = 'R' AS derived
FROM (SELECT r.*, b.rf FROM ranked r JOIN b_line b ON r.model_id = b.model_id AND r.lid = b.lid)
UNION ALL
SELECT model_id, start, path_no, 1, concat('t3:', lid), lid, concat('cp:', ck, '-', pr), NULL, NULL,
       CASE WHEN cast(split_part(lid, '-', 4) AS integer) <= 2 THEN concat('step_', split_part(lid, '-', 4)) END, false
FROM ranked WHERE ls = 'O'
""")
def _(t):
    transition = t("b_transition")
    paths, _ = g.trace_paths(t.sql(SOURCE_COLUMNS), t("b_entity"), transition)
    return g.trace_hops(paths, transition, t("b_property"))


@query("trace_level", """
SELECT DISTINCT model_id, concat('s:', sk) AS start, 'attribute' AS level FROM b_line
UNION ALL SELECT DISTINCT model_id, concat('p:', pk), 'attribute' FROM b_line
UNION ALL SELECT model_id, concat('o:', ok), 'object' FROM b_model_order
""")
def _(t):
    starts = t.sql(SOURCE_COLUMNS + " UNION ALL SELECT model_id, entity_id FROM b_entity WHERE kind = 'object' AND layer_name = 'Silver'")
    entity = t("b_entity")
    paths, _ = g.trace_paths(starts, entity, t("b_transition"))
    return g.trace_levels(paths, entity)[1]


@query("trace_object_fallback", """
SELECT model_id, lid AS start, cast(1 AS bigint) AS n_paths, false AS truncated,
       CASE WHEN ls = 'O' THEN 'own' ELSE 'object' END AS answered,
       CASE WHEN ls = 'O' THEN concat(lid, '>cp:', ck, '-', pr) ELSE concat('o:', ok, '>c:', ck) END AS path
FROM b_line
""")
def _(t):
    starts = t.sql("SELECT model_id, entity_id AS start FROM b_entity WHERE kind = 'attribute' AND layer_name = 'Silver'")
    paths, status = g.trace_with_fallback(starts, t("b_entity"), t("b_transition"))
    return status.join(paths, [M, "start"], "left").select(
        M, "start", "n_paths", "truncated", "answered", F.array_join("nodes", ">").alias("path")
    )


@query("trace_neighbourhood", """
WITH o AS (SELECT model_id, concat('c:', ck) AS start, ok FROM b_model_order),
l AS (SELECT model_id, concat('c:', ck) AS start, lid, sk, pk, ok FROM b_line WHERE ls = 'O'),
ids AS (
  SELECT concat('m', c_nationkey) AS model_id, concat('c:', c_custkey) AS start, concat('c:', c_custkey) AS id FROM customer
  UNION SELECT concat('m', c_nationkey), concat('c:', c_custkey), 'L3' FROM customer
  UNION SELECT model_id, concat('c:', ck), concat('cp:', ck, '-', pr) FROM b_line
  UNION SELECT model_id, start, concat('o:', ok) FROM o
  UNION SELECT model_id, start, 'L2' FROM o
  UNION SELECT model_id, start, lid FROM l
  UNION SELECT model_id, start, concat('s:', sk) FROM l
  UNION SELECT model_id, start, 'L0' FROM l
  UNION SELECT model_id, start, 'L1' FROM l
  UNION SELECT l.model_id, start, concat('sn:', snk) FROM l JOIN b_model_supplier m ON l.model_id = m.model_id AND l.sk = m.sk
  UNION SELECT model_id, start, concat('p:', pk) FROM l
  UNION SELECT l.model_id, start, concat('b:', brand) FROM l JOIN b_model_part m ON l.model_id = m.model_id AND l.pk = m.pk
  UNION SELECT l.model_id, start, concat('g:', brand, '|', ptype) FROM l JOIN b_model_part m ON l.model_id = m.model_id AND l.pk = m.pk)
SELECT model_id, start, split_part(id, ':', 1) AS prefix, count(*) AS n, min(id) AS first_id, max(id) AS last_id
FROM ids GROUP BY 1, 2, 3
""")
def _(t):
    seeds = t.sql("SELECT model_id, entity_id AS start FROM b_entity WHERE kind = 'object' AND layer_name = 'Gold'")
    near = g.neighbourhood(seeds, t("b_entity"), t("b_transition"), "upstream")
    return near.groupBy(M, "start", F.split_part("entity_id", F.lit(":"), F.lit(1)).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.min("entity_id").alias("first_id"), F.max("entity_id").alias("last_id")
    )


KEEP = """SELECT model_id, entity_id FROM b_entity
WHERE kind = 'layer' OR layer_name = 'Bronze' AND name <> 'PROMO'
   OR layer_name = 'Gold' AND entity_id IN (SELECT entity_id FROM b_property WHERE key = 'Segment' AND value = 'BUILDING')
   OR layer_name = 'Silver' AND kind = 'attribute'"""


@query("trace_prune", """
SELECT model_id, 'entity' AS part, 'L3' AS id FROM (SELECT DISTINCT concat('m', c_nationkey) AS model_id FROM customer WHERE c_mktsegment = 'BUILDING')
UNION ALL SELECT concat('m', c_nationkey), 'entity', concat('c:', c_custkey) FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT DISTINCT model_id, 'entity', 'L1' FROM b_model_part
UNION ALL SELECT DISTINCT model_id, 'entity', concat('b:', brand) FROM b_model_part
UNION ALL SELECT DISTINCT model_id, 'entity', concat('g:', brand, '|', ptype) FROM b_model_part WHERE ptype <> 'PROMO'
UNION ALL SELECT model_id, 'entity', concat('p:', pk) FROM b_model_part WHERE ptype <> 'PROMO'
UNION ALL SELECT model_id, 'transition', concat('t2:', lid) FROM b_line
""")
def _(t):
    entity, edges = g.prune(cut(t.sql(KEEP)), t("b_entity"), t("b_transition"))
    return entity.select(M, F.lit("entity").alias("part"), F.col("entity_id").alias("id")).union(
        edges.select(M, F.lit("transition"), "transition_id")
    )


ITEM_EDGES = """SELECT model_id, concat('o:', cast(ok AS string)) AS source, concat('c:', cast(ck AS string)) AS target FROM b_model_order
UNION ALL SELECT model_id, lid, concat('o:', cast(ok AS string)) FROM b_line"""
ITEMS = """SELECT concat('m', cast(c_nationkey AS string)) AS model_id, concat('c:', cast(c_custkey AS string)) AS node FROM customer
UNION ALL SELECT model_id, concat('o:', cast(ok AS string)) FROM b_model_order
UNION ALL SELECT model_id, lid FROM b_line"""


@query("trace_undirected_component", f"""
WITH owned AS (
  SELECT concat('m', c_nationkey) AS model_id, c_custkey AS ck, concat('c:', c_custkey) AS node FROM customer
  UNION ALL SELECT model_id, ck, concat('o:', ok) FROM b_model_order
  UNION ALL SELECT model_id, ck, lid FROM b_line)
SELECT model_id, node, min(node) OVER (PARTITION BY ck) AS component FROM owned
""")
def _(t):
    return g.components(t.sql(ITEMS), t.sql(ITEM_EDGES))


@query("graph_longest_path", """
WITH o AS (SELECT b.model_id, b.ok, b.ck, CASE WHEN max(l.lid) IS NULL THEN 0 ELSE 2 END AS depth
           FROM b_model_order b LEFT JOIN b_line l ON b.ok = l.ok GROUP BY 1, 2, 3)
SELECT DISTINCT model_id, concat('s:', sk) AS node, 0 AS depth FROM b_line
UNION ALL SELECT DISTINCT model_id, concat('p:', pk), 0 FROM b_line
UNION ALL SELECT model_id, lid, 1 FROM b_line
UNION ALL SELECT model_id, concat('o:', ok), depth FROM o
UNION ALL SELECT concat('m', c_nationkey), concat('c:', c_custkey), coalesce(max(o.depth) + 1, 0)
FROM customer LEFT JOIN o ON c_custkey = o.ck GROUP BY 1, 2
UNION ALL SELECT DISTINCT model_id, concat('cp:', ck, '-', pr), 2 FROM b_line WHERE ls = 'O'
""")
def _(t):
    edges = t.sql("SELECT model_id, source, target FROM b_transition WHERE transition_id NOT LIKE 't5:%' UNION ALL SELECT model_id, lid, concat('o:', cast(ok AS string)) FROM b_line")
    nodes = edges.select(M, F.col("source").alias("node")).union(edges.select(M, "target")).union(t.sql(ITEMS))
    return g.longest_path(nodes, edges)


@query("model_dangling", "SELECT model_id, concat('t5:', ok) AS transition_id, 'target' AS missing FROM b_model_order WHERE st = 'P'")
def _(t):
    return g.dangling(t("b_transition"), t("b_entity"))


@query("model_ancestors", """
WITH p AS (
  SELECT concat('p:', pk) AS id, model_id, brand, ptype, pname FROM b_model_part)
SELECT e.model_id, e.entity_id, v.ancestor_id, v.distance, e.address
FROM (SELECT model_id, id AS entity_id, concat(brand, '/', ptype, '/', pname) AS address, brand, ptype FROM p) e,
     LATERAL (VALUES (concat('g:', brand, '|', ptype), 1), (concat('b:', brand), 2), ('L1', 3)) AS v(ancestor_id, distance)
UNION ALL
SELECT DISTINCT model_id, concat('g:', brand, '|', ptype), v.a, v.d, concat(brand, '/', ptype)
FROM p, LATERAL (VALUES (concat('b:', brand), 1), ('L1', 2)) AS v(a, d)
UNION ALL SELECT DISTINCT model_id, concat('b:', brand), 'L1', 1, brand FROM p
UNION ALL SELECT model_id, lid, v.a, v.d, concat('order_', ok, '/line_', ln)
FROM b_line, LATERAL (VALUES (concat('o:', ok), 1), ('L2', 2)) AS v(a, d)
UNION ALL SELECT model_id, concat('o:', ok), 'L2', 1, concat('order_', ok) FROM b_model_order
UNION ALL SELECT model_id, concat('s:', sk), v.a, v.d, concat(oname, '/', sname)
FROM b_model_supplier, LATERAL (VALUES (concat('sn:', snk), 1), ('L0', 2)) AS v(a, d)
UNION ALL SELECT DISTINCT model_id, concat('sn:', snk), 'L0', 1, oname FROM b_model_supplier
UNION ALL SELECT concat('m', c_nationkey), concat('c:', c_custkey), 'L3', 1, c_name FROM customer
UNION ALL SELECT DISTINCT model_id, concat('cp:', ck, '-', pr), v.a, v.d, concat(c_name, '/', lower(pname))
FROM b_line JOIN customer ON ck = c_custkey, LATERAL (VALUES (concat('c:', ck), 1), ('L3', 2)) AS v(a, d)
""")
def _(t):
    entity = t("b_entity")
    with Passing(t.spark) as here:
        up = here.kept(g.ancestors(entity))
    return up.join(g.entity_paths(entity, up), [M, "entity_id"])


@query("model_counts", """
WITH e AS (
  SELECT model_id, 4 AS n FROM (SELECT DISTINCT concat('m', n_nationkey) AS model_id FROM nation)
  UNION ALL SELECT model_id, count(DISTINCT snk) + count(*) FROM b_model_supplier GROUP BY 1
  UNION ALL SELECT model_id, count(DISTINCT brand) + count(DISTINCT concat(brand, ptype)) + count(*) FROM b_model_part GROUP BY 1
  UNION ALL SELECT model_id, count(*) FROM b_model_order GROUP BY 1
  UNION ALL SELECT model_id, count(*) + count(DISTINCT concat(ck, '-', pr)) FROM b_line GROUP BY 1
  UNION ALL SELECT concat('m', c_nationkey), count(*) FROM customer GROUP BY 1),
t AS (
  SELECT model_id, count(*) * 2 + count(*) FILTER (ls = 'O') AS n FROM b_line GROUP BY 1
  UNION ALL SELECT model_id, count(*) + count(*) FILTER (st = 'P') FROM b_model_order GROUP BY 1)
SELECT a.model_id, a.entities, cast(4 AS bigint) AS layers, coalesce(b.transitions, 0) AS transitions
FROM (SELECT model_id, cast(sum(n) AS bigint) AS entities FROM e GROUP BY 1) a
LEFT JOIN (SELECT model_id, cast(sum(n) AS bigint) AS transitions FROM t GROUP BY 1) b ON a.model_id = b.model_id
""")
def _(t):
    return md.model_counts(t("b_entity"), t("b_transition"))


@query("model_descendant_counts", """
SELECT model_id, concat('p:', pk) AS entity_id, cast(0 AS bigint) AS direct, cast(0 AS bigint) AS total FROM b_model_part
UNION ALL SELECT model_id, concat('g:', brand, '|', ptype), count(*), count(*) FROM b_model_part GROUP BY model_id, brand, ptype
UNION ALL SELECT model_id, concat('b:', brand), count(DISTINCT ptype), count(DISTINCT ptype) + count(*) FROM b_model_part GROUP BY model_id, brand
UNION ALL SELECT model_id, concat('s:', sk), 0, 0 FROM b_model_supplier
UNION ALL SELECT model_id, concat('sn:', snk), count(*), count(*) FROM b_model_supplier GROUP BY model_id, snk
UNION ALL SELECT model_id, lid, 0, 0 FROM b_line
UNION ALL SELECT o.model_id, concat('o:', o.ok), count(lid), count(lid) FROM b_model_order o LEFT JOIN b_line l ON o.ok = l.ok GROUP BY o.model_id, o.ok
UNION ALL SELECT DISTINCT model_id, concat('cp:', ck, '-', pr), 0, 0 FROM b_line
UNION ALL SELECT concat('m', c_nationkey), concat('c:', c_custkey), count(DISTINCT pr), count(DISTINCT pr)
FROM customer LEFT JOIN b_line ON c_custkey = ck GROUP BY c_nationkey, c_custkey
""")
def _(t):
    entity = t("b_entity")
    return md.descendant_counts(entity, g.ancestors(entity))


@query("gaps_scan", """
SELECT model_id, concat('sn:', snk) AS entity_id, 'object' AS kind, concat('Landing / ', oname) AS path FROM (SELECT DISTINCT model_id, snk, oname FROM b_model_supplier)
UNION ALL SELECT DISTINCT model_id, concat('b:', brand), 'object', concat('Bronze / ', brand) FROM b_model_part
UNION ALL SELECT concat('m', c_nationkey), concat('c:', c_custkey), 'object', concat('Gold / ', c_name)
FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT model_id, concat('cp:', ck, '-', pr), 'attribute', concat('Gold / ', max(c_name), ' / ', lower(max(pname)))
FROM b_line JOIN customer ON ck = c_custkey GROUP BY model_id, ck, pr HAVING count(*) FILTER (ls = 'O') = 0
""")
def _(t):
    return md.gaps(t("b_entity"), t("b_transition")).drop("layer_name")


@query("gaps_dead_ends", """
WITH found AS (
  SELECT model_id, lid AS entity_id, concat('Silver / order_', ok, ' / line_', ln) AS path FROM b_line WHERE ls <> 'O'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY path, entity_id) AS position,
                  count(*) OVER (PARTITION BY model_id) AS total FROM found)
SELECT model_id, entity_id, path, position, total FROM ranked
""")
def _(t):
    rows = md.gaps(t("b_entity"), t("b_transition"), "downstream", kind="attribute", layer=" silver ")
    return md.by_path(cut(rows)).drop("kind", "layer_name")


@query("gaps_not_reaching_layer", """
SELECT DISTINCT model_id, concat('sn:', snk) AS entity_id, concat('Landing / ', oname) AS path FROM b_model_supplier
UNION ALL SELECT DISTINCT model_id, concat('b:', brand), concat('Bronze / ', brand) FROM b_model_part
UNION ALL SELECT l.model_id, concat('s:', l.sk), max(concat('Landing / ', oname, ' / ', sname)) FROM b_line l
  JOIN b_model_supplier m ON l.model_id = m.model_id AND l.sk = m.sk GROUP BY l.model_id, l.sk HAVING count(*) FILTER (ls = 'O') = 0
UNION ALL SELECT l.model_id, concat('p:', l.pk), max(concat('Bronze / ', brand, ' / ', ptype, ' / ', m.pname)) FROM b_line l
  JOIN b_model_part m ON l.model_id = m.model_id AND l.pk = m.pk GROUP BY l.model_id, l.pk HAVING count(*) FILTER (ls = 'O') = 0
UNION ALL SELECT model_id, lid, concat('Silver / order_', ok, ' / line_', ln) FROM b_line WHERE ls <> 'O'
""")
def _(t):
    return md.gaps_not_reaching(t("b_entity"), t("b_transition"), "Gold").drop("kind", "layer_name")


@query("coverage_model", """
WITH n AS (
  SELECT model_id, 'L0' AS layer_id, count(DISTINCT snk) AS o, 0 AS ot, count(*) AS a, count(*) AS tr FROM b_model_supplier GROUP BY 1
  UNION ALL SELECT model_id, 'L1', count(DISTINCT brand), 0, count(*), count(*) FROM b_model_part GROUP BY 1
  UNION ALL SELECT model_id, 'L2', count(*), count(*), 0, 0 FROM b_model_order GROUP BY 1
  UNION ALL SELECT model_id, 'L2', 0, 0, count(*), count(*) FROM b_line GROUP BY 1
  UNION ALL SELECT concat('m', c_nationkey), 'L3', count(*), count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)), 0, 0 FROM customer GROUP BY 1
  UNION ALL SELECT model_id, 'L3', 0, 0, count(DISTINCT concat(ck, '-', pr)), count(DISTINCT concat(ck, '-', pr)) FILTER (ls = 'O') FROM b_line GROUP BY 1
  UNION ALL SELECT model_id, layer_id, 0, 0, 0, 0 FROM b_layer),
s AS (SELECT model_id, layer_id, sum(o) o, sum(ot) ot, sum(a) a, sum(tr) tr FROM n GROUP BY GROUPING SETS ((model_id, layer_id), (model_id))),
e AS (SELECT model_id, sum(n) AS n, sum(d) AS d, sum(x) AS x
  FROM (SELECT model_id, 2 + (CASE WHEN ls = 'O' THEN 1 ELSE 0 END) AS n, CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS d, 0 AS x FROM b_line
        UNION ALL SELECT model_id, 1, 0, CASE WHEN st = 'P' THEN 1 ELSE 0 END FROM b_model_order) GROUP BY 1)
SELECT s.model_id, s.layer_id, b.layer_name, cast(o AS bigint) AS objects, cast(ot AS bigint) AS objects_traced,
       cast(a AS bigint) AS attributes, cast(tr AS bigint) AS attributes_traced, cast(o - ot AS bigint) AS objects_untraced, cast(a - tr AS bigint) AS attributes_untraced,
       CASE WHEN s.layer_id IS NULL THEN cast(coalesce(e.n, 0) AS bigint) END AS transitions, CASE WHEN s.layer_id IS NULL THEN cast(coalesce(d, 0) AS bigint) END AS derived,
       CASE WHEN s.layer_id IS NULL THEN cast(coalesce(e.n - d, 0) AS bigint) END AS hand_drawn, CASE WHEN s.layer_id IS NULL THEN cast(coalesce(x, 0) AS bigint) END AS dangling
FROM s LEFT JOIN b_layer b ON s.model_id = b.model_id AND s.layer_id = b.layer_id LEFT JOIN e ON s.model_id = e.model_id
""")
def _(t):
    return md.coverage_by_layer(t("b_entity"), t("b_transition"), t("b_property"))


@query("coverage_edges", """
SELECT model_id, cast(sum(n) AS bigint) AS transitions, cast(sum(d) AS bigint) AS derived,
       cast(sum(n) - sum(d) AS bigint) AS hand_drawn, cast(sum(x) AS bigint) AS dangling
FROM (SELECT model_id, 2 + (CASE WHEN ls = 'O' THEN 1 ELSE 0 END) AS n, CASE WHEN rf = 'R' THEN 1 ELSE 0 END AS d, 0 AS x FROM b_line
      UNION ALL SELECT model_id, 1, 0, CASE WHEN st = 'P' THEN 1 ELSE 0 END FROM b_model_order) GROUP BY 1
""")
def _(t):
    return md.coverage_edges(t("b_entity"), t("b_transition"), t("b_property"))


@query("entity_describe", """
WITH t AS (SELECT b.model_id, b.transition_id, b.source, b.target, b.ordinal FROM b_transition b JOIN b_entity x ON b.model_id = x.model_id AND b.source = x.entity_id
  JOIN b_entity y ON b.model_id = y.model_id AND b.target = y.entity_id),
f AS (SELECT t.model_id, target, value, min(ordinal) AS o FROM t JOIN b_property p ON t.model_id = p.model_id AND transition_id = entity_id WHERE key = 'Transform' AND value <> '' GROUP BY 1, 2, 3),
up AS (SELECT model_id, target AS id, count(*) AS n FROM t GROUP BY 1, 2),
down AS (SELECT model_id, source AS id, count(*) AS n FROM t GROUP BY 1, 2),
kids AS (SELECT model_id, parent_id AS id, count(*) AS n FROM b_entity WHERE parent_id IS NOT NULL GROUP BY 1, 2),
bag AS (SELECT model_id, entity_id AS id, count(*) AS n FROM b_property GROUP BY 1, 2)
SELECT e.model_id, e.entity_id, e.path, 'entity' AS part, coalesce(up.n, 0) AS upstream, coalesce(down.n, 0) AS downstream, coalesce(kids.n, 0) AS children, coalesce(bag.n, 0) AS properties,
  cast(NULL AS bigint) AS position, cast(NULL AS varchar) AS key, cast(NULL AS varchar) AS value
FROM b_entity e LEFT JOIN up ON e.model_id = up.model_id AND e.entity_id = up.id LEFT JOIN down ON e.model_id = down.model_id AND e.entity_id = down.id
LEFT JOIN kids ON e.model_id = kids.model_id AND e.entity_id = kids.id LEFT JOIN bag ON e.model_id = bag.model_id AND e.entity_id = bag.id
UNION ALL SELECT p.model_id, p.entity_id, NULL, 'property', NULL, NULL, NULL, NULL, NULL, p.key, p.value FROM b_property p JOIN b_entity e ON p.model_id = e.model_id AND p.entity_id = e.entity_id
UNION ALL SELECT model_id, target, NULL, 'transform', NULL, NULL, NULL, NULL, row_number() OVER (PARTITION BY model_id, target ORDER BY o, value), 'Transform', value FROM f
UNION ALL SELECT c.model_id, c.parent_id, NULL, 'child', NULL, NULL, NULL, NULL, c.ordinal, c.entity_id, c.path FROM b_entity c JOIN b_entity e ON c.model_id = e.model_id AND c.parent_id = e.entity_id
""")
def _(t):
    return md.describe(t("b_entity"), t("b_transition"), t("b_property"))


@query("entity_details", """
WITH t AS (SELECT b.model_id, b.transition_id, b.target, b.ordinal FROM b_transition b JOIN b_entity x ON b.model_id = x.model_id AND b.source = x.entity_id
  JOIN b_entity y ON b.model_id = y.model_id AND b.target = y.entity_id),
f AS (SELECT t.model_id, target, value, min(ordinal) AS o FROM t JOIN b_property p ON t.model_id = p.model_id AND transition_id = entity_id WHERE key = 'Transform' AND value <> '' GROUP BY 1, 2, 3)
SELECT p.model_id, p.entity_id, 'property' AS part, cast(NULL AS bigint) AS position, p.key, p.value FROM b_property p JOIN b_entity e ON p.model_id = e.model_id AND p.entity_id = e.entity_id
UNION ALL SELECT model_id, target, 'transform', row_number() OVER (PARTITION BY model_id, target ORDER BY o, value), 'Transform', value FROM f
""")
def _(t):
    return md.describe_details(t("b_entity"), t("b_transition"), t("b_property"))


@query("entity_transforms", """
SELECT model_id, lid AS entity_id, concat('amount * ', ln) AS transform, ok * 64 + ln * 8 + 2 AS first_ordinal FROM b_line WHERE ls = 'O'
""")
def _(t):
    return md.inbound_transforms(t("b_entity"), t("b_transition"), t("b_property"))


@query("entity_explain", """
WITH v AS (SELECT model_id, transition_id, source AS here, target AS there, 'downstream' AS side FROM b_transition
  UNION ALL SELECT model_id, transition_id, target, source, 'upstream' FROM b_transition),
f AS (SELECT model_id, entity_id, max(nullif(value, '')) FILTER (key = 'Transform') AS tr, max(nullif(value, '')) FILTER (key = 'Derives') AS de,
  max(nullif(value, '')) FILTER (key = 'Access') AS ac FROM b_property GROUP BY 1, 2),
fed AS (SELECT DISTINCT model_id, target FROM b_transition)
SELECT v.model_id, v.here AS entity_id, v.side, v.transition_id, v.there AS other_id,
  CASE WHEN y.entity_id IS NULL THEN '(deleted)' WHEN y.kind = 'attribute' AND y.object_name IS NOT NULL THEN concat(y.object_name, '.', y.name) ELSE y.name END AS what,
  coalesce(y.path, '') AS other_path, coalesce(tr, 'from ' || de, CASE WHEN x.name = y.name THEN 'unchanged' END, lower(ac)) AS how,
  CASE WHEN fed.target IS NULL THEN 'source' ELSE 'derived' END AS headline
FROM v JOIN b_entity x ON v.model_id = x.model_id AND v.here = x.entity_id LEFT JOIN b_entity y ON v.model_id = y.model_id AND v.there = y.entity_id
LEFT JOIN f ON v.model_id = f.model_id AND v.transition_id = f.entity_id LEFT JOIN fed ON v.model_id = fed.model_id AND v.here = fed.target
""")
def _(t):
    entity, transition = t("b_entity"), t("b_transition")
    links = md.explain_links(entity, transition, t("b_property"))
    return links.join(cut(md.headline(entity, transition)), [M, "entity_id"])
