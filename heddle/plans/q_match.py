"""Registered search, filter and matching queries. The oracles compare all pairs; the jobs do not."""

from pyspark.sql import functions as F

from heddle.operators import match as mt
from heddle.session import cut

from .registry import binding, query

M = "model_id"

# Per model: every part name and every brand as asked for, in several spellings and with filters.
binding("b_query", """
SELECT concat(model_id, '/n/', pn) AS query_id, model_id, upper(concat(' ', pn, ' ')) AS name, cast(NULL AS string) AS kind, cast(NULL AS string) AS layer
FROM (SELECT DISTINCT model_id, p_name AS pn FROM b_model_part JOIN part ON pk = p_partkey)
UNION ALL SELECT DISTINCT concat(model_id, '/b/', brand), model_id, lower(brand), cast(NULL AS string), 'bronze' FROM b_model_part
UNION ALL SELECT DISTINCT concat(model_id, '/s/', brand), model_id, concat(replace(brand, '#', ' '), 's'), 'attribute', cast(NULL AS string) FROM b_model_part
UNION ALL SELECT DISTINCT concat(model_id, '/z/', brand), model_id, concat('bramd', replace(brand, 'Brand#', ' ')), cast(NULL AS string), cast(NULL AS string) FROM b_model_part
""")

SQUASH = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
TIERED = f"""
WITH q0 AS (SELECT *, lower(trim(name)) AS raw, {SQUASH.format('trim(name)')} AS sq, {SQUASH.format('layer')} AS lsq FROM b_query),
q AS (SELECT *, CASE WHEN length(sq) > 3 AND sq LIKE '%s' AND sq NOT LIKE '%ss' THEN substr(sq, 1, length(sq) - 1) ELSE sq END AS sing FROM q0),
e0 AS (SELECT model_id, entity_id, kind, layer_name, path, lower(trim(name)) AS raw, {SQUASH.format('name')} AS sq FROM b_entity),
e AS (SELECT *, CASE WHEN length(sq) > 3 AND sq LIKE '%s' AND sq NOT LIKE '%ss' THEN substr(sq, 1, length(sq) - 1) ELSE sq END AS sing FROM e0),
t AS (SELECT q.query_id, e.entity_id, e.path, CASE WHEN e.raw = q.raw THEN 0 WHEN e.sq = q.sq OR e.sq = q.sing OR e.sing = q.sq THEN 1
        WHEN contains(e.sq, q.sq) OR (e.sq <> '' AND contains(q.sq, e.sq) AND length(e.sq) >= 0.7 * length(q.sq)) THEN 2 END AS tier,
        (q.kind IS NULL OR e.kind = q.kind) AND (q.lsq IS NULL OR {SQUASH.format('e.layer_name')} = q.lsq) AS fits
      FROM q JOIN e ON q.model_id = e.model_id),
h AS (SELECT * FROM t WHERE tier IS NOT NULL)
"""


@query("search_resolve", TIERED + """
SELECT query_id, r AS position, entity_id, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'partial' END AS tier
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, path, entity_id) AS r FROM h WHERE fits)""")
def _(t):
    return mt.resolve_names(t("b_query"), t("b_entity"))[0].drop("path")


@query("search_resolve_answers", TIERED + """
SELECT q.query_id, count(*) FILTER (fits) AS matched, CASE min(tier) FILTER (fits) WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' WHEN 2 THEN 'partial' ELSE 'none' END AS how,
  count(*) FILTER (NOT fits AND tier < 2) AS filtered_out FROM q LEFT JOIN h ON q.query_id = h.query_id GROUP BY 1""")
def _(t):
    return mt.resolve_names(t("b_query"), t("b_entity"))[1]


@query("search_fuzzy_names")
def _(t):
    return mt.fuzzy_suggestions(t("b_query"), t("b_entity"))


# Codes with up to three places spoilt: 32 less so many of the characters stand in matching blocks, and no other code comes near. Every fifth
# query asks for a kind that its entity is not, every seventh has a hit.
@query("search_fuzzy_suggest", """
SELECT concat('q', p_partkey) AS query_id, cast(1 AS bigint) AS position, concat('e', p_partkey) AS entity_id, concat('Gold / ', md5(cast(p_partkey AS varchar))) AS path
FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0""")
def _(t):
    entity = t.sql("""SELECT concat('m', p_size) AS model_id, concat('e', p_partkey) AS entity_id, concat(substr(upper(md5(cast(p_partkey AS string))), 1, 9), ' ', substr(md5(cast(p_partkey AS string)), 10)) AS name,
        concat('Gold / ', md5(cast(p_partkey AS string))) AS path, 'attribute' AS kind, 'Gold' AS layer_name FROM part""")
    spoilt = "overlay(overlay(overlay(md5(cast(p_partkey AS string)) PLACING 'z' FROM 8) PLACING CASE WHEN p_partkey % 3 > 0 THEN 'y' ELSE substr(md5(cast(p_partkey AS string)), 16, 1) END FROM 16) PLACING CASE WHEN p_partkey % 3 > 1 THEN 'x' ELSE substr(md5(cast(p_partkey AS string)), 24, 1) END FROM 24)"
    asked = t.sql(f"""SELECT concat('q', p_partkey) AS query_id, concat('m', p_size) AS model_id, CASE WHEN p_partkey % 7 = 0 THEN md5(cast(p_partkey AS string)) ELSE {spoilt} END AS name,
        CASE WHEN p_partkey % 5 = 0 THEN 'object' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN 'gold' END AS layer FROM part WHERE p_partkey % 35 <> 0""")
    return mt.fuzzy_suggestions(asked, entity)


@query("search_layer_arg", """
SELECT concat('m', n_nationkey, '/', r_regionkey) AS query_id, CASE r_regionkey WHEN 0 THEN 'Bronze' WHEN 1 THEN 'Gold' WHEN 2 THEN 'Silver' WHEN 3 THEN 'Landing' END AS layer_name FROM nation, region""")
def _(t):
    asked = t.sql("""SELECT concat('m', n_nationkey, '/', r_regionkey) AS query_id, concat('m', n_nationkey) AS model_id,
        CASE r_regionkey WHEN 0 THEN 'b_r o-n.ze' WHEN 1 THEN 'GOLD' WHEN 2 THEN ' silver!' WHEN 3 THEN 'Lan Ding' ELSE 'Platinum' END AS layer FROM nation CROSS JOIN region""")
    return mt.resolve_layers(asked, t("b_entity"))


@query("search_model_hits", """
WITH q AS (SELECT query_id, model_id, lower(trim(name)) AS q FROM b_query),
n AS (SELECT model_id, kind, name, lower(name) AS e, count(*) AS entities FROM b_entity GROUP BY 1, 2, 3),
h AS (SELECT query_id, kind, name, e, entities, CASE WHEN e = q THEN 0 WHEN starts_with(e, q) THEN 1 ELSE 2 END AS rank FROM q JOIN n ON q.model_id = n.model_id AND contains(e, q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, e, name, kind) AS position FROM h)
SELECT query_id, position, kind, name, rank, entities FROM r""")
def _(t):
    return mt.search_hits(t("b_query"), t("b_entity"))[0]


@query("search_model_members", """
WITH q AS (SELECT query_id, model_id, lower(trim(name)) AS q FROM b_query),
n AS (SELECT model_id, kind, name, lower(name) AS e, count(*) AS entities FROM b_entity GROUP BY 1, 2, 3),
h AS (SELECT query_id, n.model_id, kind, name, e, CASE WHEN e = q THEN 0 WHEN starts_with(e, q) THEN 1 ELSE 2 END AS rank FROM q JOIN n ON q.model_id = n.model_id AND contains(e, q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, e, name, kind) AS position FROM h)
SELECT query_id, position, entity_id FROM r JOIN b_entity b ON r.model_id = b.model_id AND r.kind = b.kind AND r.name = b.name""")
def _(t):
    return mt.search_hits(t("b_query"), t("b_entity"))[1]


ENTRIES = """SELECT 'table' AS kind, concat('w', c_nationkey) AS workspace_id, concat('t', c_custkey) AS id, lower(c_mktsegment) AS name FROM customer
UNION ALL SELECT 'notebook', concat('w', s_nationkey), concat('n', s_suppkey), concat('nb_building_', s_suppkey) FROM supplier
UNION ALL SELECT 'item', 'w0', concat('p', p_partkey), p_name FROM part"""
ASKED = """SELECT DISTINCT c_mktsegment AS query_id, concat(' ', c_mktsegment) AS name, cast(NULL AS varchar(20)) AS kind FROM customer
UNION ALL SELECT DISTINCT concat(p_type, '/', p_name), substr(p_name, 2, 6), 'item' FROM part UNION ALL SELECT 'nb', 'building_1', 'notebook' UNION ALL SELECT 'none', 'building', 'item'"""


@query("search_catalog", f"""
WITH e AS ({ENTRIES}), q AS ({ASKED}),
h AS (SELECT query_id, e.kind, workspace_id, id, e.name, lower(trim(e.name)) = lower(trim(q.name)) AS exact FROM q JOIN e ON contains(lower(trim(e.name)), lower(trim(q.name))) AND (q.kind IS NULL OR q.kind = e.kind)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, name, kind, workspace_id, id) AS position, count(*) OVER (PARTITION BY query_id) AS total FROM h)
SELECT query_id, position, kind, id, exact, total FROM r""")
def _(t):
    matches, totals = mt.search_catalog(t.sql(ASKED), t.sql(ENTRIES))
    return matches.join(totals, "query_id").select("query_id", "position", "kind", "id", "exact", "total")


@query("filter_view", """
WITH c AS (SELECT concat('m', c_nationkey) AS model_id, concat('c:', c_custkey) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal < 3000 AND contains(c_name, '1'))
SELECT model_id, id AS entity_id, true AS matched FROM c UNION ALL SELECT DISTINCT model_id, 'L3', false FROM c""")
def _(t):
    return mt.filter_view(
        t("b_entity"), t("b_property"), name=" 1 ", kinds=("object", "layer"), tags=("OVERDRAWN", "nope"), properties=(("Segment", "build"), ("Tags", ""), (" ", "x"))
    )


@query("filter_view_names", """
WITH h AS (SELECT * FROM b_entity WHERE contains(lower(name), 'ring'))
SELECT model_id, entity_id, bool_or(m) AS matched FROM (SELECT model_id, entity_id, true AS m FROM h
 UNION ALL SELECT model_id, parent_id, false FROM h UNION ALL SELECT model_id, object_id, false FROM h WHERE depth > 1 UNION ALL SELECT model_id, layer_id, false FROM h WHERE depth > 0) WHERE entity_id IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return mt.filter_view(t("b_entity"), t("b_property"), name="RING")


@query("filter_transitions", """
SELECT model_id, concat('t4:', ok) AS transition_id FROM b_model_order JOIN customer ON ck = c_custkey WHERE st = 'F' AND c_mktsegment = 'BUILDING'""")
def _(t):
    shown = t.sql("""SELECT model_id, entity_id FROM b_property WHERE key = 'Segment' AND value = 'BUILDING' UNION ALL SELECT model_id, concat('o:', ok) FROM b_model_order WHERE st = 'F'""")
    return mt.filter_transitions(t("b_transition"), shown, hide=True).select(M, "transition_id")


@query("filter_models", """
SELECT concat('m', c_custkey) AS model_id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND (contains(c_name, '7') OR contains(lower(c_mktsegment), '7') OR c_nationkey = 7)""")
def _(t):
    models = t.sql("""SELECT concat('m', c_custkey) AS model_id, c_name AS name, concat('nation ', c_nationkey, '.') AS description, array(lower(c_mktsegment), 'All') AS tags,
        c_custkey % 2 = 0 AS starred, c_custkey AS last_viewed_at, c_custkey AS updated_at, c_custkey AS created_at FROM customer""")
    models = models.withColumn("description", F.when(F.col("description") == "nation 7.", "n7").otherwise(""))
    return mt.filter_models(models, " 7", ("BUILDING", "machinery"), True).select("model_id", "name")


@query("map_scope", """
SELECT model_id, 'source' AS side, lid AS entity_id FROM b_line
UNION ALL SELECT DISTINCT model_id, 'target', concat('cp:', ck, '-', pr) FROM b_line""")
def _(t):
    target = t.sql("SELECT model_id, entity_id FROM b_entity WHERE kind = 'layer' AND name = 'Gold'")
    return mt.map_scopes(t("b_entity"), t("b_transition"), None, target)


@query("map_scope_auto", """
SELECT model_id, v.side, v.id AS entity_id FROM (
  SELECT model_id, lid AS id FROM b_line UNION ALL SELECT DISTINCT model_id, concat('cp:', ck, '-', pr) FROM b_line
  UNION ALL SELECT model_id, concat('s:', sk) FROM b_model_supplier UNION ALL SELECT model_id, concat('p:', pk) FROM b_model_part) x, LATERAL (VALUES ('source', x.id), ('target', x.id)) AS v(side, id)""")
def _(t):
    return mt.map_scopes(t("b_entity"), t("b_transition"), None, None)


@query("map_eligible_pairs", """
SELECT model_id, concat('p:', pk) AS source, concat('cp:', ck, '-', pr) AS target, count(*) AS n FROM b_line GROUP BY 1, 2, 3""")
def _(t):
    pairs = t.sql("""SELECT model_id, concat('p:', pk) AS source, concat('cp:', ck, '-', pr) AS target FROM b_line UNION ALL SELECT model_id, concat('p:', pk), lid FROM b_line
        UNION ALL SELECT model_id, lid, concat('p:', pk) FROM b_line UNION ALL SELECT model_id, concat('cp:', ck, '-', pr), concat('c:', ck) FROM b_line UNION ALL SELECT model_id, lid, lid FROM b_line""")
    return mt.eligible_pairs(pairs, t("b_entity"), t("b_transition"), directed=False).groupBy(M, "source", "target").agg(F.count(F.lit(1)).alias("n"))


# Names to match: a part's code on the left, respelled on the right by key.
binding("b_left", """
SELECT concat('m', cast(p_size % 5 AS string)) AS model_id, concat('s', cast(p_partkey AS string)) AS id, p_partkey AS k,
       concat(substr(md5(cast(p_partkey AS string)), 1, 6), ' ', substr(md5(cast(p_partkey AS string)), 7, 8)) AS value FROM part
""")
binding("b_right", """
SELECT concat('m', cast(p_size % 5 AS string)) AS model_id, concat('t', cast(p_partkey AS string)) AS id, p_partkey AS k,
  CASE p_partkey % 4 WHEN 0 THEN concat(upper(substr(md5(cast(p_partkey AS string)), 1, 6)), '_', substr(md5(cast(p_partkey AS string)), 7, 8))
    WHEN 1 THEN concat(substr(md5(cast(p_partkey AS string)), 1, 2), substr(md5(cast(p_partkey AS string)), 4, 3), ' ', substr(md5(cast(p_partkey AS string)), 7, 8))
    WHEN 2 THEN concat(substr(md5(cast(p_partkey AS string)), 1, 6), ' ', substr(md5(cast(p_partkey AS string)), 7, 6), 'zz')
    ELSE md5(concat('x', cast(p_partkey AS string))) END AS value FROM part
""")


def _sides(t):
    return t("b_left").drop("k"), t("b_right").drop("k")


@query("map_sim_fast", "SELECT l.model_id, l.id AS source, r.id AS target, cast(100 AS bigint) AS score FROM b_left l JOIN b_right r ON l.k = r.k AND l.k % 4 = 0")
def _(t):
    return mt.fast_pairs(*_sides(t), [M])


LEV = """SELECT l.model_id, l.id AS source, r.id AS target, cast(floor((1 - levenshtein(l.value, r.value) / greatest(length(l.value), length(r.value))) * 100 + 0.5) AS bigint) AS score
FROM b_left l JOIN b_right r ON l.model_id = r.model_id"""


@query("map_sim_levenshtein", f"SELECT * FROM ({LEV}) WHERE score >= 75")
def _(t):
    return mt.levenshtein_pairs(*_sides(t), [M], 75)


DICE = """
WITH g AS (SELECT 'l' AS side, model_id, id, lower(value) AS v FROM b_left UNION ALL SELECT 'r', model_id, id, lower(value) FROM b_right),
b AS (SELECT side, model_id, id, length(v) - 1 AS n, substr(v, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(generate_series(1, length(v) - 1)) AS i FROM g) GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT l.model_id, l.id AS source, r.id AS target, cast(floor(200.0 * sum(least(l.c, r.c)) / (max(l.n) + max(r.n)) + 0.5) AS bigint) AS score
  FROM b l JOIN b r ON l.side = 'l' AND r.side = 'r' AND l.model_id = r.model_id AND l.g = r.g GROUP BY 1, 2, 3)
"""


@query("map_sim_dice", DICE + "SELECT * FROM p WHERE score >= 60")
def _(t):
    return mt.dice_pairs(*_sides(t), [M], 60)


@query("map_sim_date", """
SELECT a.o_custkey AS scope, concat('a', a.o_orderkey) AS source, concat('b', b.o_orderkey) AS target, cast(100 AS bigint) AS score
FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND cast(a.o_orderdate AS date) = cast(b.o_orderdate AS date)""")
def _(t):
    a = t.sql("SELECT o_custkey AS scope, concat('a', o_orderkey) AS id, CASE WHEN o_orderkey % 2 = 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE date_format(o_orderdate, 'd MMM yyyy') END AS value FROM orders UNION ALL SELECT o_custkey, 'x', 'not a date' FROM orders")
    b = t.sql("SELECT o_custkey AS scope, concat('b', o_orderkey) AS id, CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'MM/dd/yyyy') ELSE date_format(o_orderdate, 'MMM d, yyyy') END AS value FROM orders")
    return mt.date_pairs(a, b, ["scope"])


def _scored(t):
    left, right = _sides(t)
    names = mt.fast_pairs(left, right, [M]).withColumn("criterion", F.lit("name"))
    # The property: the part's size band; half the right side has none.
    lp = t.sql("SELECT model_id, id, concat('B-', cast(k AS string)) AS value FROM b_left")
    rp = t.sql("SELECT model_id, id, concat('b ', cast(k - k % 2 AS string)) AS value FROM b_right WHERE k % 3 <> 0")
    props = mt.fast_pairs(lp, rp, [M]).withColumn("criterion", F.lit("property"))
    has = left.union(right).select(M, "id", F.lit("name").alias("criterion")).union(lp.union(rp).select(M, "id", F.lit("property")))
    return mt.score_pairs(names.unionByName(props), has, [M], 50)


SCORED = """
WITH s AS (SELECT l.model_id, l.id AS source, r.id AS target, l.k AS lk, r.k AS rk, CASE WHEN l.k = r.k AND l.k % 4 = 0 THEN 100 ELSE 0 END AS n,
   CASE WHEN r.k % 3 = 0 THEN NULL WHEN l.k = r.k - r.k % 2 THEN 100 ELSE 0 END AS p FROM b_left l JOIN b_right r ON l.model_id = r.model_id AND l.k IN (r.k, r.k - r.k % 2)),
v AS (SELECT *, cast(floor((n + coalesce(p, 0)) / (CASE WHEN p IS NULL THEN 1.0 ELSE 2.0 END) + 0.5) AS bigint) AS confidence FROM s WHERE n > 0 OR p > 0)
"""


@query("map_score", SCORED + """
SELECT model_id, source, target, confidence, CASE WHEN n > 0 AND p > 0 THEN 'name,property' WHEN n > 0 THEN 'name' ELSE 'property' END AS via FROM v WHERE confidence >= 50""")
def _(t):
    return _scored(t).withColumn("via", F.array_join("via", ","))


# The path: the same code respelled; a third of the right side has none.
LEFT_PATH = "SELECT model_id, id, concat(substr(md5(concat('p', cast(k AS {s}))), 1, 8), '/', substr(md5(cast(k AS {s})), 1, 4)) AS value FROM b_left"
RIGHT_PATH = "SELECT model_id, id, concat(substr(md5(concat('p', cast(k AS {s}))), 1, 6), 'ZZ/', substr(md5(cast(k AS {s})), 1, 4)) AS value FROM b_right WHERE k % 3 <> 0"


@query("map_suggest", f"""
WITH n AS ({LEV}), rp AS ({RIGHT_PATH.format(s="varchar")}),
g AS (SELECT 'l' AS side, model_id, id, lower(value) AS v FROM ({LEFT_PATH.format(s="varchar")}) UNION ALL SELECT 'r', model_id, id, lower(value) FROM rp),
b AS (SELECT side, model_id, id, length(v) - 1 AS n, substr(v, i, 2) AS g, count(*) AS c FROM (SELECT *, unnest(generate_series(1, length(v) - 1)) AS i FROM g) GROUP BY 1, 2, 3, 4, 5),
p AS (SELECT l.model_id, l.id AS source, r.id AS target, cast(floor(200.0 * sum(least(l.c, r.c)) / (max(l.n) + max(r.n)) + 0.5) AS bigint) AS score
  FROM b l JOIN b r ON l.side = 'l' AND r.side = 'r' AND l.model_id = r.model_id AND l.g = r.g GROUP BY 1, 2, 3),
s AS (SELECT n.model_id, n.source, n.target, n.score AS ns, CASE WHEN rp.id IS NOT NULL THEN coalesce(p.score, 0) END AS ps
  FROM n LEFT JOIN rp ON n.model_id = rp.model_id AND n.target = rp.id LEFT JOIN p ON n.model_id = p.model_id AND n.source = p.source AND n.target = p.target),
v AS (SELECT *, cast(floor((ns + coalesce(ps, 0)) / (CASE WHEN ps IS NULL THEN 1.0 ELSE 2.0 END) + 0.5) AS bigint) AS confidence FROM s)
SELECT model_id, source, target, confidence, CASE WHEN ns > 0 AND ps > 0 THEN 'name,path' WHEN ns > 0 THEN 'name' ELSE 'path' END AS via FROM v WHERE confidence >= 60""")
def _(t):
    paths = t.sql(LEFT_PATH.format(s="string")), t.sql(RIGHT_PATH.format(s="string"))
    criteria = {"name": ("levenshtein", *_sides(t)), "path": ("dice", *paths)}
    return mt.suggest_mappings(criteria, [M], 60).withColumn("via", F.array_join("via", ","))


# The sequential pass: a pair is taken if neither end is, in the order of `k`.
GREEDY = """
r AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY confidence DESC, source, target) AS k FROM pairs),
w AS (SELECT DISTINCT {scope}, cast(0 AS bigint) AS k, cast([] AS varchar[]) AS used, false AS won FROM r
  UNION ALL SELECT r.{scope}, r.k, CASE WHEN list_has_any(used, [source, target]) THEN used ELSE list_concat(used, [source, target]) END,
    NOT list_has_any(used, [source, target]) FROM w JOIN r ON r.{scope} = w.{scope} AND r.k = w.k + 1)
SELECT r.{scope}, source, target, confidence FROM w JOIN r ON r.{scope} = w.{scope} AND r.k = w.k WHERE won"""


@query("map_one_to_one", DICE.replace("WITH g", "WITH RECURSIVE g", 1).rstrip() + ", pairs AS (SELECT model_id, source, target, score AS confidence FROM p WHERE score >= 50)," + GREEDY.format(scope="model_id"))
def _(t):
    pairs = mt.dice_pairs(*_sides(t), [M], 50).withColumnRenamed("score", "confidence")
    return mt.one_to_one(pairs.withColumn("source_key", F.col("source")).withColumn("target_key", F.col("target")), [M]).drop("source_key", "target_key")


CONTESTED = """SELECT o_custkey AS scope, concat('a', l_suppkey % 9) AS source, concat('b', l_partkey % 9) AS target, max(l_linenumber) * 10 AS confidence
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_suppkey % 9, l_partkey % 9"""


@query("map_one_to_one_contested", f"WITH RECURSIVE pairs AS ({CONTESTED})," + GREEDY.format(scope="scope"))
def _(t):
    pairs = t.sql(CONTESTED).withColumn("source_key", F.col("source")).withColumn("target_key", F.col("target"))
    return mt.one_to_one(pairs, ["scope"]).drop("source_key", "target_key")


SUGGESTED = "SELECT model_id, concat('p:', pk) AS source, concat('cp:', ck, '-', pr) AS target, ln * 10 AS confidence, array('name', 'path') AS via FROM b_line"


@query("map_groups", """
SELECT l.model_id, concat('b:', brand) AS source_owner, concat('c:', ck) AS target_owner, concat('Bronze · ', brand) AS source_label, concat('Gold · ', c_name) AS target_label, count(*) AS suggestions
FROM b_line l JOIN b_model_part m ON l.model_id = m.model_id AND l.pk = m.pk JOIN customer ON ck = c_custkey GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    return mt.group_suggestions(t.sql(SUGGESTED), t("b_entity"))


@query("map_apply", """
WITH s AS (SELECT model_id, concat('p:', pk) AS source, concat('cp:', ck, '-', pr) AS target, max(ln) * 10 AS c FROM b_line GROUP BY 1, 2, 3)
SELECT model_id, source, target, v.key, v.value FROM s, LATERAL (VALUES ('Confidence', cast(c AS varchar)), ('Mapped by', 'name, path'), ('Algorithm', 'fast')) AS v(key, value)""")
def _(t):
    existing = t.sql("SELECT model_id, source, target FROM b_transition")
    asked = t.sql(SUGGESTED + " UNION ALL SELECT model_id, concat('p:', pk), lid, 99, array('name') FROM b_line")
    edges, bags = mt.apply_suggestions(cut(asked), existing, "fast")
    return edges.join(bags.withColumnRenamed("entity_id", "transition_id"), [M, "transition_id"]).drop("transition_id")


# Definition sheets: a table per nation, its columns after the parts' names and keys.
def _sheet(t):
    sheet = t.sql("""SELECT concat('m', p_size) AS table_guid, p_partkey AS row_no, CASE p_partkey % 4 WHEN 0 THEN concat(upper(replace(p_name, ' ', '_')), p_partkey) WHEN 1 THEN concat(split_part(p_name, ' ', 2), ' ', p_partkey, ' of ', split_part(p_name, ' ', 1))
        WHEN 2 THEN concat(substr(p_name, 2), p_partkey) ELSE md5(cast(p_partkey AS string)) END AS name FROM part""")
    column = t.sql("SELECT concat('m', p_size) AS table_guid, p_partkey AS ordinal, concat('g', p_partkey) AS column_guid, concat(p_name, ' ', p_partkey) AS name FROM part")
    return sheet, column


@query("def_similarity_names")
def _(t):
    return mt.definition_similarity(*_sheet(t), 0.62)


@query("def_match_names")
def _(t):
    return mt.match_definitions(*_sheet(t))


# Codes that lose up to nine characters at their end: what is left is one matching block. Every eleventh row has a code of no column.
CUT = "substr(md5(cast(p_partkey AS {text})), 1, 32 - p_partkey % 10)"
KNOWN = """WITH s AS (SELECT concat('m', p_size) AS table_guid, p_partkey AS k, p_partkey % 11 = 0 AS alien, p_partkey % 10 AS r FROM part),
c AS (SELECT *, CASE WHEN alien THEN 0.0::DOUBLE WHEN r = 0 THEN 1.0 ELSE round(least(2.0 * (32 - r) / (64 - r), 0.97)::DOUBLE, 3) END AS score FROM s)"""


def _codes(t):
    cut_ = CUT.format(text="string")
    sheet = t.sql(f"""SELECT concat('m', p_size) AS table_guid, p_partkey AS row_no, CASE WHEN p_partkey % 11 = 0 THEN md5(concat('x', p_partkey))
        WHEN p_partkey % 2 = 0 THEN concat(' ', {cut_}) ELSE {cut_} END AS name FROM part""")
    column = t.sql("SELECT concat('m', p_size) AS table_guid, p_partkey AS ordinal, concat('g', p_partkey) AS column_guid, md5(cast(p_partkey AS string)) AS name FROM part")
    return sheet, column


@query("def_similarity", KNOWN + " SELECT table_guid, k AS row_no, k AS ordinal, score FROM c WHERE NOT alien")
def _(t):
    return mt.definition_similarity(*_codes(t), 0.62)


@query("def_match", KNOWN + f"""
SELECT table_guid, k AS row_no, CASE WHEN alien THEN md5(concat('x', k)) WHEN k % 2 = 0 THEN concat(' ', cut) ELSE cut END AS source_name,
  CASE WHEN NOT alien THEN concat('g', k) END AS column_guid, CASE WHEN NOT alien THEN md5(cast(k AS varchar)) END AS column_name, score AS confidence,
  CASE WHEN alien THEN 'unmatched' WHEN r = 0 THEN 'exact' ELSE 'fuzzy' END AS status, score >= 0.88 AS selected, '' AS alternatives
FROM c JOIN (SELECT p_partkey, {CUT.format(text="varchar")} AS cut FROM part) ON k = p_partkey""")
def _(t):
    return mt.match_definitions(*_codes(t))
