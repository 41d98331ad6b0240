"""Registered bulk edits, diffs and roll-ups."""

from pyspark.sql import functions as F

from heddle.operators import edit as ed
from heddle.operators import match as mt
from heddle.operators import rollups as ru
from heddle.session import cut

from .registry import query

M = "model_id"
DOOMED = "SELECT model_id, entity_id FROM b_entity WHERE kind = 'object' AND layer_name = 'Silver' AND ordinal % 3 = 0 UNION ALL SELECT 'm0', 'no such thing'"


@query("edit_descendants", """
SELECT model_id, concat('o:', ok) AS entity_id FROM b_model_order WHERE ok % 3 = 0 UNION ALL SELECT model_id, lid FROM b_line WHERE ok % 3 = 0""")
def _(t):
    return ed.with_descendants(t.sql(DOOMED), t("b_entity"))


@query("edit_delete_cascade", """
SELECT model_id, 'entity' AS part, entity_id AS id FROM b_entity WHERE NOT (layer_name = 'Silver' AND depth > 0 AND coalesce(try_cast(split_part(object_id, ':', 2) AS bigint), 1) % 3 = 0)
UNION ALL SELECT model_id, 'transition', transition_id FROM b_transition WHERE cast(split_part(split_part(replace(transition_id, 'l:', ''), ':', 2), '-', 1) AS bigint) % 3 <> 0""")
def _(t):
    entity, edges = ed.delete_cascade(t.sql(DOOMED), t("b_entity"), t("b_transition"))
    return entity.select(M, F.lit("entity").alias("part"), F.col("entity_id").alias("id")).union(edges.select(M, F.lit("transition"), "transition_id"))


@query("edit_delete_bridge", """
SELECT DISTINCT model_id, concat('s:', sk) AS source, concat('cp:', ck, '-', pr) AS target FROM b_line WHERE ok % 3 = 0 AND ls = 'O'
UNION ALL SELECT DISTINCT model_id, concat('p:', pk), concat('cp:', ck, '-', pr) FROM b_line WHERE ok % 3 = 0 AND ls = 'O'""")
def _(t):
    _, edges = ed.delete_bridging(t.sql(DOOMED), t("b_entity"), t("b_transition"))
    return edges.filter("ordinal is null").select(M, "source", "target")


NEW_EDGES = """SELECT model_id, concat('s:', sk) AS source, concat('cp:', ck, '-', pr) AS target FROM b_line
UNION ALL SELECT model_id, concat('cp:', ck, '-', pr), lid FROM b_line UNION ALL SELECT model_id, lid, concat('cp:', ck, '-', pr) FROM b_line
UNION ALL SELECT model_id, lid, lid FROM b_line UNION ALL SELECT model_id, lid, 'ghost' FROM b_line"""


@query("edit_add_transitions", """
SELECT DISTINCT model_id, concat('s:', sk) AS source, concat('cp:', ck, '-', pr) AS target FROM b_line
UNION ALL SELECT model_id, concat('cp:', ck, '-', pr), lid FROM b_line UNION ALL SELECT model_id, lid, concat('cp:', ck, '-', pr) FROM b_line WHERE ls <> 'O'""")
def _(t):
    return ed.add_transitions(t.sql(NEW_EDGES), t("b_entity"), t("b_transition"))


@query("edit_remove_transitions", "SELECT model_id, transition_id FROM b_transition WHERE transition_id NOT LIKE 't3:%'")
def _(t):
    return ed.remove_transitions(t.sql("SELECT model_id, transition_id FROM b_transition WHERE transition_id LIKE 't3:%'"), t("b_transition")).select(M, "transition_id")


@query("edit_rename", """
SELECT e.model_id, e.entity_id, CASE WHEN n > 0 THEN concat('line v', n) ELSE e.name END AS name FROM b_entity e
LEFT JOIN (SELECT lid, ln AS n FROM b_line WHERE ls = 'O') x ON e.entity_id = x.lid""")
def _(t):
    change = t.sql("SELECT model_id, lid AS entity_id, i AS seq, concat('line v', i) AS new_name FROM b_line JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS v(i) ON i <= ln WHERE ls = 'O'")
    return ed.rename(change, t("b_entity")).select(M, "entity_id", "name")


@query("edit_clone_subtree", """
WITH c AS (SELECT model_id, entity_id, name, kind, depth FROM b_entity WHERE layer_name = 'Gold' OR (layer_name = 'Bronze' AND depth > 0))
SELECT model_id, 'entity' AS part, name AS a, kind AS b, count(*) AS n FROM c GROUP BY 1, 3, 4
UNION ALL SELECT model_id, 'edge', lid, concat('total ', lower(pname)), count(*) FROM b_line WHERE ls = 'O' GROUP BY 1, 3, 4
UNION ALL SELECT model_id, 'edge', concat('o:', ok), 'customer', count(*) FROM b_model_order GROUP BY 1, 3
UNION ALL SELECT concat('m', c_nationkey), 'property', 'Segment', c_mktsegment, count(*) FROM customer GROUP BY 1, 4""")
def _(t):
    ids = t.sql("SELECT model_id, entity_id FROM b_entity WHERE (kind = 'layer' AND name = 'Gold') OR (layer_name = 'Gold' AND kind = 'attribute') OR (layer_name = 'Bronze' AND depth > 0)")
    made, edges, bags = ed.clone(ids, t("b_entity"), t("b_transition"), t("b_property"), "one")
    made = cut(made.select(M, "entity_id", "name", "kind", "depth"))
    n = F.count(F.lit(1)).alias("n")
    a = made.groupBy(M, F.lit("entity").alias("part"), F.col("name").alias("a"), F.col("kind").alias("b")).agg(n)
    names = made.select(M, F.col("entity_id").alias("target"), "name", "depth")
    what = F.when(F.col("depth") == 1, "customer").otherwise(F.concat(F.lit("total "), "name"))
    b = edges.join(names, [M, "target"]).groupBy(M, F.lit("edge").alias("part"), F.col("source").alias("a"), what.alias("b")).agg(n)
    c = bags.filter("key = 'Segment'").groupBy(M, F.lit("property").alias("part"), F.col("key").alias("a"), F.col("value").alias("b")).agg(n)
    return a.union(b).union(c)


@query("prop_set", """
SELECT model_id, entity_id, key, value FROM b_property WHERE NOT (key = 'Segment' AND value IN ('BUILDING', 'MACHINERY'))
UNION ALL SELECT model_id, entity_id, 'Segment', 'changed' FROM b_property WHERE key = 'Segment' AND value = 'BUILDING'
UNION ALL SELECT model_id, entity_id, 'New', 'v' FROM b_property WHERE key = 'Segment' AND value = 'BUILDING'""")
def _(t):
    change = t.sql("""SELECT model_id, entity_id, 1 AS seq, ' Segment ' AS key, CASE value WHEN 'BUILDING' THEN 'early' ELSE '' END AS value FROM b_property WHERE key = 'Segment' AND value IN ('BUILDING', 'MACHINERY')
        UNION ALL SELECT model_id, entity_id, 2, 'Segment', 'changed' FROM b_property WHERE key = 'Segment' AND value = 'BUILDING'
        UNION ALL SELECT model_id, entity_id, 3, 'New', 'v' FROM b_property WHERE key = 'Segment' AND value = 'BUILDING'
        UNION ALL SELECT model_id, entity_id, 3, 'tags', 'x' FROM b_property WHERE key = 'Segment' UNION ALL SELECT model_id, entity_id, 3, 'Absent', '' FROM b_property WHERE key = 'Segment'""")
    return ed.set_properties(change, t("b_property"))


@query("prop_rename", """
SELECT model_id, entity_id, CASE WHEN key = 'Segment' THEN 'Note' ELSE key END AS key, value
FROM (SELECT *, bool_or(key = 'Segment') OVER (PARTITION BY model_id, entity_id) AS renamed FROM b_property) WHERE NOT (key = 'Note' AND renamed)""")
def _(t):
    change = t.sql("SELECT model_id, entity_id, 'Segment' AS old_key, ' Note' AS new_key FROM b_property WHERE key = 'Segment' UNION ALL SELECT model_id, entity_id, 'Via', 'Tags' FROM b_property WHERE key = 'Via'")
    return ed.rename_property(change, t("b_property"))


@query("prop_common", """
WITH s AS (SELECT concat('m', c_nationkey) AS selection_id, c_custkey, c_mktsegment, c_acctbal > 8000 AS note, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT selection_id, 'Segment' AS key, CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) ELSE '' END AS value, min(c_mktsegment) <> max(c_mktsegment) AS mixed, count(*) AS present FROM s GROUP BY 1
UNION ALL SELECT selection_id, 'Note', '', count(*) < max(n), count(*) FROM s WHERE note GROUP BY 1""")
def _(t):
    return ed.common_properties(t.sql("SELECT model_id AS selection_id, model_id, entity_id FROM b_entity WHERE layer_name = 'Gold' AND kind = 'object'"), t("b_property"))


@query("prop_key_counts", """
SELECT model_id, key, count(*) AS entities, count(DISTINCT CASE WHEN value <> '' THEN value END) AS "values" FROM b_property WHERE key <> 'Tags' GROUP BY 1, 2""")
def _(t):
    return ed.key_counts(t("b_property"))


@query("prop_key_values", "SELECT DISTINCT model_id, key, value FROM b_property WHERE key <> 'Tags' AND value <> ''")
def _(t):
    return ed.key_values(t("b_property"))


@query("prop_compact", """
SELECT model_id, entity_id, key, value, cast(NULL AS bigint) AS orphans FROM b_property WHERE entity_id LIKE 'c:%'
UNION ALL SELECT model_id, NULL, NULL, NULL, count(DISTINCT entity_id) FROM b_property WHERE entity_id NOT LIKE 'c:%' GROUP BY 1""")
def _(t):
    kept, gone = ed.compact_properties(t("b_property"), t("b_entity"))
    nothing = F.lit(None).cast("string")
    return kept.withColumn("orphans", F.lit(None).cast("bigint")).unionByName(
        gone.select(M, *[nothing.alias(c) for c in ("entity_id", "key", "value")], "orphans")
    )


OWN_TAGS = """SELECT concat('m', c_nationkey) AS model_id, concat('c:', c_custkey) AS entity_id, lower(c_mktsegment) AS seg,
  CASE WHEN c_acctbal < 0 THEN 'Overdrawn' WHEN c_acctbal < 3000 THEN 'overdrawn' END AS od, c_acctbal >= 0 AND c_acctbal < 3000 AS thin FROM customer"""


@query("tag_normalise", f"""
SELECT model_id, entity_id, (SELECT string_agg(v, ', ' ORDER BY lower(v), v) FROM (VALUES (seg), (od), (CASE WHEN thin THEN 'Thin' END)) AS x(v) WHERE v IS NOT NULL) AS tags FROM ({OWN_TAGS})""")
def _(t):
    return t("b_property").filter("key = 'Tags'").select(M, "entity_id", F.array_join(ed.tag_array("value"), ", ").alias("tags"))


@query("tag_counts", f"""
SELECT model_id, min(tag) AS tag, count(*) AS entities FROM (SELECT model_id, seg AS tag FROM ({OWN_TAGS}) UNION ALL SELECT model_id, od FROM ({OWN_TAGS}) UNION ALL SELECT model_id, 'Thin' FROM ({OWN_TAGS}) WHERE thin)
WHERE tag IS NOT NULL GROUP BY model_id, lower(tag)""")
def _(t):
    return ed.tag_counts(t("b_property"), t("b_entity"))


@query("tag_model_counts", """
SELECT min(tag) AS tag, count(*) AS models FROM (SELECT c_mktsegment AS tag FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT lower(c_mktsegment) FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT concat('n', c_nationkey) FROM customer) GROUP BY lower(tag)""")
def _(t):
    return ed.model_tag_counts(t.sql("SELECT c_custkey AS model_id, array(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END, concat('n', c_nationkey)) AS tags FROM customer"))


@query("tag_edit", f"""
WITH o AS ({OWN_TAGS}),
e AS (SELECT model_id, entity_id, CASE WHEN seg = 'building' THEN 'Overdrawn' ELSE seg END AS v FROM o
  UNION ALL SELECT model_id, entity_id, od FROM o WHERE od IS NOT NULL UNION ALL SELECT model_id, entity_id, 'VIP' FROM o WHERE cast(split_part(entity_id, ':', 2) AS bigint) % 2 = 0),
d AS (SELECT model_id, entity_id, lower(v) AS k, min(v) AS v FROM e WHERE lower(v) <> 'machinery' GROUP BY 1, 2, 3)
SELECT model_id, entity_id, string_agg(v, ', ' ORDER BY k) AS tags FROM d GROUP BY 1, 2""")
def _(t):
    change = t.sql("""SELECT concat('m', n_nationkey) AS model_id, 'rename' AS action, cast(NULL AS string) AS entity_id, 'BUILDING' AS tag, ' Overdrawn ' AS new_tag FROM nation
        UNION ALL SELECT concat('m', n_nationkey), 'delete', NULL, 'machinery', NULL FROM nation UNION ALL SELECT concat('m', n_nationkey), 'delete', NULL, 'THIN', NULL FROM nation
        UNION ALL SELECT concat('m', c_nationkey), 'add', concat('c:', c_custkey), 'VIP', NULL FROM customer WHERE c_custkey % 2 = 0""")
    return ed.edit_tags(change, t("b_property"), t("b_entity")).filter("key = 'Tags'").select(M, "entity_id", F.col("value").alias("tags"))


# A batch per order: per line one of several proposals, in line order.
EDITS = """SELECT model_id, ok AS batch_id, cast(seq AS int) AS seq, kind, describes, source_id, target_id, entity_id, key, value FROM (
 SELECT b.*, (ln - 1) * 4 + v.j AS seq, CASE v.j WHEN 0 THEN 'add_transition' WHEN 1 THEN 'set_property' WHEN 2 THEN 'add_tag' ELSE 'rename' END AS kind,
  CASE WHEN ln = 7 THEN ' ' ELSE 'because' END AS describes, CASE WHEN v.j = 0 THEN lid END AS source_id,
  CASE WHEN v.j = 0 THEN CASE ln WHEN 2 THEN lid WHEN 3 THEN 'ghost' WHEN 4 THEN '' ELSE concat('cp:', ck, '-', pr) END END AS target_id,
  CASE WHEN v.j > 0 THEN CASE WHEN ln = 3 THEN 'ghost' ELSE concat('c:', ck) END END AS entity_id,
  CASE WHEN v.j = 1 THEN CASE ln WHEN 1 THEN 'TAGS' WHEN 2 THEN ' ' ELSE ' Segment' END END AS key,
  CASE v.j WHEN 1 THEN CASE WHEN ln = 4 THEN ' ' ELSE 'BUILDING' END WHEN 2 THEN CASE WHEN ln = 4 THEN '' ELSE ' Building ' END WHEN 3 THEN CASE WHEN ln = 4 THEN '' ELSE 'Customer#000000001' END END AS value
 FROM b_line b CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(j)) x"""


@query("change_validate", f"""
WITH e AS (SELECT x.*, c_mktsegment AS seg, c_name, ls FROM ({EDITS}) x JOIN b_model_order o ON x.batch_id = o.ok JOIN customer ON o.ck = c_custkey LEFT JOIN b_line l ON x.source_id = l.lid),
r AS (SELECT *, CASE WHEN trim(describes) = '' THEN 'no description'
  WHEN kind = 'add_transition' THEN CASE WHEN target_id = '' THEN 'needs both ends' WHEN target_id = 'ghost' THEN 'unknown target' WHEN source_id = target_id THEN 'self loop' WHEN ls = 'O' THEN 'exists' END
  WHEN entity_id = 'ghost' THEN 'unknown entity'
  WHEN kind = 'set_property' THEN CASE WHEN trim(key) = '' THEN 'needs a key' WHEN lower(trim(key)) = 'tags' THEN 'reserved key' WHEN trim(value) = '' THEN 'needs a value' WHEN seg = 'BUILDING' THEN 'no change' END
  WHEN kind = 'add_tag' THEN CASE WHEN value = '' THEN 'needs a tag' WHEN seg = 'BUILDING' THEN 'no change' END
  ELSE CASE WHEN value = '' THEN 'needs a name' WHEN c_name = value THEN 'no change' END END AS reason FROM e)
SELECT batch_id, seq, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS n FROM r GROUP BY 1, 2, 3, 4""")
def _(t):
    return ed.validate_changes(t.sql(EDITS), t("b_entity"), t("b_transition"), t("b_property")).groupBy("batch_id", "seq", "status", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("change_apply", """
SELECT model_id, 'rename' AS part, concat('c:', ck) AS id, arg_max(concat('n', ok, '-', ln), ok * 8 + ln) AS value FROM b_line WHERE pk % 2 = 0 GROUP BY 1, 3
UNION ALL SELECT model_id, 'edge', concat('p:', pk, '>cp:', ck, '-', pr), '' FROM b_line GROUP BY model_id, pk, ck, pr
UNION ALL SELECT model_id, 'Rank', concat('c:', ck), cast(max(ok * 8 + ln) AS varchar) FROM b_line GROUP BY 1, 3
UNION ALL SELECT model_id, 'tagged', concat('c:', ck), '' FROM b_line GROUP BY 1, 3""")
def _(t):
    edits = t.sql("""SELECT model_id, ok * 8 + ln AS seq, 'rename' AS kind, cast(NULL AS string) AS source_id, cast(NULL AS string) AS target_id, concat('c:', ck) AS entity_id, cast(NULL AS string) AS key, concat('n', ok, '-', ln) AS value FROM b_line WHERE pk % 2 = 0
        UNION ALL SELECT model_id, 0, 'add_transition', concat('p:', pk), concat('cp:', ck, '-', pr), NULL, NULL, NULL FROM b_line
        UNION ALL SELECT model_id, ok * 8 + ln, 'set_property', NULL, NULL, concat('c:', ck), 'Rank', cast(ok * 8 + ln AS string) FROM b_line
        UNION ALL SELECT model_id, ok * 8 + ln, 'add_tag', NULL, NULL, concat('c:', ck), NULL, 'zz' FROM b_line UNION ALL SELECT model_id, 1, 'explode', NULL, NULL, concat('c:', ck), 'Rank', 'x' FROM b_line""")
    entity, edges, bags = ed.apply_changes(edits, t("b_entity"), t("b_transition"), t("b_property"))
    blank = F.lit("")
    return (
        entity.filter("layer_name = 'Gold' and kind = 'object' and name like 'n%'").select(M, F.lit("rename").alias("part"), F.col("entity_id").alias("id"), F.col("name").alias("value"))
        .union(edges.filter("transition_id like 't-%'").select(M, F.lit("edge"), F.concat_ws(">", "source", "target"), blank))
        .union(bags.filter("key = 'Rank'").select(M, "key", "entity_id", "value"))
        .union(bags.filter("key = 'Tags' and array_contains(split(value, ', '), 'zz')").select(M, F.lit("tagged"), "entity_id", blank))
    )


# --- diffs and roll-ups ---------------------------------------------------------------

@query("diff_versions", """
SELECT model_id, 'added' AS change, concat('o:', ok) AS id, concat('order_', ok) AS name, cast(NULL AS varchar) AS was FROM b_model_order WHERE st = 'F'
UNION ALL SELECT model_id, 'removed', concat('o:', ok), NULL, concat('order_', ok) FROM b_model_order WHERE st = 'P'
UNION ALL SELECT model_id, 'renamed', concat('o:', ok), concat('order_', ok, ' v2'), concat('order_', ok) FROM b_model_order WHERE st = 'O' AND ok % 2 = 0
UNION ALL SELECT model_id, 'transition added', concat('o:', ok, '>c:', ck), NULL, NULL FROM b_model_order WHERE st = 'F'
UNION ALL SELECT model_id, 'transition removed', concat('o:', ok, '>c:', ck), NULL, NULL FROM b_model_order WHERE st = 'P'""")
def _(t):
    before = t.sql("SELECT model_id, concat('o:', ok) AS entity_id, concat('order_', ok) AS name FROM b_model_order WHERE st <> 'F'")
    after = t.sql("SELECT model_id, concat('o:', ok) AS entity_id, concat('order_', ok, CASE WHEN st = 'O' AND ok % 2 = 0 THEN ' v2' ELSE '' END) AS name FROM b_model_order WHERE st <> 'P'")
    edges = "SELECT model_id, concat('{}', ok) AS transition_id, concat('o:', ok) AS source, concat('c:', ck) AS target FROM b_model_order WHERE st <> '{}'"
    return ru.diff_versions(before, after, t.sql(edges.format("x", "F")), t.sql(edges.format("y", "P")))


@query("drift_schema", """
WITH o AS (SELECT DISTINCT model_id, concat('b:', brand) AS entity_id, brand, cast(replace(brand, 'Brand#', '') AS integer) AS n FROM b_model_part),
l AS (SELECT b, concat('live', b) AS live_id, concat('brand#', b) AS name FROM generate_series(1, 20) AS g(b) WHERE b % 7 <> 0),
h AS (SELECT o.model_id, o.entity_id, count(*) AS c, min(live_id) AS live_id FROM o JOIN l ON contains(l.name, lower(o.brand)) GROUP BY 1, 2),
s AS (SELECT o.*, CASE WHEN c IS NULL THEN 'not found' WHEN c > 1 THEN 'ambiguous' WHEN cast(substr(live_id, 5) AS integer) % 5 = 0 THEN 'not comparable' ELSE 'compared' END AS status, live_id FROM o LEFT JOIN h ON o.model_id = h.model_id AND o.entity_id = h.entity_id),
m AS (SELECT s.model_id, s.entity_id, lower(pname) AS k FROM s JOIN b_model_part p ON s.model_id = p.model_id AND s.brand = p.brand WHERE status = 'compared'),
v AS (SELECT s.model_id, s.entity_id, lower(concat(replace(p_name, ' ', '_'), '_', p_partkey)) AS k FROM s JOIN part ON p_brand = s.brand WHERE status = 'compared' AND p_partkey % 2 = 0)
SELECT model_id, entity_id, 'status' AS part, status AS verdict, count(*) AS n FROM s GROUP BY 1, 2, 4
UNION ALL SELECT coalesce(m.model_id, v.model_id), coalesce(m.entity_id, v.entity_id), 'columns', CASE WHEN v.k IS NULL THEN 'only_in_model' WHEN m.k IS NULL THEN 'only_in_live' ELSE 'matching' END, count(*)
FROM m FULL JOIN v ON m.model_id = v.model_id AND m.entity_id = v.entity_id AND m.k = v.k GROUP BY 1, 2, 4""")
def _(t):
    tables = t.sql("SELECT model_id, entity_id, name FROM b_entity WHERE layer_name = 'Bronze' AND kind = 'object'")
    columns = t.sql("SELECT model_id, object_id AS entity_id, name AS column_name FROM b_entity WHERE layer_name = 'Bronze' AND kind = 'attribute' AND NOT has_children")
    live = t.sql("SELECT DISTINCT concat('live', replace(p_brand, 'Brand#', '')) AS live_id, lower(p_brand) AS name, cast(replace(p_brand, 'Brand#', '') AS int) % 5 <> 0 AS readable FROM part WHERE cast(replace(p_brand, 'Brand#', '') AS int) <= 20 AND cast(replace(p_brand, 'Brand#', '') AS int) % 7 <> 0")
    live_cols = t.sql("SELECT concat('live', replace(p_brand, 'Brand#', '')) AS live_id, upper(concat(replace(p_name, ' ', '_'), '_', p_partkey)) AS column_name FROM part WHERE p_partkey % 2 = 0")
    asked = tables.select(F.concat_ws("|", M, "entity_id").alias("query_id"), "name", F.lit("table").alias("kind"))
    entry = live.select(F.lit("table").alias("kind"), F.lit("w").alias("workspace_id"), F.col("live_id").alias("id"), "name")
    hits, _ = mt.search_catalog(asked, entry)
    candidate = hits.select(F.split("query_id", r"\|")[0].alias(M), F.split("query_id", r"\|")[1].alias("entity_id"), F.col("id").alias("live_id"))
    status, cols = ru.schema_drift(tables, columns, candidate, live.select("live_id", "readable"), live_cols)
    n = F.count(F.lit(1)).alias("n")
    return status.groupBy(M, "entity_id", F.lit("status").alias("part"), F.col("status").alias("verdict")).agg(n).union(
        cols.groupBy(M, "entity_id", F.lit("columns").alias("part"), "verdict").agg(n)
    )


ENTRIES = """SELECT 'workspace' AS kind, concat('w', n_nationkey) AS workspace_id, n_name AS workspace_name, concat('w', n_nationkey) AS id, n_name AS name, cast(NULL AS string) AS item_type FROM nation
UNION ALL SELECT 'table', concat('w', c_nationkey), n_name, c_name, c_name, 'Table' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 5 <> 4
UNION ALL SELECT 'lakehouse', concat('w', s_nationkey), n_name, s_name, s_name, 'Lakehouse' FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey % 5 <> 4
UNION ALL SELECT CASE WHEN p_type = 'PROMO' THEN 'notebook' ELSE 'item' END, concat('w', p_size % 4), concat('NATION_', p_size % 4), p_name, p_name,
  CASE p_type WHEN 'PROMO' THEN 'Notebook' WHEN 'ECONOMY' THEN 'DataPipeline' WHEN 'SMALL' THEN 'Warehouse' WHEN 'LARGE' THEN 'SemanticModel' WHEN 'MEDIUM' THEN 'MLExperiment' END FROM part"""


@query("asset_buckets", f"""
WITH b AS (SELECT *, CASE WHEN kind = 'workspace' THEN NULL WHEN kind IN ('table', 'lakehouse') OR item_type IN ('Warehouse', 'SemanticModel') THEN 'data' WHEN kind = 'notebook' THEN 'notebook' WHEN item_type = 'DataPipeline' THEN 'pipeline' ELSE 'other' END AS bucket FROM ({ENTRIES}))
SELECT workspace_id, max(workspace_name) AS workspace_name, count(*) FILTER (bucket = 'data') AS data, count(*) FILTER (bucket = 'notebook') AS notebook, count(*) FILTER (bucket = 'pipeline') AS pipeline, count(*) FILTER (bucket = 'other') AS other,
 count(*) FILTER (kind = 'table') AS "table", count(*) FILTER (kind = 'lakehouse' OR item_type = 'Warehouse') AS store, count(*) FILTER (item_type = 'SemanticModel') AS bi, count(bucket) AS total FROM b GROUP BY 1
UNION ALL SELECT NULL, NULL, count(*) FILTER (bucket = 'data'), count(*) FILTER (bucket = 'notebook'), count(*) FILTER (bucket = 'pipeline'), count(*) FILTER (bucket = 'other'),
 count(*) FILTER (kind = 'table'), count(*) FILTER (kind = 'lakehouse' OR item_type = 'Warehouse'), count(*) FILTER (item_type = 'SemanticModel'), count(bucket) FROM b""")
def _(t):
    return ru.asset_counts(t.sql(ENTRIES))


@query("product_assets_pending", """
SELECT DISTINCT concat('dp', l_suppkey) AS product_id, concat('g', l_partkey) AS guid, CASE WHEN l_partkey % 3 = 0 THEN 'onboard' ELSE 'link' END AS action, CASE WHEN l_partkey % 3 <> 0 THEN concat('a', l_partkey) END AS asset_id
FROM lineitem WHERE l_partkey % 3 = 0 OR l_partkey % 2 = 0 OR l_suppkey % 2 = 0""")
def _(t):
    wanted = t.sql("SELECT concat('dp', l_suppkey) AS product_id, concat('g', l_partkey) AS guid FROM lineitem UNION ALL SELECT 'dp0', ''")
    known = t.sql("SELECT concat('g', p_partkey) AS guid, concat('a', p_partkey) AS asset_id FROM part WHERE p_partkey % 3 <> 0")
    linked = t.sql("SELECT DISTINCT concat('dp', l_suppkey) AS product_id, concat('a', l_partkey) AS asset_id FROM lineitem WHERE l_partkey % 2 = 1 AND l_suppkey % 2 = 1")
    return ru.pending_assets(wanted, known, linked)


@query("product_domain_tree", """
SELECT concat('r', r_regionkey) AS domain_id, r_name AS name, 0 AS depth, r_name AS path, count(c_custkey) AS products FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2
UNION ALL SELECT concat('n', n_nationkey), n_name, 1, concat(r_name, ' / ', n_name), count(c_custkey) FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 4
UNION ALL SELECT DISTINCT concat('n', c_nationkey, '-', c_mktsegment), c_mktsegment, 2, concat(r_name, ' / ', n_name, ' / ', c_mktsegment), count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'orphan', 'Orphan', 0, 'Orphan', cast(0 AS bigint)""")
def _(t):
    domain = t.sql("""SELECT concat('r', r_regionkey) AS id, r_name AS name, cast(NULL AS string) AS parent_id FROM region UNION ALL SELECT concat('n', n_nationkey), n_name, concat('r', n_regionkey) FROM nation
        UNION ALL SELECT DISTINCT concat('n', c_nationkey, '-', c_mktsegment), c_mktsegment, concat('n', c_nationkey) FROM customer UNION ALL SELECT 'orphan', 'Orphan', 'gone'""")
    return ru.domain_tree(domain, t.sql("SELECT c_custkey AS id, concat('n', c_nationkey, '-', c_mktsegment) AS domain_id FROM customer"))


REQUESTS = """SELECT o_orderkey AS id, concat('dp', o_custkey % 10) AS product_id, CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'denied' END AS status, cast(o_orderdate AS string) AS created_at,
  cast(NULL AS string) AS decided_at, cast(NULL AS string) AS decided_by, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('u', o_custkey) END AS requester_object_id FROM orders"""


@query("request_inbox", "SELECT o_orderkey AS id, concat('dp', o_custkey % 10) AS product_id FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 10 = 3")
def _(t):
    return ru.inbox(t.sql(REQUESTS), "dp3", "pending").select("id", "product_id")


@query("request_decisions", """
WITH d AS (SELECT l_orderkey AS id, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS seq, l_returnflag <> 'R' AS approve, concat('by', l_suppkey) AS who, l_linestatus = 'O' AS ap FROM lineitem),
f AS (SELECT id, min(seq) AS seq, arg_min(approve, seq) AS approve, arg_min(who, seq) AS who, arg_min(ap, seq) AS ap FROM d GROUP BY 1),
r AS (SELECT o_orderkey AS id, o_custkey, o_orderstatus AS st, f.* EXCLUDE (id), o_orderstatus = 'O' AND f.seq IS NOT NULL AS hit FROM orders LEFT JOIN f ON o_orderkey = f.id),
s AS (SELECT *, CASE WHEN hit THEN (CASE WHEN approve THEN 'approved' ELSE 'denied' END) WHEN st = 'F' THEN 'approved' WHEN st = 'O' THEN 'pending' ELSE 'denied' END AS status,
  CASE WHEN hit AND approve AND ap THEN CASE WHEN o_custkey % 10 IN (4, 5) THEN 'the product has no workspace' WHEN o_custkey % 3 = 0 THEN 'the requester''s principal id is unknown' END END AS err FROM r)
SELECT 'request' AS part, id AS request_id, status, CASE WHEN hit THEN who END AS decided_by, err AS grant_error, CASE WHEN hit AND approve THEN ap AND err IS NULL END AS grant_applied, cast(NULL AS bigint) AS conflicts FROM s
UNION ALL SELECT 'conflicts', d.id, s.status, NULL, NULL, NULL, count(*) FROM d JOIN s ON d.id = s.id WHERE NOT (s.hit AND d.seq = s.seq) GROUP BY 2, 3""")
def _(t):
    decision = t.sql("""SELECT l_orderkey AS request_id, l_linenumber * 1000000 + l_partkey * 1000 + l_suppkey AS seq, l_returnflag <> 'R' AS approve, concat('by', l_suppkey) AS decided_by, 'now' AS decided_at, l_linestatus = 'O' AS apply FROM lineitem""")
    product = t.sql("SELECT DISTINCT concat('dp', c_custkey % 10) AS id, CASE c_custkey % 10 WHEN 4 THEN '' WHEN 5 THEN NULL ELSE 'w' END AS workspace_id FROM customer")
    decided, conflicts = ru.decide(t.sql(REQUESTS), decision, product, True)
    met = conflicts.groupBy("request_id", F.col("met").alias("status")).agg(F.count(F.lit(1)).alias("conflicts"))
    nothing = F.lit(None).cast("string")
    return decided.select(F.lit("request").alias("part"), "request_id", "status", "decided_by", "grant_error", "grant_applied", F.lit(None).cast("bigint").alias("conflicts")).union(
        met.select(F.lit("conflicts"), "request_id", "status", nothing, nothing, F.lit(None).cast("boolean"), "conflicts")
    )
