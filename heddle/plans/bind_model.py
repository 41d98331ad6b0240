"""Lineage models bound from the order tables: one model per customer nation.

Landing (suppliers) -> Bronze (parts, grouped by type) -> Silver (orders and
their lines) -> Gold (customers and their totals per priority). Every table
grows linearly with `lineitem`.
"""

from .registry import binding

binding("b_line", """
SELECT concat('m', cast(c_nationkey AS string)) AS model_id, l_orderkey AS ok, l_partkey AS pk,
       l_suppkey AS sk, l_linenumber AS ln, o_custkey AS ck,
       substr(o_orderpriority, 1, 1) AS pr, substr(o_orderpriority, 3) AS pname,
       min(l_returnflag) AS rf, min(l_linestatus) AS ls,
       concat('l:', cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-',
              cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS lid
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
GROUP BY c_nationkey, l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, o_orderpriority
""", built="""
SELECT concat('m', cast(c_nationkey AS string)) AS model_id, l_orderkey AS ok, l_partkey AS pk,
       l_suppkey AS sk, l_linenumber AS ln, o_custkey AS ck,
       substr(o_orderpriority, 1, 1) AS pr, substr(o_orderpriority, 3) AS pname,
       min(l_returnflag) AS rf, min(l_linestatus) AS ls,
       concat('l:', cast(l_orderkey AS string), '-', cast(l_partkey AS string), '-',
              cast(l_suppkey AS string), '-', cast(l_linenumber AS string)) AS lid
FROM (SELECT o_orderkey, o_custkey, o_orderpriority, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey)
JOIN lineitem ON l_orderkey = o_orderkey
GROUP BY c_nationkey, l_orderkey, l_partkey, l_suppkey, l_linenumber, o_custkey, o_orderpriority
""")

binding("b_layer", """
SELECT concat('m', cast(n_nationkey AS string)) AS model_id, v.lid AS layer_id, v.nm AS layer_name, v.i AS layer_no
FROM nation CROSS JOIN (VALUES ('L0', 'Landing', 0), ('L1', 'Bronze', 1), ('L2', 'Silver', 2), ('L3', 'Gold', 3)) AS v(lid, nm, i)
""")

binding("b_model_supplier", """
SELECT DISTINCT model_id, sk, s_nationkey AS snk, concat('src_', lower(n_name)) AS oname, s_name AS sname
FROM b_line JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey
""", built="""
SELECT DISTINCT model_id, sk, s_nationkey AS snk, concat('src_', lower(n_name)) AS oname, s_name AS sname
FROM (SELECT DISTINCT model_id, sk FROM b_line) JOIN supplier ON sk = s_suppkey JOIN nation ON s_nationkey = n_nationkey
""")

binding("b_model_part", """
SELECT DISTINCT model_id, pk, p_brand AS brand, p_type AS ptype,
       concat(replace(p_name, ' ', '_'), '_', cast(pk AS string)) AS pname
FROM b_line JOIN part ON pk = p_partkey
""", built="""
SELECT DISTINCT model_id, pk, p_brand AS brand, p_type AS ptype,
       concat(replace(p_name, ' ', '_'), '_', cast(pk AS string)) AS pname
FROM (SELECT DISTINCT model_id, pk FROM b_line) JOIN part ON pk = p_partkey
""")

binding("b_model_order", """
SELECT concat('m', cast(c_nationkey AS string)) AS model_id, o_orderkey AS ok, o_custkey AS ck, o_orderstatus AS st
FROM orders JOIN customer ON o_custkey = c_custkey
""")

#: kind, depth: layer 0, object 1, attribute 2 and deeper. A group is an attribute with children.
#: Gold attributes are told apart before their customers are joined.
ENTITY = """
SELECT model_id, layer_id AS entity_id, 'layer' AS kind, layer_name AS name, cast(NULL AS string) AS parent_id,
       0 AS depth, layer_id, layer_name, cast(NULL AS string) AS object_id, cast(NULL AS string) AS object_name,
       true AS has_children, cast(layer_no AS bigint) AS ordinal, layer_name AS path
FROM b_layer
UNION ALL
SELECT DISTINCT model_id, concat('sn:', cast(snk AS string)), 'object', oname, 'L0', 1, 'L0', 'Landing',
       concat('sn:', cast(snk AS string)), oname, true, cast(snk AS bigint), concat('Landing / ', oname)
FROM b_model_supplier
UNION ALL
SELECT model_id, concat('s:', cast(sk AS string)), 'attribute', sname, concat('sn:', cast(snk AS string)), 2,
       'L0', 'Landing', concat('sn:', cast(snk AS string)), oname, false, sk, concat('Landing / ', oname, ' / ', sname)
FROM b_model_supplier
UNION ALL
SELECT DISTINCT model_id, concat('b:', brand), 'object', brand, 'L1', 1, 'L1', 'Bronze', concat('b:', brand), brand, true,
       cast(replace(brand, 'Brand#', '') AS bigint), concat('Bronze / ', brand)
FROM b_model_part
UNION ALL
SELECT DISTINCT model_id, concat('g:', brand, '|', ptype), 'attribute', ptype, concat('b:', brand), 2, 'L1', 'Bronze',
       concat('b:', brand), brand, true, cast(ascii(ptype) AS bigint), concat('Bronze / ', brand, ' / ', ptype)
FROM b_model_part
UNION ALL
SELECT model_id, concat('p:', cast(pk AS string)), 'attribute', pname, concat('g:', brand, '|', ptype), 3, 'L1', 'Bronze',
       concat('b:', brand), brand, false, pk, concat('Bronze / ', brand, ' / ', ptype, ' / ', pname)
FROM b_model_part
UNION ALL
SELECT o.model_id, concat('o:', cast(o.ok AS string)), 'object', concat('order_', cast(o.ok AS string)), 'L2', 1, 'L2', 'Silver',
       concat('o:', cast(o.ok AS string)), concat('order_', cast(o.ok AS string)), x.ok IS NOT NULL, o.ok,
       concat('Silver / order_', cast(o.ok AS string))
FROM b_model_order o LEFT JOIN (SELECT DISTINCT ok FROM b_line) x ON o.ok = x.ok
UNION ALL
SELECT model_id, lid, 'attribute', concat('line_', cast(ln AS string)), concat('o:', cast(ok AS string)), 2, 'L2', 'Silver',
       concat('o:', cast(ok AS string)), concat('order_', cast(ok AS string)), false, cast(ln AS bigint),
       concat('Silver / order_', cast(ok AS string), ' / line_', cast(ln AS string))
FROM b_line
UNION ALL
SELECT concat('m', cast(c.c_nationkey AS string)), concat('c:', cast(c_custkey AS string)), 'object', c_name, 'L3', 1, 'L3', 'Gold',
       concat('c:', cast(c_custkey AS string)), c_name, x.ck IS NOT NULL, c_custkey, concat('Gold / ', c_name)
FROM customer c LEFT JOIN (SELECT DISTINCT ck FROM b_line) x ON c_custkey = x.ck
UNION ALL
SELECT DISTINCT model_id, concat('cp:', cast(ck AS string), '-', pr), 'attribute', lower(pname), concat('c:', cast(ck AS string)), 2,
       'L3', 'Gold', concat('c:', cast(ck AS string)), c_name, false, cast(pr AS bigint), concat('Gold / ', c_name, ' / ', lower(pname))
FROM {gold} JOIN customer ON ck = c_custkey
"""

binding("b_entity", ENTITY.format(gold="b_line"), built=ENTITY.format(gold="(SELECT DISTINCT model_id, ck, pr, pname FROM b_line)"))

binding("b_transition", """
SELECT model_id, concat('t1:', lid) AS transition_id, concat('s:', cast(sk AS string)) AS source, lid AS target,
       ok * 64 + ln * 8 + 1 AS ordinal
FROM b_line
UNION ALL
SELECT model_id, concat('t2:', lid), concat('p:', cast(pk AS string)), lid, ok * 64 + ln * 8 + 2 FROM b_line
UNION ALL
SELECT model_id, concat('t3:', lid), lid, concat('cp:', cast(ck AS string), '-', pr), ok * 64 + ln * 8 + 3 FROM b_line WHERE ls = 'O'
UNION ALL
SELECT model_id, concat('t4:', cast(ok AS string)), concat('o:', cast(ok AS string)), concat('c:', cast(ck AS string)), ok * 64 + 4
FROM b_model_order
UNION ALL
SELECT model_id, concat('t5:', cast(ok AS string)), concat('o:', cast(ok AS string)), concat('x:', cast(ok AS string)), ok * 64 + 5
FROM b_model_order WHERE st = 'P'
""")

binding("b_property", """
SELECT model_id, concat('t2:', lid) AS entity_id, 'Source' AS key,
       CASE WHEN rf = 'R' THEN 'notebook run' ELSE '' END AS value
FROM b_line WHERE rf IN ('R', 'A')
UNION ALL
SELECT model_id, concat('t2:', lid), 'Transform', concat('amount * ', cast(ln AS string)) FROM b_line WHERE ls = 'O'
UNION ALL
SELECT model_id, concat('t3:', lid), 'Via', concat('step_', cast(ln AS string)) FROM b_line WHERE ln <= 2
UNION ALL
SELECT concat('m', cast(c_nationkey AS string)), concat('c:', cast(c_custkey AS string)), 'Segment', c_mktsegment FROM customer
UNION ALL
SELECT concat('m', cast(c_nationkey AS string)), concat('c:', cast(c_custkey AS string)), 'Tags',
       concat(lower(c_mktsegment), CASE WHEN c_acctbal < 0 THEN ', Overdrawn' WHEN c_acctbal < 3000 THEN ' ,overdrawn,Thin , ' ELSE '' END)
FROM customer
UNION ALL
SELECT concat('m', cast(c_nationkey AS string)), concat('c:', cast(c_custkey AS string)), 'Note', ''
FROM customer WHERE c_acctbal > 8000
UNION ALL
SELECT model_id, concat('x:', cast(ok AS string)), 'Owner', 'nobody' FROM b_model_order WHERE st = 'F'
""")
