"""Registered queries over run history, bound from the event stream."""

from pyspark.sql import functions as F

from heddle.functions import plantext
from heddle.operators import runs
from heddle.session import cut

from .registry import binding, query

# One session per event; a fifth of them spell their fields differently.
RAW_SESSIONS = """SELECT user_id AS nb_id, event_id AS ordinal, concat('lv', event_id) AS livyId, '' AS livySessionId, '' AS id,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('app', event_id) END AS sparkApplicationId, cast(NULL AS string) AS applicationId,
  CASE WHEN event_id % 8 = 0 THEN concat('old', event_id) ELSE '' END AS appId,
  CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'running' ELSE NULL END AS state,
  CASE event_type WHEN 'signup' THEN 'starting' ELSE 'queued' END AS status,
  CASE WHEN event_id % 5 = 0 THEN '' ELSE date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') END AS submittedDateTime,
  date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS startDateTime, '' AS queuedDateTime, concat('u', event_id % 7) AS submitter, '' AS creator FROM events"""

SESSION_SQL = """SELECT user_id AS nb_id, event_id, concat('lv', event_id) AS livy_id, CASE WHEN event_id % 8 = 0 THEN concat('old', event_id) WHEN event_id % 4 = 0 THEN '' ELSE concat('app', event_id) END AS app_id,
  CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'view' THEN 'running' WHEN 'signup' THEN 'starting' ELSE 'queued' END AS state,
  strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS submitted_at, concat('u', event_id % 7) AS submitter, event_type IN ('purchase', 'error') AS ended, ts FROM events"""

LATEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nb_id ORDER BY ended DESC, submitted_at DESC, event_id) AS r FROM ({SESSION_SQL})) WHERE r = 1)"


def _latest(t):
    return runs.latest_run(runs.sessions(t.sql(RAW_SESSIONS)))


@query("src_run_history", f"SELECT nb_id, livy_id, app_id, state, submitted_at, submitter FROM {LATEST}")
def _(t):
    return _latest(t).drop("ordinal")


# Each session ran one to three statements (by its k) and, every hundredth session, 250 of them.
binding("b_k", """
SELECT event_id, user_id, ts, event_type, value, cast(replace(replace(split_part(props, ':', 2), '}', ''), ' ', '') AS int) AS k FROM events
""")

STATEMENT_SQL = """SELECT livy_id, i AS execution_id, k, CASE WHEN i = 3 THEN 'none' ELSE concat('x', k % 10 + i) END AS leaf
  FROM (SELECT concat('lv', event_id) AS livy_id, k, {series} AS i FROM b_k) s"""
LAST = "CASE WHEN event_id % 100 = 0 THEN 250 ELSE k % 3 + 1 END"


def _executions(t):
    return t.sql("""SELECT livy_id, execution_id, concat(livy_id, '#', execution_id) AS key, repeat(concat('run ', k, ' '), 60) AS description,
        'COMPLETED' AS status, cast(k AS string) AS submitted, k * 10 AS duration_ms,
        CASE WHEN execution_id = 3 THEN '(1) LocalTableScan\nArguments: [a]\n' ELSE concat('(1) Scan parquet\nLocation: X [abfss://onelake@a/W/L/Tables/x', k % 10 + execution_id,
           ']\n\n(2) AppendData\nArguments: abfss://onelake@a/W/L/Tables/y', k % 10, ', x\n') END AS plan
        FROM (""" + STATEMENT_SQL.format(series=f"explode(sequence(1, {LAST}))") + ")")


def _plan_access(t):
    ex = _executions(t)
    block = plantext.blocks(ex.select(F.col("key").alias("execution_id"), "plan"))
    context = ex.select(F.col("key").alias("execution_id"), F.lit("W").alias("workspace"), F.lit("L").alias("lakehouse"))
    found = plantext.access(plantext.node_refs(block, context))
    parts = F.split("execution_id", "#")
    access = found.select(parts[0].alias("livy_id"), parts[1].cast("int").alias("execution_id"), "access", "ref")
    return ex.drop("key", "plan"), cut(access)


RUN_ACCESS = "b AS (" + STATEMENT_SQL.format(series=f"unnest(generate_series(1, {LAST}))") + """),
acc AS (SELECT livy_id, execution_id, 'read' AS access, concat('W/L/', leaf) AS ref FROM b WHERE leaf <> 'none'
  UNION SELECT livy_id, execution_id, 'write', concat('W/L/y', k % 10) FROM b WHERE leaf <> 'none')"""


@query("run_observed", f"""
WITH {RUN_ACCESS}, l AS {LATEST}
SELECT l.nb_id, l.livy_id, l.app_id, l.state, l.submitted_at, l.app_id <> '' AS available, count(DISTINCT b.execution_id) AS seen,
       count(DISTINCT CASE WHEN b.leaf <> 'none' THEN b.execution_id END) AS resolved,
       CASE WHEN l.app_id = '' THEN 'no application id' WHEN count(b.execution_id) = 0 THEN 'no statements'
            WHEN count(CASE WHEN b.leaf <> 'none' THEN 1 END) = 0 THEN 'none resolved' END AS reason,
       (SELECT string_agg(DISTINCT concat(access, ' ', ref), ',' ORDER BY concat(access, ' ', ref)) FROM acc WHERE acc.livy_id = l.livy_id AND l.app_id <> '') AS tables
FROM l LEFT JOIN b ON l.livy_id = b.livy_id AND l.app_id <> '' GROUP BY 1, 2, 3, 4, 5, 6""")
def _(t):
    executions, access = _plan_access(t)
    counts, run = runs.observed_run(_latest(t), executions, access)
    listed = run.groupBy("nb_id").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "access", "ref"))), ",").alias("tables"))
    return counts.join(listed, "nb_id", "left")


@query("run_statements", f"""
WITH {RUN_ACCESS}
SELECT acc.livy_id, cast(acc.execution_id AS integer) AS execution_id, access, ref, repeat(concat('run ', k, ' '), 60) AS description, k * 10 AS duration_ms
FROM acc JOIN b ON acc.livy_id = b.livy_id AND acc.execution_id = b.execution_id""")
def _(t):
    rows, access = runs.statements(*_plan_access(t))
    return rows.join(access, ["livy_id", "execution_id"]).select("livy_id", "execution_id", "access", "ref", "description", "duration_ms")


@query("run_code_newer", f"""
SELECT nb_id, coalesce(strftime(m, '%Y-%m-%d %H:%M:%S.%f') > submitted_at, false) AS code_newer
FROM {LATEST} LEFT JOIN (SELECT user_id, max(ts) AS m FROM events WHERE event_type = 'click' GROUP BY 1) ON nb_id = user_id""")
def _(t):
    modified = t.sql("SELECT user_id AS nb_id, date_format(max(ts), 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS modified_at FROM events WHERE event_type = 'click' GROUP BY 1")
    return runs.code_newer(_latest(t), modified)


# Predicted and observed access per user: even k is predicted, k divisible by 3 observed.
PREDICTED = "SELECT user_id AS run_id, CASE WHEN k % 4 < 2 THEN 'read' ELSE 'write' END AS access, concat('W/L/t', k) AS ref FROM b_k WHERE k % 2 = 0"
OBSERVED = "SELECT user_id AS run_id, CASE WHEN k % 4 < 2 THEN 'read' ELSE 'write' END AS access, concat('W/L/t', k) AS ref FROM b_k WHERE k % 3 = 0"
COMPARED = """SELECT DISTINCT user_id AS run_id, CASE WHEN k % 4 < 2 THEN 'read' ELSE 'write' END AS access, concat('W/L/t', k) AS ref,
  CASE WHEN k % 6 = 0 THEN 'agreed' WHEN k % 2 = 0 THEN 'predicted_only' ELSE 'observed_only' END AS verdict FROM b_k WHERE k % 2 = 0 OR k % 3 = 0"""


@query("run_compare", COMPARED)
def _(t):
    return runs.compare(t.sql(PREDICTED), t.sql(OBSERVED))


@query("run_compare_counts", f"""
SELECT run_id, count(*) FILTER (verdict = 'agreed' AND access = 'read') AS agreed_reads, count(*) FILTER (verdict = 'agreed' AND access = 'write') AS agreed_writes,
 count(*) FILTER (verdict = 'predicted_only' AND access = 'read') AS predicted_only_reads, count(*) FILTER (verdict = 'predicted_only' AND access = 'write') AS predicted_only_writes,
 count(*) FILTER (verdict = 'observed_only' AND access = 'read') AS observed_only_reads, count(*) FILTER (verdict = 'observed_only' AND access = 'write') AS observed_only_writes,
 bool_and(verdict = 'agreed') AS agrees FROM ({COMPARED}) GROUP BY 1""")
def _(t):
    return runs.compare_counts(runs.compare(t.sql(PREDICTED), t.sql(OBSERVED)))


RUN_ROWS = """SELECT user_id % 10 AS sequence_id, user_id AS run_id, max(event_id) % 3 <> 0 AS available, cast(max(event_id) AS string) AS submitted_at,
  concat('u', max(event_id)) AS submitter, 'ok' AS state, cast(max(event_id + value) AS string) AS code_changed_at FROM events GROUP BY 1, 2"""


@query("run_observed_summary", f"""
WITH r AS (SELECT user_id % 10 AS sequence_id, user_id AS run_id, max(event_id) % 3 <> 0 AS available, cast(max(event_id) AS varchar) AS submitted_at FROM events GROUP BY 1, 2),
c AS (SELECT r.sequence_id, c.ref, c.verdict FROM ({COMPARED}) c JOIN r ON c.run_id = r.run_id WHERE available),
s AS (SELECT DISTINCT sequence_id, ref, verdict FROM c WHERE verdict <> 'predicted_only' OR (sequence_id, ref) NOT IN (SELECT sequence_id, ref FROM c WHERE verdict = 'agreed'))
SELECT r.sequence_id, count(*) AS asked, count(*) FILTER (available) AS available, max(submitted_at) FILTER (available) AS last_run_at,
  'u' || max(submitted_at) FILTER (available) AS last_run_by, 
  (SELECT count(*) FROM s WHERE s.sequence_id = r.sequence_id AND verdict = 'agreed') AS agreed,
  (SELECT count(*) FROM s WHERE s.sequence_id = r.sequence_id AND verdict = 'predicted_only') AS predicted_only,
  (SELECT count(*) FROM s WHERE s.sequence_id = r.sequence_id AND verdict = 'observed_only') AS observed_only
FROM r GROUP BY 1""")
def _(t):
    observed = t.sql(RUN_ROWS)
    comparison = runs.compare(t.sql(PREDICTED), t.sql(OBSERVED)).withColumn("sequence_id", F.col("run_id") % 10)
    summary, refs = runs.observed_summary(observed, comparison)
    n = refs.groupBy("sequence_id").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in ("agreed", "predicted_only", "observed_only")])
    return summary.drop("code_is_newer", "last_run_state").join(n, "sequence_id", "left").fillna(0, ["agreed", "predicted_only", "observed_only"])


RUNS = """SELECT o_custkey % 100 AS sequence_id, o_orderkey AS run_id, o_orderkey AS ordinal, concat('nb_', o_orderkey) AS name,
  CASE WHEN o_orderstatus = 'F' THEN 'boom' WHEN o_orderstatus = 'P' THEN '' END AS error FROM orders"""
CELLS = "SELECT l_orderkey AS run_id, l_linenumber AS cell_index, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'ok' END AS status, CASE WHEN l_linestatus = 'F' THEN concat('e', l_partkey) END AS error FROM lineitem"


@query("run_failures", """
SELECT o_custkey % 100 AS sequence_id, o_orderkey AS ordinal, 'run' AS scope, concat('nb_', o_orderkey) AS name, cast(NULL AS integer) AS cell, 'boom' AS error FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_custkey % 100, o_orderkey, 'cell', concat('nb_', o_orderkey), l_linenumber + 1, concat('e', l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE l_returnflag = 'R' AND l_linestatus = 'F'
UNION ALL SELECT c_custkey, c_custkey, 'step', c_name, NULL, 'no access' FROM customer WHERE c_acctbal < 0""")
def _(t):
    step = t.sql("SELECT c_custkey AS sequence_id, c_custkey AS ordinal, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'no access' END AS error FROM customer")
    return runs.failures(step, t.sql(RUNS), t.sql(CELLS))


ACCESS = "SELECT l_orderkey AS run_id, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS access, concat('t', l_partkey) AS ref FROM lineitem"


@query("run_narrative_counts", """
WITH l AS (SELECT o_custkey % 100 AS sequence_id, l.* FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
SELECT o.sequence_id, n AS notebooks, coalesce(c, 0) AS cells, coalesce(r, 0) AS reads, coalesce(w, 0) AS writes, coalesce(b, 0) AS bare
FROM (SELECT o_custkey % 100 AS sequence_id, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN
 (SELECT sequence_id, count(*) AS c, count(DISTINCT l_partkey) FILTER (l_linenumber < 4) AS r, count(DISTINCT l_partkey) FILTER (l_linenumber >= 4) AS w,
   count(DISTINCT l_partkey) FILTER (l_linenumber >= 4 AND l_returnflag = 'R') AS b FROM l GROUP BY 1) x ON o.sequence_id = x.sequence_id""")
def _(t):
    bare = t.sql("SELECT l_orderkey AS run_id, concat('t', l_partkey) AS ref FROM lineitem WHERE l_linenumber >= 4 AND l_returnflag = 'R'")
    return runs.narrative_counts(t.sql(RUNS), t.sql(CELLS), t.sql(ACCESS), bare)


COVERAGE = """WITH l AS (SELECT o_custkey % 100 AS sequence_id, l_orderkey AS run_id, concat('t', l_partkey % 50) AS ref, max(l_linenumber) AS m, min(l_linenumber) AS lo, o_orderkey % 6 AS o
   FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, o_orderkey),
g AS (SELECT *, CASE WHEN lo = 1 AND m > 5 THEN 2 WHEN m > 2 THEN 1 ELSE 0 END AS rank,
  CASE WHEN lo = 1 AND m > 5 THEN '' WHEN m > 2 THEN (CASE WHEN m < 4 THEN 'read only' WHEN o = 0 THEN 'no coverage recorded' WHEN o = 1 THEN 'frame write' WHEN o = 2 THEN 'dynamic sql' WHEN o = 3 THEN 'unparsable cell' ELSE 'unknown' END)
       WHEN m = 1 THEN (CASE WHEN o = 4 THEN 'schema unreadable: f4' ELSE 'schema unreadable' END) ELSE 'no columns resolved' END AS reason FROM l),
best AS (SELECT *, row_number() OVER (PARTITION BY sequence_id, ref ORDER BY rank DESC, run_id) AS r FROM g)
"""


@query("run_table_coverage", COVERAGE + """
SELECT sequence_id, ref, CASE rank WHEN 2 THEN 'traced' WHEN 1 THEN 'columns-only' ELSE 'bare' END AS level, reason FROM best WHERE r = 1""")
def _(t):
    return _coverage(t)


def _coverage(t):
    access = t.sql("""SELECT o_custkey % 100 AS sequence_id, l_orderkey AS run_id, l_orderkey AS ordinal, CASE WHEN l_linenumber < 4 THEN 'read' ELSE 'write' END AS access,
        concat('t', l_partkey % 50) AS ref, l_linenumber AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
    per = access.groupBy("run_id", "ref").agg(F.min("ln").alias("lo"), F.max("ln").alias("m"))
    coverage = t.sql("""SELECT o_orderkey AS run_id, o_orderkey % 6 IN (1) AS f, CASE o_orderkey % 6 WHEN 1 THEN 1 ELSE 0 END AS frame_write_cells, CASE o_orderkey % 6 WHEN 2 THEN 1 ELSE 0 END AS dynamic_sql_cells,
        CASE o_orderkey % 6 WHEN 3 THEN 1 ELSE 0 END AS unparsable_cells, CASE o_orderkey % 6 WHEN 4 THEN 'f4' END AS first_failure FROM orders WHERE o_orderkey % 6 <> 0""").drop("f")
    return runs.table_coverage(access.drop("ln"), per.filter("lo = 1 and m > 5"), per.filter("m > 2"), per.filter("m = 1"), coverage)


@query("run_coverage_counts", COVERAGE + """
SELECT sequence_id, count(*) AS tables, count(*) FILTER (rank = 2) AS traced, count(*) FILTER (rank = 1) AS columns_only, count(*) FILTER (rank = 0) AS bare FROM best WHERE r = 1 GROUP BY 1""")
def _(t):
    return runs.coverage_counts(_coverage(t))


@query("run_diff", """
WITH o AS (SELECT o_custkey AS sequence_id, o_orderkey AS cur, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders),
p AS (SELECT * FROM o WHERE prev IS NOT NULL),
l AS (SELECT DISTINCT l_orderkey AS x, concat('t', l_suppkey) AS ref, concat('c', l_linenumber) AS col, l_returnflag = 'R' AS tr FROM lineitem),
tb AS (SELECT DISTINCT sequence_id, cur, prev, ref FROM p JOIN l ON x IN (cur, prev)),
cb AS (SELECT DISTINCT sequence_id, cur, prev, ref, col FROM p JOIN l ON x IN (cur, prev)),
m AS (SELECT sequence_id, cur, ref, max(x = prev) AS b, max(x = cur) AS a, max(x = prev AND tr) AS tb, max(x = cur AND tr) AS ta FROM p JOIN l ON x IN (cur, prev) GROUP BY 1, 2, 3),
mc AS (SELECT sequence_id, cur, ref, col, max(x = prev) AS b, max(x = cur) AS a FROM p JOIN l ON x IN (cur, prev) GROUP BY 1, 2, 3, 4)
SELECT concat(sequence_id, '@', cur) AS sequence_id, CASE WHEN a THEN 'added table' ELSE 'removed table' END AS change, ref, NULL AS column_name FROM m WHERE a <> b
UNION ALL SELECT concat(sequence_id, '@', cur), CASE WHEN a THEN 'added column' ELSE 'removed column' END, ref, col FROM mc WHERE a <> b
UNION ALL SELECT concat(sequence_id, '@', cur), 'lost lineage', ref, NULL FROM m WHERE a AND tb AND NOT ta""")
def _(t):
    rows = t.sql("SELECT l_orderkey AS execution, concat('t', l_suppkey) AS ref, concat('c', l_linenumber) AS column_name, l_returnflag FROM lineitem")
    pair = t.sql("""SELECT concat(o_custkey, '@', o_orderkey) AS sequence_id, o_orderkey AS current,
                    lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders""")
    return runs.diff_runs(rows, rows, rows.filter("l_returnflag = 'R'"), pair)
