"""Raw references, notebook cells and plan texts composed from order lines."""

from .registry import binding

#: Lake GUIDs: one per supplier, named only for even keys. Workspace GUIDs: one per nation.
binding("b_guid_name", """
SELECT lower(concat(lpad(cast(s_suppkey AS string), 8, '0'), '-AAAA-BBBB-CCCC-', lpad(cast(s_suppkey AS string), 12, '0'))) AS guid,
       concat('Lake_', cast(s_suppkey AS string)) AS name
FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL
SELECT concat(lpad(cast(n_nationkey AS string), 8, '0'), '-dddd-eeee-ffff-', lpad(cast(n_nationkey AS string), 12, '0')), n_name
FROM nation
""")

#: Seven spellings of a reference by line number; ws and lh are the defaults of the place they stand in.
binding("b_rawref", """
SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk, l_linenumber AS ln, s_nationkey AS nk,
       concat('Ws', cast(s_nationkey AS string)) AS ws, concat('Home', cast(s_nationkey AS string)) AS lh,
       CASE l_linenumber
         WHEN 1 THEN concat(' `t_', cast(l_partkey AS string), '` ')
         WHEN 2 THEN concat('Lk', cast(l_suppkey AS string), '.t_', cast(l_partkey AS string))
         WHEN 3 THEN concat('W 50%.Lk', cast(l_suppkey AS string), '.t_', cast(l_partkey AS string))
         WHEN 4 THEN concat('abfss://', lpad(cast(s_nationkey AS string), 8, '0'), '-DDDD-eeee-ffff-', lpad(cast(s_nationkey AS string), 12, '0'),
                            '@acct.example/', lpad(cast(l_suppkey AS string), 8, '0'), '-AAAA-bbbb-cccc-', lpad(cast(l_suppkey AS string), 12, '0'),
                            '/Tables/t_', cast(l_partkey AS string), '/_delta_log/00000000000000000007.json')
         WHEN 5 THEN concat('"abfss://onelake@acct.example/Shop/Lk', cast(l_suppkey AS string), '.Lakehouse/Tables/dbo/t_', cast(l_partkey AS string), '/"')
         WHEN 6 THEN concat('Files/landing/t_', cast(l_partkey AS string), '/*.csv')
         ELSE concat('/mnt/Tables/t_', cast(l_partkey AS string), '/part-0001.snappy.parquet') END AS raw
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
""")

#: One notebook per order, one cell per line; the text depends on the line number.
binding("b_cell", """
SELECT ok AS nb_id, ln AS cell_index, ck, pk, sk, lid,
  CASE ln
    WHEN 1 THEN concat('from pyspark.sql import Row', chr(10), 'import json', chr(10), 'df = spark.table("Raw.t_', cast(pk AS string), '")')
    WHEN 2 THEN concat('df = spark.read.format("delta").load("abfss://onelake@acct/Shop/Lk', cast(sk AS string), '.Lakehouse/Tables/t_', cast(pk AS string), '")')
    WHEN 3 THEN concat('x = 1', chr(10), 'y = spark.sql("SELECT a.qty, a.price * ', cast(sk AS string), ' AS total, * , b.', chr(252), 'nit FROM t_', cast(pk AS string), ' a JOIN dim_', cast(sk AS string), ' b")')
    WHEN 4 THEN concat('df.write.mode("overwrite").saveAsTable("out_', cast(sk AS string), '")')
    WHEN 5 THEN concat('%%sql', chr(10), 'INSERT INTO t_', cast(pk AS string), ' SELECT k, v FROM stage_', cast(sk AS string))
    WHEN 6 THEN concat('q = f"SELECT * FROM {t}"', chr(10), 'spark.sql(q).write.format("x").parquet("Files/out/f_', cast(sk AS string), '")')
    ELSE concat('CREATE OR REPLACE TABLE Gold.g_', cast(sk AS string), ' AS SELECT', chr(10), ' k FROM t_', cast(pk AS string), ' where (') END AS source
FROM b_line
""")

binding("b_notebook", """
SELECT o_orderkey AS nb_id, concat('Ws', cast(c_nationkey AS string)) AS workspace, 'Home' AS lakehouse,
       concat('nb_', cast(o_orderkey AS string)) AS name, concat('m', cast(c_nationkey AS string)) AS graph_id
FROM orders JOIN customer ON o_custkey = c_custkey
""")

#: One statement per line: scans the part's table, writes the supplier's.
binding("b_execution", """
SELECT lid AS execution_id, ok, pk, sk, ln,
  CASE ln
    WHEN 1 THEN concat('== Physical Plan ==', chr(10), 'Execute InsertIntoHadoopFsRelationCommand (2)', chr(10), '+- Scan parquet (1)', chr(10), chr(10),
      '(1) Scan parquet  [codegen id : 1]', chr(10), 'Output: [a#1]', chr(10), 'Location: InMemoryFileIndex [abfss://onelake@acct/Shop/Raw.Lakehouse/Tables/t_',
      cast(pk AS string), '/_delta_log, ... 3 entries]', chr(10), chr(10),
      '(2) Execute InsertIntoHadoopFsRelationCommand', chr(10), 'Input: [a#1]', chr(10), 'Arguments: abfss://onelake@acct/Shop/Out.Lakehouse/Tables/o_',
      cast(sk AS string), ', false, `zzz`.`option`', chr(10))
    WHEN 2 THEN concat('(1) Scan delta spark_catalog.bronze.t_', cast(pk AS string), chr(10), 'Output: [a#1]', chr(10), 'Batched: true', chr(10), chr(10),
      '(2) LocalTableScan [codegen id : 2]', chr(10), 'Arguments: [x]', chr(10), chr(10),
      '(3) CreateTableAsSelectExec', chr(10), 'Arguments: `spark_catalog`.`silver`.`o_', cast(sk AS string), '`, `spark_catalog`.`silver`.`other`', chr(10))
    WHEN 3 THEN concat('(1) BatchScan', chr(10), 'Arguments: `DummyDeltaTable`', chr(10), '(2) Execute OptimizeTableCommand', chr(10), 'Arguments: `x`', chr(10))
    WHEN 4 THEN concat('*(1) Project [a]', chr(10), '   +- *(1) FileScan parquet [a] Location: X[abfss://onelake@acct/Shop/Raw.Lakehouse/Tables/t_', cast(pk AS string), ']')
    WHEN 5 THEN concat('(1) MergeIntoCommandEdge', chr(10), 'Arguments: `silver`.`o_', cast(sk AS string), '`', chr(10), chr(10),
      '(2) DataSourceV2Relation', chr(10), 'Arguments: `silver`.`o_', cast(sk AS string), '`', chr(10))
    WHEN 6 THEN concat('(1) Execute AppendDataExecV1', chr(10), 'Output: []', chr(10), '(2) HashAggregate', chr(10), 'Arguments: abfss://onelake@a/b/c/Tables/d', chr(10))
    ELSE '' END AS plan,
  CASE ls WHEN 'O' THEN 'COMPLETED' ELSE 'FAILED' END AS status, ln * 100 AS duration_ms
FROM b_line
""")
