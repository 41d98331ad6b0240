"""Golden rows for references, code cells and plan texts."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from heddle.functions import code, plantext, refs
from heddle.sources import landed, models

GUID = "11111111-2222-3333-4444-555555555555"


@pytest.mark.parametrize(
    "raw,want",
    [
        ("orders", "Ws/Lh/orders"),
        ("`orders`", "Ws/Lh/orders"),
        ("Gold.orders", "Ws/Gold/orders"),
        ("Fin.Gold.orders", "Fin/Gold/orders"),
        ("a.Fin.Gold.orders", "Fin/Gold/orders"),
        (f"abfss://{GUID}@x.y/Gold.Lakehouse/Tables/dbo/orders", "Finance/Gold/orders"),
        ("abfss://OneLake@x.y/Fin/Gold.Warehouse/Tables/orders/_delta_log/0.json", "Fin/Gold/orders"),
        ("abfss://c@x.y/Gold/Files/in/a b.csv", "c/Gold/Files%2Fin%2Fa b.csv"),
        ("Files/landing/*.csv", "Ws/Lh/Files%2Flanding%2F*.csv"),
        ("Tables/orders/", "Ws/Lh/orders"),
        ("50%", "Ws/Lh/50%25"),
        ("", "//"),
        ("abfss://c@x.y/", "Ws/Lh/c@x.y"),
        ("abfss://onelake@x.y/Fin/Gold/", "Fin/Gold/"),
    ],
)
def test_qualify(spark, raw, want):
    names = spark.createDataFrame([(GUID, "Finance")], "guid string, name string")
    df = spark.createDataFrame([(raw, "Ws", "Lh")], "raw string, ws string, lh string")
    assert refs.qualify(df, "raw", "ws", "lh", names).first()["ref"] == want
    again = refs.as_ref(df.select(F.lit(want).alias("raw"), "ws", "lh"), "raw", "ws", "lh", names).first()["ref"]
    assert again == want
    assert refs.qualify(df, "raw", "ws", "lh", names, placed=True).count() == (0 if want.endswith("/") else 1)


def features(spark, source):
    df = spark.createDataFrame([("n", 0, source)], "nb_id string, cell_index int, source string")
    r = code.cell_features(df).first()
    return r["sql_statements"], r["frame_write"], r["dynamic_sql"], r["unparsable"]


@pytest.mark.parametrize(
    "source,want",
    [
        ("%%sql\nSELECT 1", (1, False, False, False)),
        ("%%sql SELECT 1", (0, False, False, False)),
        ("%%spark-sql\n\n  SELECT 1", (1, False, False, False)),
        ("f(df.write).parquet('p')", (0, False, False, False)),
        ("df.write.mode('x')\\\n  .option('a', 1).parquet('p')", (0, True, False, False)),
        ("x = df.write.parquet", (0, False, False, False)),
        ("spark.sql(query=q)", (0, False, False, False)),
        ("(" * 5000, (0, False, False, True)),
        ("%%configure\n{}", (0, False, False, False)),
        ("spark.sql('SELECT 1')", (1, False, False, False)),
        ("spark.sql(f'SELECT {x}')", (0, False, True, False)),
        ("df.write.mode('x').saveAsTable('t')", (0, True, False, False)),
        ("df.write.parquet('p')", (0, True, False, False)),
        ("spark.read.parquet('p')", (0, False, False, False)),
        ("spark.sql('INSERT INTO t SELECT 1')\ndf.write.save('p')", (1, False, False, False)),
        ("def (", (0, False, False, True)),
        ("", (0, False, False, False)),
    ],
)
def test_cell_features(spark, source, want):
    assert features(spark, source) == want


def test_code_access_ignores_imports_and_keeps_globs(spark):
    cell = spark.createDataFrame(
        [("n", 0, "from a.b import c\nimport d\nx = spark.read.csv('Files/in/*.csv')\ny = spark.read.format('delta').table(\"größe\")\nz = 'select * from'\nq = spark.sql('''SELECT a FROM\n  t1 join t2''')")],
        "nb_id string, cell_index int, source string",
    )
    got = {(r["access"], r["raw"]) for r in code.raw_access(cell).collect()}
    assert got == {("read", "Files/in/*.csv"), ("read", "t1"), ("read", "t2")}


@pytest.mark.parametrize(
    "name,want",
    [
        ("Execute InsertIntoHadoopFsRelationCommand", "write"), ("CreateTableAsSelectExec", "write"), ("Execute CreateTableCommand", "skip"), ("AtomicReplaceTableAsSelect", "write"),
        ("MergeIntoCommandEdge", "write"), ("Scan parquet", "read"), ("BatchScan", "read"), ("StreamingDataSourceV2Relation", "read"), ("LocalTableScan", ""), ("HashAggregate", ""), ("Execute OptimizeTableCommand", "skip"),
    ],
)
def test_node_class(spark, name, want):
    assert spark.range(1).select(plantext.node_class(F.lit(name)).alias("c")).first()["c"] == want


def test_a_table_read_and_written_by_one_plan_is_written(spark):
    plan = "(1) Scan parquet\nLocation: X [abfss://onelake@a/W/L/Tables/t/part-0.parquet, ...]\n\n(2) Execute InsertIntoX [codegen id : 1]\nArguments: abfss://onelake@a/W/L/Tables/t, x\n"
    ex = spark.createDataFrame([("e", plan)], "execution_id string, plan string")
    context = spark.createDataFrame([("e", "Ws", "Lh")], "execution_id string, workspace string, lakehouse string")
    found = plantext.access(plantext.node_refs(plantext.blocks(ex), context)).collect()
    assert [(r["access"], r["ref"]) for r in found] == [("write", "W/L/t")]


def test_notebook_without_a_code_part_gives_nothing(spark):
    part = [("n", None, [(".platform", base64.b64encode(b"{}").decode())])]
    df = spark.createDataFrame(part, "nb_id string, lakehouse string, parts array<struct<path: string, payload: string>>")
    assert landed.notebook_cells(df).count() == 0


def test_flatten_any_depth_and_broken_documents(spark):
    def nest(n):
        return {"id": f"a{n}", "name": f"x{n}", "children": [nest(n + 1)] if n < 23 else []}

    doc = {"name": "m", "layers": [{"id": "l", "name": "L", "objects": [{"id": "o", "name": "O", "children": [nest(0), {"id": "b", "name": "B", "children": []}]}]}], "transitions": [], "properties": {}}
    df = spark.createDataFrame([("m", json.dumps(doc)), ("bad", "{nope")], "model_id string, doc string")
    entity, edges, bags = models.flatten(df)
    rows = {r["entity_id"]: r for r in entity.filter("model_id = 'm'").collect()}
    assert len(rows) == 27 and entity.filter("model_id = 'bad'").count() == 0
    assert rows["a23"]["depth"] == 25 and rows["a23"]["parent_id"] == "a22" and not rows["a23"]["has_children"]
    assert rows["b"]["ordinal"] == [0, 0, 1] and rows["a5"]["object_id"] == "o"
    assert edges.count() == 0 and bags.count() == 0


def test_patterns_are_matched_once_and_where_they_can(spark):
    """Letters that count as others in any case are found, a cell's import lines are not, and a cell is scanned once whatever the patterns."""
    cells = [(1, "ſpark.table('kelvin')"), (2, "SPARK.TABLE('A.b')\ninsert  into c.d"), (3, "from a import b\nx = 1"), (4, None), (5, "SELECT 1 FROM t JOIN u"), (6, "df.ｗrite.parquet('p')")]
    df = spark.createDataFrame(cells, "nb_id int, source string").withColumn("cell_index", F.lit(0))
    found = code.raw_access(df)
    assert {(r["nb_id"], r["access"], r["raw"]) for r in found.collect()} == {
        (1, "read", "kelvin"), (2, "read", "A.b"), (2, "write", "c.d"), (5, "read", "t"), (5, "read", "u")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 1
    wide = {r["nb_id"]: r["frame_write"] for r in code.cell_features(df).collect()}
    assert wide[6] is True and wide[1] is False
