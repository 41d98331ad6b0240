import base64

from heddle.plans import catalog  # noqa: F401  registers the tables
from heddle.plans.registry import Inputs
from heddle.session import forget
from heddle.sources import landed, models


def test_sheets_with_quotes_line_breaks_and_headers(spark, tmp_path):
    (tmp_path / "t1.csv").write_text('\ufeffColumn,Description\nid,"the ""key""\nof a row"\nname,"a, b"\n,none\n', encoding="utf-8")
    (tmp_path / "t2.csv").write_text("x,plain\n")
    got = sorted(tuple(r) for r in landed.read_definition_sheets(spark, str(tmp_path)).collect())
    assert got == [("t1", 1, "id", 'the "key"\nof a row'), ("t1", 2, "name", "a, b"), ("t2", 0, "x", "plain")]


def test_bundles_over_several_lines(spark, tmp_path):
    (tmp_path / "one.json").write_text('{\n "name": "m",\n "layers": [],\n "transitions": []\n}\n')
    assert [r.name for r in models.read_bundles(spark, str(tmp_path), 5).collect()] == ["m"]


def test_bad_parts_stop_no_others(spark):
    code = base64.b64encode(b"# CELL ********************\nx = 1\n").decode()
    broken = base64.b64encode(b"# CELL ********************\ny = '\xff'\n").decode()
    rows = [("a", "l", [("notebook-content.py", code)]), ("b", "l", [("notebook-content.py", "%%%")]), ("c", "l", [("notebook-content.py", broken)])]
    definition = spark.createDataFrame(rows, "nb_id string, lakehouse string, parts array<struct<path: string, payload: string>>")
    got = {r.nb_id: r.source.strip() for r in landed.notebook_cells(definition).collect()}
    assert got == {"a": "x = 1", "c": "y = '\ufffd'"}


def test_queries_after_forget(spark):
    inputs = Inputs(spark, "/root/testdata/sf0.001")
    before = inputs("b_entity").count()
    forget(spark)
    assert Inputs(spark, "/root/testdata/sf0.001")("b_entity").count() == before
