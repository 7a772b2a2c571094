import pytest
from pyspark.sql import functions as F

from folioflow.functions import calculator, geometry
from folioflow.operators import annotations, caches, compare
from folioflow.streaming import changes


@pytest.mark.parametrize(
    ("program", "inputs", "wanted"),
    [
        ("{ add }", [2.0, 3.0], 5.0), ("{ div }", [1.0, 0.0], 0.0), ("{ idiv }", [-7.0, 2.0], -3.0), ("{ mod }", [-7.0, 3.0], -1.0),
        ("{ 3 1 roll exch pop add }", [1.0, 2.0, 4.0], 6.0), ("{ dup 0 lt { neg } if }", [-4.0], 4.0), ("{ atan }", [-1.0, 0.0], 270.0),
        ("{ 90 sin exch pop }", [7.0], 1.0), ("{ pop pop }", [1.0], -100.0), ("{ nonsense }", [1.0], -100.0), ("{ 2 bitshift }", [3.0], 12.0), ("{ round }", [-2.5], -3.0),
    ],
)
def test_calculator(spark, program, inputs, wanted):
    got = calculator.calculator(program, [F.lit(x) for x in inputs], [(-100.0, 100.0)] * len(inputs), [(-100.0, 400.0)])
    assert spark.range(1).select(got[0].alias("x")).first().x == pytest.approx(wanted)


def test_geometry(spark):
    points = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in [(0, 0), (4, 0), (4, 3)]))
    m = F.struct(*(F.lit(float(v)).alias(k) for k, v in zip("abcdef", (2, 0, 0, 2, 5, 6), strict=True)))
    row = spark.range(1).select(
        geometry.shoelace(points).alias("area"), geometry.path_length(points).alias("length"), geometry.matrix_apply(geometry.matrix_product(m, geometry.matrix_inverse(m)), F.lit(3.0), F.lit(4.0)).alias("same"),
        geometry.ink_hit(F.array(points), F.lit(2.0), F.lit(2.0), F.lit(4.5)).alias("near"), geometry.ink_hit(F.array(points), F.lit(2.0), F.lit(-9.0), F.lit(0.0)).alias("far"),
    ).first()
    assert (row.area, row.length, row.same.x, row.same.y, row.near, row.far) == (6.0, 7.0, 3.0, 4.0, True, False)


def test_moves_are_changes_and_nameless_edits_are_two(spark):
    a = spark.createDataFrame([("n1", 0, "x"), (None, 0, "old"), ("n2", 1, "y")], "name string, page int, body string")
    b = spark.createDataFrame([("n1", 3, "x"), (None, 0, "new"), ("n2", 1, "y")], "name string, page int, body string")
    kinds = sorted(r.kind for r in compare.revision_diff(a, b, "name", ["page", "body"]).collect())
    assert kinds == ["created", "modified", "removed"]


def test_forms(spark):
    fields = spark.createDataFrame(
        [("a", "text", 0, "old", []), ("b", "check_box", 0, "Off", [("Yes", "Yes")]), ("c", "combo", 0, None, [("1", "One")]), ("d", "combo", 1 << 18, None, [("1", "One")]), ("e", "radio", 0, "Off", [("r", "r")])],
        "name string, type string, flags int, value string, options array<struct<export:string,display:string>>",
    )
    values = spark.createDataFrame([("a", "new"), ("b", "Yes"), ("c", "One"), ("d", "free"), ("e", "none")], "name string, value string")
    got = {r.name: (r.value, r.refused) for r in annotations.filled(fields, values, ["name"]).collect()}
    assert got == {"a": ("new", False), "b": ("Yes", False), "c": ("1", False), "d": ("free", False), "e": ("Off", True)}


def test_hidden_content(spark):
    names = ["BDC", "Tj", "BMC", "Tj", "EMC", "EMC", "Tj"]
    ops = spark.createDataFrame([(1, i, n, True if i == 0 else None) for i, n in enumerate(names)], "page int, op_index int, operator string, hides boolean")
    assert [r.op_index for r in annotations.visible_operations(ops, ["page"]).collect()] == [6]


def test_undo_log(spark):
    events = spark.createDataFrame([(1, i, op) for i, op in enumerate(["edit", "edit", "undo", "edit", "redo", "undo"])], "doc int, seq int, op string")
    row = annotations.undo_log(events, ["doc"], "seq").first()
    assert (row.cursor, row.revisions) == (1, 2)


def test_lru_replay(spark):
    trace = spark.createDataFrame([("s", 0, "write", "a", 40), ("s", 1, "write", "b", 40), ("s", 2, "read", "a", 0), ("s", 3, "write", "c", 40), ("s", 4, "write", "d", 500)], "scope string, seq int, op string, key string, bytes long")
    assert [r.key for r in caches.lru_replay(trace, "scope", 100).orderBy("age_rank").collect()] == ["a", "c"]


def test_benchmark_totals_need_every_tool(spark):
    rows = [("x", "f", 4, 40.0, None), ("y", "f", 2, 10.0, None), ("x", "g", 1, 5.0, None), ("y", "g", 1, 5.0, "failed"), ("x", "h", 1, 1.0, None)]
    df = spark.createDataFrame(rows, "tool string, file string, pages_rendered int, render_ms double, error string")
    assert {r.tool: (r.pages, r.ms) for r in caches.common_totals(df, ["x", "y"]).collect()} == {"x": (2, 20.0), "y": (2, 10.0)}


def test_streamed_changes_have_no_echo(spark, tmp_path):
    schema = "doc_id long, name string, kind string, origin string, seq long, snapshot string"
    rows = [(1, "n", "created", "them", 1, "a"), (1, "n", "modified", "us", 2, "b"), (1, "n", "modified", "them", 3, "c"), (1, "n", "removed", "them", 4, None), (1, None, "created", "them", 5, "x"), (1, "m", "removed", "them", 6, None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
    query = changes.applied_stream(feed, "us").writeStream.format("memory").queryName("applied_changes").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    query.stop()
    got = [(r.action, r.seq) for r in spark.table("applied_changes").orderBy("seq").collect()]
    assert got == [("insert", 1), ("update", 3), ("delete", 4)]
