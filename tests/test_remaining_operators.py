from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.operators import annotations, layout, pages, recognition
from folioflow.streaming import changes

BOX = "struct<left:double,bottom:double,right:double,top:double>"


def test_text_in_boxes_and_nearest_runs(spark):
    runs = spark.createDataFrame([(1, 0, "a", (0.0, 0.0, 10.0, 10.0)), (1, 1, "b", (20.0, 0.0, 30.0, 10.0))], f"page int, run_index int, text string, bounds {BOX}")
    area = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(26.0), F.lit(20.0))
    assert [r.text for r in layout.text_in_box(runs, ["page"], area).collect()] == ["a b"]
    points = spark.createDataFrame([(1, 14.0, 5.0), (1, 16.0, 5.0), (1, 500.0, 5.0)], "page int, x double, y double")
    assert {r.x: r.run for r in layout.nearest_run(runs, points, ["page"], tolerance=50).collect()} == {14.0: 0, 16.0: 1, 500.0: -1}


def test_page_text(spark):
    m = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"
    rows = [(1, 0, "Hello,", 3.0, (10.0, 0.0, 0.0, 10.0, 0.0, 100.0)), (1, 1, "world", 2.0, (10.0, 0.0, 0.0, 10.0, 33.0, 100.0)), (1, 2, "!", 1.0, (10.0, 0.0, 0.0, 10.0, 53.0, 100.0)), (1, 3, "next", 1.0, (10.0, 0.0, 0.0, 10.0, 0.0, 80.0))]
    runs = spark.createDataFrame(rows, f"page int, run_index int, text string, width double, matrix {m}")
    assert layout.joined_pages(runs, ["page"]).first().text == "Hello, world!\nnext"
    assert [r.start_index for r in layout.page_text(runs, ["page"]).orderBy("run_index").collect()] == [0, 7, 12, 14]


def test_annotation_tables(spark):
    rows = [(1, 0, "n", "Ink", (0.0, 0.0, 10.0, 10.0), 0), (1, 1, None, "Highlight", (5.0, 5.0, 20.0, 20.0), 0), (1, 2, "n", "Popup", (0.0, 0.0, 30.0, 30.0), annotations.HIDDEN), (1, 3, None, "Link", (8.0, 8.0, 9.0, 9.0), annotations.LOCKED)]
    items = spark.createDataFrame(rows, f"page int, slot int, name string, subtype string, rect {BOX}, flags int")
    area = geometry.box(F.lit(8.0), F.lit(8.0), F.lit(9.0), F.lit(9.0))
    assert sorted(r.slot for r in annotations.in_rubber_band(items, area).collect()) == [0, 1]
    points = spark.createDataFrame([(1, 7.0, 7.0), (1, 25.0, 25.0)], "page int, x double, y double")
    assert {r.x: r.slot for r in annotations.topmost_at(items, points, ["page"]).collect()} == {7.0: 1, 25.0: None}
    assert [(r.name, r.slot) for r in annotations.first_by_name(items, "name", "page", "slot").collect()] == [("n", 0)]
    named = {r.slot: r.name for r in annotations.with_names(items, "page", "slot").collect()}
    assert named[0] == "n" and named[1].startswith("n-") and named[3] is None
    marks = spark.createDataFrame([(1, (0.0, 0.0, 4.0, 4.0))], f"page int, rect {BOX}")
    assert sorted(r.item for r in annotations.redacted(items.withColumnRenamed("slot", "item"), marks, ["page"]).collect()) == [1, 3]


def test_inverse_and_widgets(spark):
    feed = spark.createDataFrame([("created", None, "a"), ("removed", "b", None), ("modified", "c", "d")], "kind string, before string, after string")
    assert [tuple(r) for r in annotations.inverse(feed).collect()] == [("removed", "a", None), ("created", None, "b"), ("modified", "d", "c")]
    widgets = spark.createDataFrame([(1, "w1", 7), (1, "w2", None), (1, "w3", None)], "doc_id int, widget string, page_ref int")
    leaves = spark.createDataFrame([(1, 7, 0), (1, 8, 1)], "doc_id int, page_ref int, page_index int")
    listed = spark.createDataFrame([(1, "w2", 1)], "doc_id int, widget string, page_index int")
    assert {r.widget: r.page_index for r in annotations.widget_pages(widgets, leaves, listed).collect()} == {"w1": 0, "w2": 1, "w3": -1}


def test_visibility_of_groups(spark):
    row = spark.range(1).select(
        annotations.group_visible(F.lit("g"), F.lit(True), F.array(F.lit("g")), F.array(F.lit("g"))).alias("off_wins"),
        annotations.group_visible(F.lit("g"), F.lit(True), F.array(F.lit("g")), F.array().cast("array<string>")).alias("on"),
        annotations.membership_visible(F.array().cast("array<boolean>"), F.lit("AllOff")).alias("empty"),
    ).first()
    assert tuple(row) == (False, True, True)


def test_replies_and_spans(spark):
    reply = '[{"text":"a","score":0.5,"bbox":[0,0,1,1]},{"content":"b","conf":0.9,"type":"Text","polygon":[[1,2],[5,2],[5,9],[1,9]]}]'
    rows = spark.createDataFrame([(reply,)], "r string").select(F.explode(recognition.parsed_reply(F.col("r"))).alias("x")).select("x.*").collect()
    assert [(r.text, r.confidence, r.category, r.bbox) for r in rows] == [("a", 0.5, None, [0, 0, 1, 1]), ("b", 0.9, "Text", [1, 2, 5, 9])]
    spans = spark.createDataFrame([("x", 0.9, (0.0, 0.0, 1.0, 1.0)), (" ", 0.9, (0.0, 0.0, 1.0, 1.0)), ("y", 0.1, (0.0, 0.0, 1.0, 1.0)), ("z", 0.9, (1.0, 0.0, 1.0, 1.0))], f"text string, confidence double, bounds {BOX}")
    assert [r.text for r in recognition.confident_spans(spans, 0.5).collect()] == ["x"]


def test_smoothing_and_ink_on_tables(spark):
    points = [(0.0, 0.0), (6.0, 0.0), (12.0, 6.0)]
    ink = spark.createDataFrame([(1, points, None)], "id int, points array<struct<x:double,y:double>>, pressures array<double>")
    found = ink.select(geometry.smooth_controls(F.col("points")).alias("c")).first().c
    assert [(round(p.first.x, 6), round(p.second.x, 6)) for p in found] == [(1.0, 4.0), (8.0, 11.0)]
    cut = recognition.sliced_ink(ink, ["id"], [(3.0, -5.0), (3.0, 5.0)], 1.0).orderBy("fragment").collect()
    assert [round(r.points[0].x, 6) for r in cut] == [0.0, 4.0]


def test_interleaved_pictures(spark):
    blocks = spark.createDataFrame([(0, 90.0), (1, 50.0)], "item int, top double")
    images = spark.createDataFrame([(0, 70.0)], "after int, top double")
    assert [r.top for r in pages.interleaved(blocks, images, "item", "after", "top").collect()] == [90.0, 70.0, 50.0]


def test_mirrored_feed(spark, tmp_path):
    schema = "name string, kind string, seq long"
    spark.createDataFrame([("a", "created", 1), ("b", "created", 2)], schema).coalesce(1).write.parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "feed"))
    start, state = changes.mirror(feed, str(tmp_path / "state"), ["name"], "seq", str(tmp_path / "checkpoint"))
    for rows in ([], [("a", "removed", 3), ("b", "modified", 1)]):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
        query = start.start()
        query.processAllAvailable()
        query.stop()
    assert [(r.name, r.seq) for r in state(1).collect()] == [("b", 2)]
