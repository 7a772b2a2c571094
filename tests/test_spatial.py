"""Spatial joins against brute force: touching, empty, huge and far boxes, nulls, NaNs, copies, keys; nearest items with ties and tolerance."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.functions.geometry import box
from folioflow.operators import annotations, editing, layout, spatial

RECT = "struct<left: double, bottom: double, right: double, top: double>"
NAN, INF = float("nan"), float("inf")


def made(rng, n):
    out = []
    for i in range(n):
        x, y = rng.choice([rng.uniform(-50, 50), float(rng.randrange(-50, 50)), rng.uniform(-3000, 3000)]), rng.choice([rng.uniform(-50, 50), float(rng.randrange(-50, 50))])
        w, h = rng.choice([0.0, 1.0, 7.5, 60.0, 900.0, 40_000.0]), rng.choice([0.0, 2.0, 3.0, 400.0])
        out.append((i, i % 2, (x, y, x + w, y + h)))
    return out + [(n, 0, None), (n + 1, 0, (NAN, 0.0, 1.0, 1.0)), (n + 2, 0, (5.0, 0.0, 1.0, 1.0)), (n + 3, None, (0.0, 0.0, 1.0, 1.0)), (n + 4, 0, (-INF, -INF, INF, INF)), (n + 5, 1, (1e300, 0.0, 1e301, 1e301)), (n + 6, 0, (0.0, 0.0, 0.0, 0.0)), (n + 7, 0, (0.0, 0.0, 0.0, 0.0))]


def fine(r):
    return r is not None and not any(v != v for v in r) and r[0] <= r[2] and r[1] <= r[3]


@pytest.mark.parametrize("grid", [None, spatial.Grid(5.0, 5.0, 0), spatial.Grid(3.0, 0.5, 14)])
def test_overlapping_boxes(spark, grid):
    rng = random.Random(3)
    left, right = made(rng, 150), made(rng, 120)
    if grid is not None and grid.top == 0:  # a grid of one level is for small boxes
        left, right = ([r for r in rows if not fine(r[2]) or max(r[2][2] - r[2][0], r[2][3] - r[2][1]) < 100] for rows in (left, right))
    a, b = spark.createDataFrame(left, f"i int, page int, rect {RECT}"), spark.createDataFrame(right, f"j int, page int, other {RECT}")
    found = spatial.overlapping(a, b, ["page"], F.col("rect"), F.col("other"), grid or spatial.fitted_grid(a))
    assert found.columns == ["i", "page", "rect", "j", "other"]
    got = sorted((r.i, r.j) for r in found.collect())
    assert got == sorted((i, j) for i, p, r in left for j, q, s in right if p == q and p is not None and fine(r) and fine(s) and r[0] <= s[2] and s[0] <= r[2] and r[1] <= s[3] and s[1] <= r[3])


@pytest.mark.parametrize("tolerance", [INF, 30.0])
def test_nearest_items(spark, tolerance):
    rng = random.Random(4)
    items = [(i, i % 3, (x := rng.choice([rng.gauss(0, 5), rng.uniform(-900, 900)]), y := rng.uniform(-90, 90), x + rng.choice([0, 2, 300]), y + 1.0)) for i in range(400)]
    items += [(400 + i, *items[i][1:]) for i in range(0, 50, 7)] + [(900, 1, None)]
    points = [(i % 4, rng.uniform(-1500, 1500) if i % 9 else 1e7, rng.uniform(-200, 200)) for i in range(120)] + [(None, 0.0, 0.0), (0, None, 1.0)]
    runs = spark.createDataFrame(items, f"run_index int, page int, bounds {RECT}")
    asked = spark.createDataFrame([*points, points[0]], "page int, x double, y double")
    got = {tuple(r)[:3]: r.run for r in layout.nearest_run(runs, asked, ["page"], tolerance).collect()}

    def near(page, x, y):
        if x is None:
            return -1
        some = [(max(b[0] - x, 0, x - b[2]) ** 2 + max(b[1] - y, 0, y - b[3]) ** 2, i) for i, p, b in items if p == page and b]
        return min(some)[1] if some and min(some)[0] <= tolerance**2 else -1

    assert got == {p: near(*p) for p in set(points)}


def test_one_page_pairs_grow_with_the_hits(spark):
    n = 3000
    rows = spark.range(n).select(F.lit(1).alias("page"), F.col("id").alias("slot"), box(F.col("id") % 60 * 10.0, F.floor(F.col("id") / 60) * 12.0, F.col("id") % 60 * 10.0 + 9, F.floor(F.col("id") / 60) * 12.0 + 9).alias("rect"))
    points = rows.select("page", (F.col("rect.left") + 4).alias("x"), (F.col("rect.bottom") + 4).alias("y"))
    found = editing.elements_at(rows, points, ["page"], "slot")
    assert found.count() == n and found.filter("depth <> 1").count() == 0
    plan = spatial.at_points(points, rows, ["page"])._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in plan.splitlines() if "Join" in line)
    assert "_x" in join and "_y" in join and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables(spark):
    boxes = spark.createDataFrame([], f"page int, slot int, item int, flags int, rect {RECT}")
    points = spark.createDataFrame([(1, 0.0, 0.0)], "page int, x double, y double")
    assert spatial.at_points(points, boxes, ["page"]).count() == 0
    assert annotations.topmost_at(boxes, points, ["page"]).collect()[0].slot is None
    assert layout.nearest_run(boxes.selectExpr("page", "slot AS run_index", "rect AS bounds"), points, ["page"]).collect()[0].run == -1
    assert annotations.redacted(boxes, boxes, ["page"]).count() == 0 and editing.figures(boxes.withColumn("stream", F.lit("s")), ["page"], "slot").count() == 0
    assert editing.image_places(boxes.withColumnRenamed("slot", "image_index"), boxes.withColumnRenamed("slot", "block_index"), ["page"]).count() == 0


def test_figures_settle_in_chains(spark):
    # each covers the one before it by over 0.9 and the one before that by less
    made = [(1, i, "s", (3.0 * i, 0.0, 3.0 * i + 40, 40.0)) for i in range(9)] + [(2, 0, "s", (0.0, 0.0, 40.0, 40.0)), (2, 1, "t", (0.0, 0.0, 40.0, 40.0)), (2, 2, "s", (0.0, 0.0, 23.0, 40.0))]
    kept = editing.figures(spark.createDataFrame(made, f"page int, image_index int, stream string, rect {RECT}"), ["page"]).collect()
    assert sorted((r.page, r.image_index) for r in kept) == [(1, 0), (1, 2), (1, 4), (1, 6), (1, 8), (2, 0), (2, 1)]


def test_small_pages_meet_without_cells(spark):
    # joined whole: a page's items are not spread over cells, and rows move once
    rows = spark.range(4000).select((F.col("id") / 4).cast("long").alias("page"), F.col("id").cast("int").alias("slot"), box(F.col("id") % 7 * 1.0, F.lit(0.0), F.col("id") % 7 + 2.0, F.lit(5.0)).alias("rect"))
    points = rows.select("page").distinct().select("page", F.lit(3.0).alias("x"), F.lit(2.0).alias("y"))
    marks = rows.filter("slot % 4 = 0").select("page", "rect")
    for found in (
        layout.nearest_run(rows.selectExpr("page", "slot AS run_index", "rect AS bounds"), points, ["page"]),
        editing.image_places(rows.filter("slot % 2 = 0"), rows.filter("slot % 2 = 1"), ["page"], "slot", "slot"),
        annotations.redacted(rows.withColumn("item", F.col("slot")), marks, ["page"]),
    ):
        assert "_cell" not in found._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("few", [0, 256])
def test_small_and_large_pages_together(spark, monkeypatch, few):
    """Pages above and below the limit, one without items and null keys give the same as brute force."""
    monkeypatch.setattr(spatial, "FEW", few)
    rng = random.Random(9)
    items = [(p, i, (x := rng.uniform(0, 40), y := rng.uniform(0, 40), x + rng.choice([1, 9]), y + 2.0)) for i, p in enumerate([1] * 300 + [2] * 20 + [None] * 3)]
    marks = [(rng.choice([1, 2, 3]), (x := rng.uniform(0, 40), y := rng.uniform(0, 40), x + 1, y + 1.0)) for _ in range(40)]
    rows = spark.createDataFrame(items, f"page int, item int, rect {RECT}")
    told = annotations.redacted(rows, spark.createDataFrame(marks, f"page int, rect {RECT}"), ["page"]).collect()
    meet = lambda a, b: a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]
    assert sorted(r.item for r in told) == [i for p, i, r in items if not any(p == q and meet(r, m) for q, m in marks)]
    pictures = spark.createDataFrame([(p, n, m) for n, (p, m) in enumerate(marks)], f"page int, image_index int, rect {RECT}")
    places = {r.image_index: r.order_key for r in editing.image_places(pictures, rows.withColumnRenamed("item", "block_index"), ["page"]).collect()}

    def place(page, m):
        on = [(i, r) for p, i, r in items if p == page]
        above = [(r[1] - m[3], i) for i, r in on if min(m[2], r[2]) - max(m[0], r[0]) > 0.1 * min(m[2] - m[0], r[2] - r[0]) and r[1] >= m[3]]
        return (min(above)[1] if above else max([i for i, r in on if r[3] >= (m[1] + m[3]) / 2], default=-1)) + 0.5

    assert places == {n: place(p, m) for n, (p, m) in enumerate(marks)}
    asked = [(p, m[0], m[1]) for p, m in marks]
    near = {tuple(r)[:3]: r.run for r in layout.nearest_run(rows.selectExpr("page", "item AS run_index", "rect AS bounds"), spark.createDataFrame(asked, "page int, x double, y double"), ["page"]).collect()}
    assert near == {(p, x, y): min([(max(r[0] - x, 0, x - r[2]) ** 2 + max(r[1] - y, 0, y - r[3]) ** 2, i) for q, i, r in items if q == p], default=(0, -1))[1] for p, x, y in asked}


def test_a_place_is_computed_once_for_all_its_points(spark):
    boxes = spark.range(50).select(F.lit(1).alias("page"), F.col("id").cast("int").alias("slot"), F.lit(0).alias("flags"), box(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("rect"))
    points = spark.range(300).select(F.lit(1).alias("page"), F.col("id").alias("spot"), (F.col("id") % 3).cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert spatial.at_places(points, boxes, ["page"]).count() == 150
    hits = editing.elements_at(boxes, points.union(points.filter("spot = 7")), ["page"], "slot")
    assert hits.count() == 301 * 50 and hits.filter("spot <> 7 AND depth <> 50 - slot").count() == 0
    assert sorted(r.depth for r in hits.filter("spot = 7").collect()) == list(range(1, 101))
    assert {r.slot for r in annotations.topmost_at(boxes, points, ["page"]).collect()} == {49}
    areas = points.filter("spot < 3").select("page", "spot", box(F.lit(0.0), F.lit(0.0), F.lit(5.0), F.lit(5.0)).alias("area"))
    runs = boxes.filter("slot < 2").select("page", F.col("slot").alias("run_index"), F.col("slot").cast("string").alias("text"), F.col("rect").alias("bounds"))
    told = layout.texts_in_boxes(runs, areas.union(areas.filter("spot = 1")), ["page"]).collect()
    assert {r.spot: r.text for r in told} == {0: "0 1", 1: "0 0 1 1", 2: "0 1"}


def test_hits_of_many_points_at_one_place_take_little_disk(spark, tmp_path):
    x = F.col("id") % 2 * 20.0
    boxes = spark.range(24_000).select(F.lit(1).alias("page"), (F.xxhash64("id") % 1_000_000_000).cast("int").alias("slot"), box(x, F.lit(0.0), x + 9, F.lit(9.0)).alias("rect"))
    points = spark.range(100).select(F.lit(1).alias("page"), F.col("id").alias("spot"), (x + 1).alias("x"), F.lit(1.0).alias("y"))
    editing.elements_at(boxes, points, ["page"], "slot").select("spot", "slot", "depth").write.parquet(f"{tmp_path}/hits")
    assert spark.read.parquet(f"{tmp_path}/hits").count() == 1_200_000
    assert sum(f.stat().st_size for f in tmp_path.glob("hits/*.parquet")) < 1_500_000  # 8 MB where each point goes through all elements


def test_rows_numbered_by_ranges(spark):
    made = [(k, i) for i, k in enumerate([5, None, 25_000, -3, 5, 90_001, None, -20_000])]
    found = editing.numbered(spark.createDataFrame(made, "k long, i int"), ["k", "i"], "n")
    order = sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.i) for r in found.orderBy("n").collect()] == order and sorted(r.n for r in found.collect()) == list(range(8))
    assert "Window" not in found.select("i")._jdf.queryExecution().optimizedPlan().toString()
