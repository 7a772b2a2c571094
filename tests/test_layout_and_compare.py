import random

from pyspark.sql import functions as F

from folioflow.operators import compare, layout, pages, recognition, trees


def lcs_by_table(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append(("=", a[i]))
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            out.append(("-", a[i]))
            i += 1
        else:
            out.append(("+", b[j]))
            j += 1
    return out + [("-", x) for x in a[i:]] + [("+", x) for x in b[j:]]


def test_token_differences_agree_with_the_plain_table():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = compare.lcs_segments(a, b)
        want = lcs_by_table(a, b)
        assert [x for k, p, q in got for x in p] == a and [x for k, p, q in got for x in q] == b
        assert sum(len(p) for k, p, _ in got if k == "equal") == sum(k == "=" for k, _ in want)
        for kind, sign in (("deleted", "-"), ("inserted", "+")):
            assert [x for k, p, q in got if k == kind for x in (p or q)] == [x for k, x in want if k == sign]


def test_one_hunk(spark):
    df = spark.createDataFrame([(1, "the quick brown fox", "the quick red fox"), (2, "a b", "a b"), (3, None, "new")], "pair int, before string, after string")
    rows = compare.hunks(compare.token_diff(df, "pair"), "pair").orderBy("pair").collect()
    assert [(r.pair, r.kind, r.label) for r in rows] == [(1, "replacement", "brown → red"), (3, "insertion", "new")]


def runs(*items):
    return [{"text": t, "left": x, "bottom": y - 3.0, "right": x + w, "top": y + 9.0, "size": 12.0} for t, x, y, w in items]


def test_columns_come_before_stream_order():
    left = [(f"left {i}", 50.0, 700.0 - 14 * i, 150.0) for i in range(3)]
    right = [(f"right {i}", 320.0, 700.0 - 14 * i, 150.0) for i in range(3)]
    mixed = [x for pair in zip(left, right, strict=True) for x in pair]
    order = [x["text"] for x in layout.reading_order(layout.visual_lines(runs(*mixed)))]
    assert order == [x[0] for x in left] + [x[0] for x in right]


def test_paragraphs_and_lists():
    lines = layout.visual_lines(runs(("para-", 50.0, 700.0, 100.0), ("graph text", 50.0, 686.0, 100.0), ("• item", 50.0, 672.0, 80.0), ("far below", 50.0, 600.0, 80.0)))
    blocks = layout.paragraphs(layout.reading_order(lines))
    assert [b["text"] for b in blocks] == ["paragraph text", "• item", "far below"]
    assert [b["is_list_item"] for b in blocks] == [False, True, False]


def test_reflow_runs_on_groups(spark):
    rows = [(1, *r.values()) for r in runs(("one", 50.0, 700.0, 30.0), ("two", 90.0, 700.0, 30.0))]
    df = spark.createDataFrame(rows, "page int, text string, left double, bottom double, right double, top double, size double")
    assert [r.text for r in layout.reflow(df, ["page"]).collect()] == ["one two"]


def test_pixels_and_regions(spark):
    white, black = F.array(*[F.lit(255)] * 3), F.array(*[F.lit(0)] * 3)
    row = spark.range(1).select(compare.pixel_class(black, white).alias("a"), compare.pixel_class(white, black).alias("b"), compare.pixel_class(white, white).alias("c")).first()
    assert (row.a, row.b, row.c) == ("removed", "added", None)
    df = spark.createDataFrame([(1, 100, 50, 0, 0), (1, 100, 50, 25, 0), (1, 100, 50, 99, 49)], "p int, w int, h int, x int, y int")
    found = compare.changed_regions(df, ["p"], "w", "h").orderBy("region_index").collect()
    assert [(r.top, r.left, r.bottom, r.right) for r in found] == [(0, 0, 24, 48), (48, 96, 50, 100)]


def test_recognition(spark):
    steps = spark.createDataFrame([(1, i, [float(v == k) for v in range(4)]) for i, k in enumerate([1, 1, 0, 1, 2, 3])] + [(2, 0, [1.0, 0.0, 0.0, 0.0])], "line int, step int, scores array<double>")
    words = F.array(F.lit("a"), F.lit("b"))
    rows = recognition.ctc_decode(steps, ["line"], words).orderBy("line").collect()
    assert [(r.text, r.confidence) for r in rows] == [("aab", 1.0), ("", 1.0)]
    grid = [0.0] * 400
    for y, x in [(y, x) for y in range(2, 6) for x in range(2, 8)] + [(y, x) for y in range(12, 16) for x in range(10, 18)] + [(19, 19)]:
        grid[y * 20 + x] = 0.9
    maps = spark.createDataFrame([(1, 20, 20, grid)], "id int, width int, height int, probs array<double>")
    boxes = recognition.text_boxes(maps, ["id"]).collect()
    assert len(boxes) == 2 and boxes[0].top < boxes[1].top and boxes[0].left == 5 - 3 * 1.6


def test_ink_is_cut_and_pressure_interpolated():
    parts = recognition.slice_stroke([(0.0, 0.0), (10.0, 0.0)], [0.0, 1.0], [(5.0, -5.0), (5.0, 5.0)], 1.0)
    assert [(round(p[0][0], 6), round(p[-1][0], 6)) for p, _ in parts] == [(0.0, 4.0), (6.0, 10.0)]
    assert round(parts[0][1][-1], 6) == 0.4
    assert recognition.slice_stroke([(0.0, 0.0), (1.0, 0.0)], None, [(0.0, 0.0), (1.0, 0.0)], 2.0) == []


def test_pages_and_chains(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate("abc")], "doc int, page int, t string")
    assert [r.t for r in pages.extract_pages(df, ["doc"], "page", [2, 0, 2]).orderBy("page").collect()] == ["c", "a", "c"]
    assert pages.remove_pages(df, ["doc"], "page", F.lit(True)).count() == 3
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 5)], "a int, b int")
    ends = {r.a: (r.end, r.steps) for r in trees.resolve_chain(links, "a", "b").collect()}
    assert ends == {1: (3, 2), 2: (3, 1), 5: (None, None), 6: (None, None)}
    nodes = spark.createDataFrame([(1, None, "root", "A"), (2, 1, "kid", None), (3, 2, None, "B")], "id int, up int, name string, box string")
    found = {r.node: (r.path_name, r.box) for r in trees.walk(nodes, "id", "up", "name", ["box"]).collect()}
    assert found == {1: ("root", "A"), 2: ("root.kid", "A"), 3: ("root.kid", "B")}


def test_token_differences_are_told_a_few_pairs_at_a_time():
    from unittest.mock import MagicMock

    import pyarrow as pa

    pairs = MagicMock()
    pairs.schema["k"].dataType.simpleString.return_value = "bigint"
    compare.token_diff(pairs, "k")
    run = pairs.select.return_value.mapInArrow.call_args[0][0]
    out = list(run([pa.RecordBatch.from_pydict({"k": list(range(200)), "before": ["a b"] * 200, "after": ["a c"] * 200})]))
    assert max(len(set(b.column(0).to_pylist())) for b in out) <= compare.PAIRS and sum(b.num_rows for b in out) == 600
