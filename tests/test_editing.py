"""Edits, feeds, logs and files: nulls, ties, repeated rows, empty tables and clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry
from folioflow.operators import editing, search, trees
from folioflow.plans.partitioning import spread
from folioflow.sources import pdf
from folioflow.sources.pdf_writer import built, document_bytes, packed, saved, serialised

RECT = "struct<left:double,bottom:double,right:double,top:double>"


def test_tokens_and_matches_of_equal_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, "aa b"), (1, "cccc dd"), (1, "aa b"), (2, None), (3, " \n ")], "id int, text string")
    got = Counter((r.token, r.start, r.end) for r in search.tokens(df).collect())
    assert got == Counter({("aa", 0, 2): 2, ("b", 3, 4): 2, ("cccc", 0, 4): 1, ("dd", 5, 7): 1})
    assert search.tokens(df.select("text")).count() == 6
    totals = {r.text: tuple(r.t) for r in df.select("text", search.token_totals(F.col("text")).alias("t")).filter("text is not null").collect()}
    assert totals == {"aa b": (2, 3, 2), "cccc dd": (2, 6, 4), " \n ": (0, 0, None)}


def test_other_spaces_separate(spark):
    df = spark.createDataFrame([("a b　c d e",)], "text string")
    assert [r.token for r in search.tokens(df).orderBy("token_index").collect()] == list("abcde")
    assert df.select(search.token_totals(F.col("text"))["n"]).first()[0] == 5


def test_places_where_lower_case_is_longer(spark):
    df = spark.createDataFrame([("İİ xment",)], "text string")
    assert [(r.start, r.end) for r in search.find_literal(df, "MENT").collect()] == [(4, 8)]
    assert df.select(search.count_whole_words(F.lit("The other, the_x the"), "the")).first()[0] == 2
    with pytest.raises(ValueError, match="empty"):
        search.count_regex(F.lit("a"), "x*")


def test_trees_that_are_too_deep_raise(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(8)], "node int, parent int, name string")
    assert trees.walk(chain, "node", "parent", "name", []).count() == 8
    with pytest.raises(ValueError, match="levels"):
        trees.walk(chain, "node", "parent", "name", [], most=4)
    chain.createOrReplaceTempView("deep_chain")
    with pytest.raises(Exception, match="levels"):
        spark.sql(trees.walk_sql("deep_chain", "node", "parent", "name", [], most=4)).collect()


def test_metadata_and_removals(spark):
    marks = spark.createDataFrame([(1, 0, "Widget", "a", None, None, None), (1, 1, "Note", "b", "me", "n", 4), (1, 2, "Note", None, None, None, None)], "doc int, slot int, subtype string, contents string, author string, name string, flags int")
    edits = spark.createDataFrame([(1, 0, 1, None, "x", None, None), (1, 1, 1, "", "", None, 64), (1, 1, 2, None, "you", None, None), (9, 9, 1, "z", None, None, None)], "doc int, slot int, seq int, contents string, author string, name string, flags int")
    got = {r.slot: (r.contents, r.author, r.name, r.flags, r.refused) for r in editing.with_metadata(marks, edits, ["doc", "slot"]).collect()}
    assert got == {0: ("a", None, None, None, True), 1: (None, "you", "n", 64, False), 2: (None, None, None, None, False)}
    left = editing.removed(marks, marks.filter("slot = 1").union(marks.filter("slot = 1")), ["doc"], "slot")
    assert sorted((r.slot, r.subtype) for r in left.collect()) == [(0, "Widget"), (1, "Note")]
    assert editing.removed(marks.limit(0), marks, ["doc"], "slot").count() == 0


def test_fields_keep_their_names_unique(spark):
    fields = spark.createDataFrame([(1, "a.x"), (1, "a.y")], "doc int, name string")
    new = spark.createDataFrame([(1, "a.x", 1), (1, "b", 2), (1, "b", 3), (1, "", 4), (1, None, 5), (2, "a.x", 6)], "doc int, name string, seq int")
    got = Counter((r.doc, r.name, r.state) for r in editing.added_fields(fields, new, "doc").collect())
    assert got == Counter([(1, "a.x", "old"), (1, "a.y", "old"), (1, "a.x", "refused"), (1, "b", "added"), (1, "b", "refused"), (1, "", "refused"), (1, None, "refused"), (2, "a.x", "added")])
    renames = spark.createDataFrame([(1, "a.x", "y"), (1, "a.y", "z")], "doc int, name string, new_part string")
    assert sorted(r.name for r in editing.renamed_fields(fields, renames, "doc").collect()) == ["a.x", "a.z"]


def test_change_feed(spark):
    states = spark.createDataFrame([("d", "a", 0, "1"), ("d", "a", 1, "1"), ("d", "a", 2, "2"), ("d", "b", 0, None), ("d", "b", 2, None), ("d", "c", 2, "x")], "doc string, name string, rev long, snap string")
    got = Counter(tuple(r) for r in editing.change_feed(states, ["doc", "name"], "rev", "snap").select("name", "rev", "kind", "snap").collect())
    assert got == Counter([("a", 0, "created", "1"), ("a", 2, "modified", "2"), ("b", 0, "created", None), ("b", 1, "removed", None), ("b", 2, "created", None), ("c", 2, "created", "x")])


def test_queue_and_logs(spark):
    asked = spark.createDataFrame([(1, 5, 0, 1), (1, 6, 0, 2), (1, 5, 0, 4), (1, 7, -1, 5)], "worker int, page int, priority int, seq int")
    cancels = spark.createDataFrame([(1, 5, 0, 3)], "worker int, page int, priority int, seq int")
    assert [(r.page, r.seq) for r in editing.served(asked, cancels, "worker").orderBy("place").collect()] == [(7, 5), (6, 2), (5, 4)]
    lines = spark.createDataFrame([("flutter: [perf 120] interpret page=3 12.5ms",), ("[perf 7] idle",), ("other",), (None,)], "line string")
    got = [(r.at_ms, r.event, r.page, r.took_ms) for r in editing.log_events(lines).orderBy("at_ms").collect()]
    assert got == [(7, "idle", None, None), (120, "interpret", 3, 12.5)]


def test_wrapping_and_widths(spark):
    row = spark.range(1).select(editing.text_width(F.lit("Hi é"), 10.0).alias("w"), editing.wrapped(F.lit("aa bb cc\n\nlongerword x"), 10.0, 30.0).alias("lines"), editing.wrapped(F.lit(""), 10.0, 30.0).alias("none")).first()
    assert row.w == pytest.approx((722 + 222 + 278 + 556) / 100)
    assert row.lines == ["aa bb", "cc", "", "longerword", "x"] and row.none == [""]


def test_geometry_of_edits(spark):
    b = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(20.0))
    turned = editing.turned_box(b, F.lit(90.0))
    points = F.array(F.struct(F.lit(5.0).alias("x"), F.lit(10.0).alias("y")))
    row = spark.range(1).select(turned.alias("t"), editing.fitted(points, b, geometry.box(F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(20.0))).alias("p"), editing.fitted(points, geometry.box(F.lit(5.0), F.lit(0.0), F.lit(5.0), F.lit(1.0)), b)[0]["x"].alias("flat")).first()
    assert [round(v, 6) for v in row.t] == [-5.0, 5.0, 15.0, 15.0] and tuple(row.p[0]) == (10.0, 10.0) and row.flat == 0.0
    empty = spark.createDataFrame([], f"doc int, rect {RECT}, subtype string")
    assert editing.pasted(empty, ["doc"], b, F.lit(1)).count() == 0


def test_figures_are_kept_greedily(spark):
    made = [(1, 0, "s", (0.0, 0.0, 100.0, 100.0)), (1, 1, "s", (4.0, 0.0, 104.0, 100.0)), (1, 2, "s", (9.0, 0.0, 109.0, 100.0)), (1, 3, "t", (0.0, 0.0, 100.0, 100.0)), (1, 4, "s", (0.0, 0.0, 500.0, 10.0))]
    df = spark.createDataFrame(made, f"page int, image_index int, stream string, rect {RECT}")
    # the second covers the first, the third only the second, which is gone; it overlaps the first by 0.91
    assert sorted(r.image_index for r in editing.figures(df, ["page"]).collect()) == [0, 3]


def test_next_rows_go_over_gaps(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b"), (25_000, "c"), (90_001, "d")], "id long, v string")
    assert {r.id: r.next and r.next.v for r in editing.next_rows(df, "id").collect()} == {1: "b", 5: "c", 25_000: "d", 90_001: None}
    assert spread(df.repartition(2)).rdd.getNumPartitions() >= 2


def test_references_and_loops(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (2, None)], "source int, target int")
    roots = spark.createDataFrame([(1,), (1,)], "object int")
    assert sorted(r.object for r in editing.reachable(edges, roots).collect()) == [1, 2, 3]
    with pytest.raises(ValueError, match="deep"):
        editing.reachable(edges, roots, most=1)


@pytest.mark.parametrize("value", [None, True, -3, 2.5, pdf.Name("A b#"), b"(x\\)", b"\x00\xff", "é", "日本", [1, [pdf.Ref(4, 0)]], {"K": pdf.Name("V")}])
def test_objects_are_written_as_they_are_read(value):
    read = pdf.Reader(serialised(value)).object()
    assert read == (value if not isinstance(value, str) or isinstance(value, pdf.Name) else value.encode("latin-1") if value == "é" else b"\xfe\xff" + value.encode("utf-16-be"))


@pytest.mark.parametrize("way", ["plain", "compact", "saved twice", "damaged", "unicode font"])
def test_files_in_every_way(way):
    row = pdf.parse_file("x", document_bytes(["one (1)", "two", ""], way, "title", [(1, [1.0, 2.0, 3.0, 4.0], "note")], [("a.b", "v"), ("a.c", "w")]))
    assert row["_corrupt"] is None and row["recovered"] is (way == "damaged")
    assert ["".join(r["text"] for r in p["runs"]) for p in row["pages"]] == ["one (1)", "two", ""]
    assert dict(row["info"])["Title"] == ("title!" if way == "saved twice" else "title")
    assert [(a["subtype"], a["contents"]) for a in row["pages"][1]["annotations"]] == [("Text", "note")]
    assert [(f["name"], f["value"], f["kind"]) for f in row["fields"]] == [("a.b", "v", "Tx"), ("a.c", "w", "Tx")]


def test_actions_and_named_destinations():
    n, r = pdf.Name, pdf.Ref
    link = lambda action: {"Type": n("Annot"), "Subtype": n("Link"), "Rect": [3, 4, 1, 2], "A": action}
    objects = {
        1: {"Type": n("Catalog"), "Pages": r(2, 0), "Names": {"Dests": {"Kids": [r(8, 0), r(9, 0)]}}, "Dests": {"old": [r(4, 0), n("Fit")]}},
        2: {"Type": n("Pages"), "Kids": [r(3, 0), r(4, 0)], "Count": 2},
        3: {"Type": n("Page"), "Parent": r(2, 0), "Annots": [link({"S": n("URI"), "URI": b"http://a"}), link({"S": n("GoTo"), "D": b"m"}), link({"S": n("GoTo"), "D": n("old")}), link({"S": n("Named"), "N": n("NextPage")}), link({"S": n("JavaScript"), "JS": r(10, 0)}), {"Subtype": n("Link"), "Dest": [r(3, 0)]}, r(99, 0)]},
        4: {"Type": n("Page"), "Parent": r(2, 0), "Annots": [{"Subtype": n("Line"), "L": [0, 1, 2, 3]}, {"Subtype": n("Ink"), "InkList": [[1, 2], [3, 4, 5, 6]]}]},
        8: {"Limits": [b"a", b"c"], "Names": [b"a", [r(3, 0)]]},
        9: {"Limits": [b"l", b"z"], "Names": [b"m", {"D": [r(4, 0), n("Fit")]}]},
        10: packed(b"run()"),
    }
    row = pdf.parse_file("x", built(objects, 1))
    first, second = (p["annotations"] for p in row["pages"])
    assert [(a["action"], a["target"]) for a in first] == [("URI", "http://a"), ("GoTo", "1"), ("GoTo", "1"), ("Named", "NextPage"), ("JavaScript", "run()"), ("GoTo", "0")]
    assert first[0]["rect"] == {"left": 1.0, "bottom": 2.0, "right": 3.0, "top": 4.0}
    assert second[0]["coordinates"] == [0.0, 1.0, 2.0, 3.0] and second[1]["ink"] == [[1.0, 2.0], [3.0, 4.0, 5.0, 6.0]]


def test_a_saved_file_keeps_its_first_bytes():
    data = document_bytes(["x"], "plain", "t")
    assert saved(data, {6: {"Title": "u"}}, {"Size": 20, "Root": pdf.Ref(1, 0), "Info": pdf.Ref(6, 0)}, data.rindex(b"xref\n0 1")).startswith(data)
    with pytest.raises(TypeError):
        serialised(object())


def test_null_bytes_are_told_as_unreadable(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray(b"no file"))], "path string, content binary")
    assert all(r._corrupt for r in pdf.parsed(df).collect()) and pdf.read_operations(df).count() == 0
