"""Registered queries of edits, feeds, logs, geometry and forms over the test tables, and the SQL that each must agree with.

Orders stand for documents and their lines for annotations: a line's slot is its place in the order, and
its box comes from its quantity and its part's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry, measure
from folioflow.operators import annotations, editing, graphics, layout, recognition, regions
from folioflow.plans.folders import shared_folder
from folioflow.queries import query, table
from folioflow.streaming.buckets import Buckets

_LINES = """(SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS slot,
    CAST(l_quantity AS DOUBLE) AS x0, CAST(l_partkey % 50 AS DOUBLE) AS y0, CAST(l_quantity AS DOUBLE) + 10 AS x1, CAST(l_partkey % 50 AS DOUBLE) + 5 AS y1,
    l_partkey AS p, l_suppkey AS s, CASE WHEN l_partkey % 7 = 0 THEN 2 ELSE 0 END AS flags FROM lineitem)"""
_KINDS = ("Widget", "Highlight", "Stamp", "Popup", "Square")
_KIND_SQL = "CASE p % 5 WHEN 0 THEN 'Widget' WHEN 1 THEN 'Highlight' WHEN 2 THEN 'Stamp' WHEN 3 THEN 'Popup' ELSE 'Square' END"


def _lines(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    x, y = F.col("l_quantity").cast("double"), (F.col("l_partkey") % 50).cast("double")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("l_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.row_number().over(w) - 1).alias("slot"),
        geometry.box(x, y, x + 10, y + 5).alias("rect"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        kind.alias("subtype"),
        F.when(F.col("l_partkey") % 7 == 0, F.lit(2)).otherwise(F.lit(0)).alias("flags"),
    )


def _points(spark, sf_dir) -> DataFrame:
    """Each order's points (x, y), in the order of its lines."""
    point = F.struct("slot", F.col("rect.left").alias("x"), F.col("rect.bottom").alias("y"))
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(point)), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"))


def _probe(df: DataFrame) -> DataFrame:
    """A point for each document."""
    return df.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 50 + 3).cast("double").alias("x"), (F.col("doc_id") % 40 + 2).cast("double").alias("y"))


_PROBE = "(SELECT DISTINCT l_orderkey AS doc_id, CAST(l_orderkey % 50 + 3 AS DOUBLE) AS x, CAST(l_orderkey % 40 + 2 AS DOUBLE) AS y FROM lineitem)"


def _sides(b: Column) -> list[Column]:
    return [b[c].alias(c[0] + "_side") for c in ("left", "bottom", "right", "top")]


# selections, hits, filters


@query("""SELECT conv_id, turn, (turn % 2 = 0) <> (turn BETWEEN least(1, conv_id % 4) AND greatest(1, conv_id % 4)) AS selected FROM conversations""")
def toggled_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 2 == 0).alias("selected"))
    return editing.toggled_range(turns, "turn", "selected", F.lit(1), F.col("conv_id") % 4)


@query(f"""WITH w AS (SELECT doc_id, slot, CASE s % 4 WHEN 0 THEN 'Off' WHEN 1 THEN 'Yes' WHEN 2 THEN 'On' END AS state FROM {_LINES}),
    f AS (SELECT doc_id, state, min(slot) AS first FROM w WHERE state <> 'Off' GROUP BY ALL)
    SELECT doc_id, string_agg(state, ',' ORDER BY first) AS states FROM f GROUP BY doc_id""")
def field_states(spark, sf_dir):
    state = F.get(F.array(F.lit("Off"), F.lit("Yes"), F.lit("On"), F.lit(None)), (F.col("s") % 4).cast("int"))
    return editing.on_states(_lines(spark, sf_dir).withColumn("state", state), ["doc_id"], "slot", "state").select("doc_id", F.array_join("states", ",").alias("states"))


@query("""SELECT c_custkey FROM customer WHERE lower(c_name) LIKE '%7%' OR lower(c_mktsegment) LIKE '%7%'""")
def sidebar_rows(spark, sf_dir):
    return editing.sidebar_filter(table(spark, sf_dir, "customer"), " 7 ", "c_name", "c_mktsegment").select("c_custkey")


@query(f"""SELECT doc_id, count(*) FILTER (p % 5 = 2 AND s % 2 = 0) AS check_marks FROM {_LINES} GROUP BY doc_id""")
def check_mark_counts(spark, sf_dir):
    stamp = F.when(F.col("s") % 2 == 0, F.lit("Check")).otherwise(F.lit("Draft"))
    return editing.check_marks(_lines(spark, sf_dir).withColumn("stamp", stamp), ["doc_id"])


@query(f"""SELECT q.doc_id, q.x, q.y, slot, CAST(row_number() OVER (PARTITION BY q.doc_id ORDER BY slot DESC) AS INTEGER) AS depth FROM {_PROBE} AS q JOIN {_LINES} AS e ON q.doc_id = e.doc_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def element_hits(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return editing.elements_at(rows, _probe(rows), ["doc_id"], "slot")


@query(f"""SELECT q.doc_id, q.x, q.y, arg_max(s, slot) AS field, arg_max(slot, slot) AS widget FROM {_PROBE} AS q JOIN {_LINES} AS e
    ON q.doc_id = e.doc_id AND p % 5 = 0 AND flags = 0 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY ALL""")
def fields_at_points(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumns({"field": F.col("s"), "widget": F.col("slot")})
    return editing.field_at(rows, _probe(rows), ["doc_id"], "slot")


@query(f"""SELECT q.doc_id, q.x, q.y, CAST(max(slot) AS INTEGER) AS slot FROM {_PROBE} AS q LEFT JOIN (SELECT * FROM {_LINES} WHERE flags = 0) AS e
    ON q.doc_id = e.doc_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY q.doc_id, q.x, q.y""")
def topmost_annotations(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return annotations.topmost_at(rows, _probe(rows), ["doc_id"])


@query(f"""SELECT doc_id, slot FROM {_LINES} WHERE flags = 0 AND p % 3 <> 0 AND x0 <= 40 AND x1 >= 20 AND y0 <= 30 AND y1 >= 10""")
def rubber_band_hits(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("flags", F.when(F.col("p") % 3 == 0, F.lit(128)).otherwise(F.col("flags")))
    area = geometry.box(F.lit(20.0), F.lit(10.0), F.lit(40.0), F.lit(30.0))
    return annotations.in_rubber_band(rows, area).select("doc_id", "slot")


@query(f"""SELECT doc_id, slot, coalesce(CASE p % 5 WHEN 0 THEN FALSE WHEN 1 THEN s % 2 = 0 WHEN 2 THEN slot > 0 AND s % 3 > 0 WHEN 3 THEN FALSE ELSE slot > 0 AND s % 4 > 0 END, FALSE) AS restyled FROM {_LINES}""")
def restyled_kinds(spark, sf_dir):
    s = F.col("s")
    rows = _lines(spark, sf_dir).withColumns({"has_appearance": F.col("slot") > 0, "is_cloudy": s % 4 == 0, "n_points": F.lit(2), "n_strokes": F.lit(0), "upright_quads": s % 2 == 0, "standard_font": F.lit(True), "contents": F.when(s % 3 > 0, F.lit("x")).otherwise(F.lit(""))})
    return rows.select("doc_id", "slot", editing.can_restyle(rows).alias("restyled"))


# new and changed annotations


@query(f"""SELECT doc_id, min(x0) AS l_side, min(y0) AS b_side, max(x1) AS r_side, max(y1) AS t_side, CAST(8 * count(*) AS INTEGER) AS numbers, sum(2 * (x0 + x1 + y0 + y1)) AS total FROM {_LINES} GROUP BY doc_id""")
def drawn_markups(spark, sf_dir):
    rects = _lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list("rect").alias("rects"))
    found = editing.markups(rects, "Highlight")
    return found.select("doc_id", *_sides(F.col("rect")), F.size("quad_points").alias("numbers"), F.aggregate("quad_points", F.lit(0.0), lambda a, v: a + v).alias("total"))


@query(f"""SELECT doc_id, min(x0) - 2 AS l_side, min(y0) - 2 AS b_side, max(x0) + 2 AS r_side, max(y0) + 2 AS t_side FROM {_LINES} GROUP BY doc_id HAVING count(*) >= 3""")
def drawn_polygons(spark, sf_dir):
    found = editing.shapes(_points(spark, sf_dir).withColumn("stroke_width", F.lit(2.0)), "Polygon")
    return found.select("doc_id", *_sides(F.col("rect")))


@query(f"""SELECT doc_id, least(x0, x1) AS l_side, least(y0, y1) AS b_side, greatest(x0, x1) AS r_side, greatest(y0, y1) AS t_side FROM (
    SELECT doc_id, max(x0) FILTER (slot = 0) AS x0, max(y0) FILTER (slot = 0) AS y0, max(x0) FILTER (slot = 1) AS x1, max(y0) FILTER (slot = 1) AS y1, count(*) AS n FROM {_LINES} GROUP BY doc_id) WHERE n = 2""")
def drawn_circles(spark, sf_dir):
    found = editing.shapes(_points(spark, sf_dir).withColumn("stroke_width", F.lit(2.0)), "Circle")
    return found.select("doc_id", *_sides(F.col("rect")))


@query(f"""WITH n AS (SELECT *, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny, first_value(x0) OVER w AS fx, first_value(y0) OVER w AS fy, count(*) OVER (PARTITION BY doc_id) AS n FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY slot)),
    a AS (SELECT doc_id, max(n) AS n, sum(sqrt((nx - x0) * (nx - x0) + (ny - y0) * (ny - y0))) AS along, abs(sum(x0 * coalesce(ny, fy) - coalesce(nx, fx) * y0)) / 2 AS area, sum(x0) AS sx, sum(x0) FILTER (slot = 0) + sum(x0) FILTER (slot = n - 1) AS ends FROM n GROUP BY doc_id)
    SELECT doc_id, CASE WHEN n = 2 THEN round(along * 0.5, 6) END AS distance, CASE WHEN n >= 2 THEN round(along * 0.5, 6) END AS perimeter, CASE WHEN n >= 3 THEN round(area * 0.25, 6) END AS area,
        CASE WHEN n >= 3 THEN round(sx / n, 6) WHEN n = 2 THEN round(ends / 2, 6) END AS caption_x FROM a""")
def measured_shapes(spark, sf_dir):
    found = editing.measurements(_points(spark, sf_dir), F.lit(0.5))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("distance", "perimeter", "area")), F.round("anchor.x", 6).alias("caption_x"))


@query("""SELECT p_partkey, CASE WHEN p_size > 10 THEN round(p_retailprice / (p_size - 10), 6) END AS scale FROM part""")
def calibrated_scales(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(editing.calibrated(F.col("p_retailprice").cast("double"), (F.col("p_size") - 10).cast("double")), 6).alias("scale"))


@query(f"""WITH a AS (SELECT *, 12.0 * (doc_id % 5) AS d FROM {_LINES} WHERE p % 5 NOT IN (0, 3)),
    g AS (SELECT *, min(x0) OVER w + d AS l, max(x1) OVER w + d AS r, min(y0) OVER w - d AS b, max(y1) OVER w - d AS t FROM a WINDOW w AS (PARTITION BY doc_id)),
    m AS (SELECT *, d + CASE WHEN l < 0 OR r - l > 60 THEN 0 - l WHEN r > 60 THEN 60 - r ELSE 0 END AS dx, -d + CASE WHEN b < 0 OR t - b > 60 THEN 0 - b WHEN t > 60 THEN 60 - t ELSE 0 END AS dy FROM g)
    SELECT doc_id, slot, x0 + dx AS l_side, y0 + dy AS b_side, x1 + dx AS r_side, y1 + dy AS t_side FROM m""")
def pasted_annotations(spark, sf_dir):
    page = geometry.box(F.lit(0.0), F.lit(0.0), F.lit(60.0), F.lit(60.0))
    return editing.pasted(_lines(spark, sf_dir), ["doc_id"], page, F.col("doc_id") % 5).select("doc_id", "slot", *_sides(F.col("rect")))


@query(f"""SELECT doc_id, slot, CASE s % 3 WHEN 0 THEN 'new' WHEN 1 THEN NULL ELSE 'old' END AS contents, CASE WHEN p % 5 = 0 THEN 'me' WHEN s % 2 = 0 THEN 'you' ELSE 'me' END AS author,
    p % 5 = 0 AND s % 2 = 0 AS refused, CAST(CASE WHEN s % 2 = 0 THEN 64 ELSE flags END AS INTEGER) AS flags FROM {_LINES}""")
def annotation_metadata(spark, sf_dir):
    s = F.col("s")
    rows = _lines(spark, sf_dir).withColumns({"contents": F.lit("old"), "author": F.lit("me"), "name": F.lit("n")})
    edit = rows.select("doc_id", "slot", F.lit(1).alias("seq"), F.when(s % 3 == 0, F.lit("new")).when(s % 3 == 1, F.lit("")).alias("contents"), F.when(s % 2 == 0, F.lit("he")).alias("author"), F.lit(None).cast("string").alias("name"), F.when(s % 2 == 0, F.lit(64)).alias("flags"))
    later = edit.select("doc_id", "slot", F.lit(2).alias("seq"), F.lit(None).cast("string").alias("contents"), F.when(F.col("author").isNotNull(), F.lit("you")).alias("author"), "name", F.lit(None).cast("int").alias("flags"))
    return editing.with_metadata(rows, edit.unionByName(later), ["doc_id", "slot"]).select("doc_id", "slot", "contents", "author", "refused", F.col("flags").cast("int").alias("flags"))


@query(f"""SELECT doc_id, p, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY slot) - 1 AS INTEGER) AS slot FROM {_LINES} WHERE p % 4 <> 1""")
def removed_annotations(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    return editing.removed(rows, rows.filter("p % 4 = 1"), ["doc_id"], "slot").select("doc_id", "p", "slot")


@query(f"""SELECT doc_id, name, slot FROM (SELECT *, 'n' || p % 3 AS name FROM {_LINES}) QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY slot) = 1""")
def first_named(spark, sf_dir):
    rows = _lines(spark, sf_dir).select(F.struct("doc_id", F.concat(F.lit("n"), (F.col("p") % 3).cast("string")).alias("name")).alias("key"), "slot")
    return annotations.first_by_name(rows, "key", "slot").select("key.doc_id", "key.name", "slot")


@query(f"""SELECT doc_id, slot, p FROM {_LINES} AS i WHERE NOT EXISTS (SELECT 1 FROM {_PROBE} AS m WHERE m.doc_id = i.doc_id AND x0 <= x + 8 AND x1 >= x AND y0 <= y + 8 AND y1 >= y)""")
def redacted_items(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("item", F.col("slot"))
    marks = _probe(rows).select("doc_id", geometry.box(F.col("x"), F.col("y"), F.col("x") + 8, F.col("y") + 8).alias("rect"))
    return annotations.redacted(rows, marks, ["doc_id"]).select("doc_id", "slot", "p")


@query(f"""SELECT doc_id, slot, 'created' AS kind FROM {_LINES} WHERE s % 3 <> 0""")
def baseline_rows(spark, sf_dir):
    named = _lines(spark, sf_dir).withColumn("name", F.when(F.col("s") % 3 == 1, F.lit("x")).when(F.col("s") % 3 == 2, F.lit("y")).otherwise(F.lit("")))
    return editing.baseline(named).select("doc_id", "slot", "kind")


@query("""WITH r AS (SELECT CAST(range AS BIGINT) AS r FROM range(0, 4)), s AS (SELECT c_nationkey AS doc, c_custkey AS name, r, c_custkey % (r // 2 + 2) AS snap FROM customer, r WHERE (c_custkey + r) % 4 <> 0),
    docs AS (SELECT doc, r FROM (SELECT DISTINCT doc FROM s), r)
    SELECT coalesce(a.doc, b.doc) AS doc, coalesce(a.name, b.name) AS name, coalesce(a.r, b.r + 1) AS r, CASE WHEN b.name IS NULL THEN 'created' WHEN a.name IS NULL THEN 'removed' ELSE 'modified' END AS kind, a.snap
    FROM s AS a FULL JOIN s AS b ON a.doc = b.doc AND a.name = b.name AND a.r = b.r + 1 WHERE (a.name IS NULL AND b.r < 3) OR (a.name IS NOT NULL AND (b.name IS NULL OR a.snap <> b.snap))""")
def feed_of_revisions(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_custkey").alias("name"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("r"))
    states = customer.filter("(name + r) % 4 <> 0").withColumn("snap", F.expr("name % (r div 2 + 2)"))
    return editing.change_feed(states, ["doc", "name"], "r", "snap")


@query(f"""SELECT doc_id, slot, 1 AS version, CAST(p AS BIGINT) AS p FROM {_LINES} WHERE p % 5 NOT IN (0, 3) AND s % 2 = 0""")
def annotation_snapshots(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("name", F.lit("n"))
    taken = editing.snapshots(rows.filter("s % 2 = 0"), ["p", "name", "subtype"], 1).unionByName(editing.snapshots(rows.filter("s % 2 = 1"), ["p", "name", "subtype"], 2))
    read = taken.select("doc_id", "slot", editing.from_snapshot(F.col("snapshot"), "p long, name string, subtype string").alias("s"))
    return read.filter("s is not null and s.name is null").select("doc_id", "slot", "s.version", "s.p")


# fields and forms


@query("""WITH old AS (SELECT c_nationkey AS doc, c_mktsegment AS name FROM customer WHERE c_custkey % 5 = 0 GROUP BY ALL), new AS (SELECT c_nationkey AS doc, c_mktsegment AS name, c_custkey AS seq FROM customer WHERE c_custkey % 5 = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY seq) AS nth FROM new)
    SELECT doc, name, 'old' AS state FROM old UNION ALL SELECT n.doc, n.name, CASE WHEN nth = 1 AND o.name IS NULL THEN 'added' ELSE 'refused' END FROM n LEFT JOIN old AS o ON n.doc = o.doc AND n.name = o.name""")
def added_form_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("seq"))
    return editing.added_fields(rows.filter("seq % 5 = 0").select("doc", "name").distinct(), rows.filter("seq % 5 = 1"), "doc")


@query("""WITH f AS (SELECT c_nationkey AS doc, 'form.' || c_custkey AS name, c_custkey AS k FROM customer), r AS (SELECT doc, name, CASE WHEN k % 3 = 0 THEN CAST(k + 25 AS VARCHAR) WHEN k % 3 = 1 THEN 'same' ELSE 'own' || k END AS part FROM f WHERE k % 2 = 0),
    a AS (SELECT f.*, 'form.' || part AS new FROM f LEFT JOIN r USING (doc, name)), c AS (SELECT *, count(new) OVER (PARTITION BY doc, new) AS rivals FROM a)
    SELECT doc, k, CASE WHEN new IS NOT NULL AND rivals = 1 AND NOT EXISTS (SELECT 1 FROM f WHERE f.doc = c.doc AND f.name = c.new) THEN new ELSE name END AS name FROM c""")
def renamed_form_fields(spark, sf_dir):
    k = F.col("k")
    fields = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc"), F.concat(F.lit("form."), F.col("c_custkey").cast("string")).alias("name"), F.col("c_custkey").alias("k"))
    part = F.when(k % 3 == 0, (k + 25).cast("string")).when(k % 3 == 1, F.lit("same")).otherwise(F.concat(F.lit("own"), k.cast("string")))
    return editing.renamed_fields(fields, fields.filter("k % 2 = 0").select("doc", "name", part.alias("new_part")), "doc")


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN TRUE WHEN p_size % 4 = 0 THEN FALSE WHEN p_size % 4 = 1 THEN p_size % 3 <> 0 WHEN p_size % 4 = 2 THEN p_size % 3 = 2 AND p_size % 2 = 1 ELSE p_size % 3 = 2 END AS refused,
    CASE WHEN p_size % 5 = 0 THEN 'was' WHEN p_size % 4 = 0 THEN v WHEN p_size % 3 = 0 THEN 'e1' WHEN p_size % 3 = 1 THEN CASE WHEN p_size % 4 IN (2, 3) THEN 'e1' ELSE 'was' END ELSE CASE WHEN p_size % 4 = 2 AND p_size % 2 = 0 THEN 'free' ELSE 'was' END END AS value
    FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'e1' WHEN 1 THEN 'shown' ELSE 'free' END AS v FROM part)""")
def filled_fields(spark, sf_dir):
    size = F.col("p_size")
    kind = F.get(F.array(F.lit("text"), F.lit("check_box"), F.lit("combo"), F.lit("list")), (size % 4).cast("int"))
    options = F.array(F.struct(F.lit("e1").alias("export"), F.lit("shown").alias("display")))
    flags = F.when(size % 5 == 0, F.lit(1)).when(size % 2 == 0, F.lit(1 << 18)).otherwise(F.lit(0))
    fields = table(spark, sf_dir, "part").select("p_partkey", "p_size", kind.alias("type"), options.alias("options"), flags.alias("flags"), F.lit("was").alias("value"))
    values = fields.select("p_partkey", F.get(F.array(F.lit("e1"), F.lit("shown"), F.lit("free")), (size % 3).cast("int")).alias("value"))
    return annotations.filled(fields, values, ["p_partkey"]).select("p_partkey", "refused", "value")


@query("""WITH w AS (SELECT o_orderkey AS widget, o_custkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 END AS page_ref FROM orders), l AS (SELECT widget, doc_id, widget % 5 AS page_index FROM w WHERE widget % 4 <> 0)
    SELECT w.widget, w.doc_id, CAST(coalesce(w.page_ref * 10, l.page_index, -1) AS BIGINT) AS page_index FROM w LEFT JOIN l ON w.widget = l.widget AND w.doc_id = l.doc_id""")
def widget_page_numbers(spark, sf_dir):
    widgets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("widget"), F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2).alias("page_ref"))
    pages = widgets.select("doc_id").distinct().withColumn("page_ref", F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>"))).withColumn("page_index", F.col("page_ref") * 10)
    listed = widgets.filter("widget % 4 <> 0").select("doc_id", "widget", (F.col("widget") % 5).alias("page_index"))
    return annotations.widget_pages(widgets, pages, listed).select("widget", "doc_id", F.col("page_index").cast("long").alias("page_index"))


# content


@query(f"""SELECT doc_id, slot FROM {_LINES} AS o WHERE NOT EXISTS (SELECT 1 FROM {_LINES} AS d WHERE d.doc_id = o.doc_id AND d.p % 6 = 0 AND o.slot BETWEEN d.slot AND d.slot + 1)""")
def kept_operations(spark, sf_dir):
    ops = _lines(spark, sf_dir)
    drops = ops.filter("p % 6 = 0").select("doc_id", F.col("slot").alias("first"), (F.col("slot") + 1).alias("last"))
    return editing.without_elements(ops, drops, ["doc_id"], "slot").select("doc_id", "slot")


@query("""SELECT conv_id, turn, CASE WHEN fine THEN replace(text, 'the', 'THE-') ELSE text END AS text, CAST(CASE WHEN fine THEN n ELSE 0 END AS INTEGER) AS replaced FROM
    (SELECT *, len(string_split(text, 'the')) - 1 AS n, len(string_split(text, 'the')) > 1 AND NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]') AS fine FROM conversations)""")
def replaced_words(spark, sf_dir):
    return editing.replaced_text(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "the", "THE-")


@query(f"""WITH b AS (SELECT doc_id, slot, p, 0 AS late FROM {_LINES} UNION ALL SELECT doc_id, slot, -1, 1 FROM {_LINES} WHERE p % 4 = 0)
    SELECT doc_id, p, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY late, slot) - 1 AS INTEGER) AS slot FROM b""")
def stamped_pages(spark, sf_dir):
    ops = _lines(spark, sf_dir).select("doc_id", "slot", "p")
    return editing.stamped(ops, ops.filter("p % 4 = 0").withColumn("p", F.lit(-1).cast(ops.schema["p"].dataType)), ["doc_id"], "slot").select("doc_id", "p", "slot")


@query(f"""WITH o AS (SELECT doc_id, slot, 'op' || slot AS operand, 0 AS late FROM {_LINES} WHERE p % 2 = 0), a AS (SELECT doc_id, slot, 'form' || p AS operand, 1 AS late FROM {_LINES} WHERE p % 5 <> 3 AND s % 2 = 0 AND flags = 0)
    SELECT doc_id, operand, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY late, slot) - 1 AS INTEGER) AS op_index FROM (SELECT * FROM o UNION ALL SELECT * FROM a)""")
def flattened_pages(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    ops = rows.filter("p % 2 = 0").select("doc_id", F.col("slot").alias("op_index"), F.lit("Tj").alias("operator"), F.concat(F.lit("op"), F.col("slot").cast("string")).alias("operand"))
    marks = rows.withColumn("appearance", F.when(F.col("s") % 2 == 0, F.concat(F.lit("form"), F.col("p").cast("string"))))
    return editing.flattened(ops, marks, ["doc_id"])[0].select("doc_id", "operand", "op_index")


@query("""SELECT p_partkey, 'Author=old' || CASE WHEN p_size % 3 = 0 THEN ',Subject=' || p_size ELSE '' END || CASE WHEN p_size % 2 = 0 THEN ',Title=t' || p_size ELSE ',Title=was' END AS info FROM part""")
def document_info(spark, sf_dir):
    size = F.col("p_size")
    old = F.create_map(F.lit("Author"), F.lit("old"), F.lit("Title"), F.lit("was"), F.lit("Subject"), F.lit("gone"))
    new = {"Title": F.when(size % 2 == 0, F.concat(F.lit("t"), size.cast("string"))), "Subject": F.when(size % 3 == 0, size.cast("string")).otherwise(F.lit(""))}
    entries = F.array_sort(F.transform(F.map_entries(editing.with_info(old, new)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ",").alias("info"))


@query(f"""SELECT doc_id, slot, 3 AS render_mode, y1 - y0 AS font_size FROM {_LINES} WHERE p % 100 >= 40 AND s % 4 <> 0""")
def text_layer_spans(spark, sf_dir):
    spans = _lines(spark, sf_dir).withColumns({"confidence": (F.col("p") % 100).cast("double") / 100, "text": F.when(F.col("s") % 4 == 0, F.lit("  ")).otherwise(F.lit("w"))})
    return editing.text_layer(spans, 0.4).select("doc_id", "slot", "render_mode", "font_size")


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'r' || c_nationkey % 2 FROM customer),
    w(object) AS (SELECT 'r1' UNION SELECT target FROM e JOIN w ON e.source = w.object) SELECT object FROM w""")
def imported_objects(spark, sf_dir):
    edge = lambda df, kind, key, to, target: df.select(F.concat(F.lit(kind), key.cast("string")).alias("source"), F.concat(F.lit(to), target.cast("string")).alias("target"))
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    edges = edge(nation, "r", F.col("n_regionkey"), "n", F.col("n_nationkey")).union(edge(customer, "n", F.col("c_nationkey"), "c", F.col("c_custkey"))).union(edge(customer, "c", F.col("c_custkey"), "r", F.col("c_nationkey") % 2))
    return editing.reachable(edges, spark.range(1).select(F.lit("r1").alias("object")))


# pictures, runs, text


@query(f"""WITH RECURSIVE i AS (SELECT doc_id, slot, p % 4 + 0.0 AS x0, s % 4 + 0.0 AS y0, p % 4 + 20.0 + p % 2 * 20 AS x1, s % 4 + 42.0 AS y1 FROM {_LINES}),
    b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY slot) AS nth FROM i WHERE x1 - x0 >= 24 AND y1 - y0 >= 24),
    g AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS nth, CAST([] AS STRUCT(slot INTEGER, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[]) AS kept FROM b
        UNION ALL SELECT b.doc_id, b.nth, CASE WHEN len(list_filter(kept, lambda k: greatest(0, least(k.x1, b.x1) - greatest(k.x0, b.x0)) * greatest(0, least(k.y1, b.y1) - greatest(k.y0, b.y0))
            / least((k.x1 - k.x0) * (k.y1 - k.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) > 0.9)) > 0 THEN kept ELSE list_append(kept, {{'slot': b.slot, 'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1}}) END
        FROM g JOIN b ON g.doc_id = b.doc_id AND b.nth = g.nth + 1)
    SELECT doc_id, unnest(kept).slot AS slot FROM g QUALIFY nth = max(nth) OVER (PARTITION BY doc_id)""")
def kept_figures(spark, sf_dir):
    # boxes that overlap in part: some by more than the limit, and not all with one another
    rows = _lines(spark, sf_dir)
    x, y = (F.col("p") % 4).cast("double"), (F.col("s") % 4).cast("double")
    images = rows.withColumns({"rect": geometry.box(x, y, x + 20 + F.col("p") % 2 * 20, y + 42), "stream": F.lit("page")})
    return editing.figures(images, ["doc_id"], "slot").select("doc_id", "slot")


@query(f"""WITH b AS (SELECT doc_id, slot AS block, x0, y0, x1, y1 FROM {_LINES} WHERE p % 2 = 0), i AS (SELECT doc_id, slot, x0, y0, x1, y1 FROM {_LINES} WHERE p % 2 = 1),
    j AS (SELECT i.doc_id, i.slot, b.block, greatest(0, least(i.x1, b.x1) - greatest(i.x0, b.x0)) > 1.0 AND b.y0 >= i.y1 AS above, b.y0 - i.y1 AS gap, b.y1 >= (i.y0 + i.y1) / 2 AS back FROM i LEFT JOIN b ON i.doc_id = b.doc_id)
    SELECT doc_id, slot, coalesce(CAST(arg_min(block, gap * 1000 + block) FILTER (above) AS DOUBLE), max(block) FILTER (back), -1) + 0.5 AS order_key FROM j GROUP BY doc_id, slot""")
def picture_places(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    blocks = rows.filter("p % 2 = 0").select("doc_id", F.col("slot").alias("block_index"), "rect")
    return editing.image_places(rows.filter("p % 2 = 1").select("doc_id", "slot", "rect"), blocks, ["doc_id"], "slot")


@query("""WITH r AS (SELECT conv_id, turn, text, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) - length(text) AS BIGINT) AS start_index FROM conversations WHERE length(text) > 0),
    q AS (SELECT DISTINCT conv_id, 5 + conv_id % 7 AS a, 40 + conv_id % 90 AS b FROM conversations), o AS (SELECT r.*, greatest(a, start_index) AS f, least(b, start_index + length(text)) AS t FROM r JOIN q USING (conv_id))
    SELECT conv_id, turn, round(10 * 20.0 * (f - start_index) / length(text) + 3, 6) AS l_side, round(turn * 12 - 2.5, 6) AS b_side, round(10 * 20.0 * (t - start_index) / length(text) + 3, 6) AS r_side, round(turn * 12 + 7.5, 6) AS t_side FROM o WHERE f < t""")
def text_range_boxes(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn", "text").rowsBetween(Window.unboundedPreceding, 0)
    turns = table(spark, sf_dir, "conversations").filter("length(text) > 0")
    number = lambda v: F.lit(float(v))
    matrix = F.struct(number(10).alias("a"), number(0).alias("b"), number(0).alias("c"), number(10).alias("d"), number(3).alias("e"), (F.col("turn") * 12.0).alias("f"))
    runs = turns.select("conv_id", F.col("turn").alias("run_index"), "text", number(20).alias("width"), matrix.alias("matrix"), (F.sum(F.length("text")).over(w) - F.length("text")).alias("start_index"))
    ranges = turns.select("conv_id", (5 + F.col("conv_id") % 7).alias("start"), (40 + F.col("conv_id") % 90).alias("end")).distinct()
    return editing.range_boxes(runs, ranges, ["conv_id"]).select("conv_id", F.col("run_index").alias("turn"), *(F.round(c, 6).alias(n) for c, n in ((F.col(f"rect.{s}"), f"{s[0]}_side") for s in ("left", "bottom", "right", "top"))))


@query(f"""SELECT doc_id, q.x, q.y, coalesce((SELECT e.slot FROM {_LINES} AS e WHERE e.doc_id = q.doc_id ORDER BY pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2), e.slot LIMIT 1), -1) AS run FROM {_PROBE} AS q""")
def nearest_runs(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("slot").alias("run_index"), F.col("rect").alias("bounds"))
    return layout.nearest_run(rows, _probe(rows), ["doc_id"])


@query(f"""SELECT doc_id, string_agg('w' || p, ' ' ORDER BY slot) AS text FROM {_LINES} WHERE (x0 + x1) / 2 BETWEEN 15 AND 45 AND (y0 + y1) / 2 BETWEEN 5 AND 35 GROUP BY doc_id""")
def texts_in_boxes(spark, sf_dir):
    rows = _lines(spark, sf_dir).select("doc_id", F.col("slot").alias("run_index"), F.col("rect").alias("bounds"), F.concat(F.lit("w"), F.col("p").cast("string")).alias("text"))
    return layout.text_in_box(rows, ["doc_id"], geometry.box(F.lit(15.0), F.lit(5.0), F.lit(45.0), F.lit(35.0)))


#: All order lines on one page, with boxes of very different sizes, and parts as points among them.
_PAGE = """(SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS slot, l_extendedprice / 50 AS x0, CAST((l_partkey * 7919 + l_suppkey * 31) % 2000 AS DOUBLE) AS y0,
    l_extendedprice / 50 + 2 + CASE WHEN l_partkey % 500 = 0 THEN 400 ELSE l_quantity / 5 END AS x1, CAST((l_partkey * 7919 + l_suppkey * 31) % 2000 AS DOUBLE) + 2 + CASE WHEN l_partkey % 500 = 0 THEN 300 ELSE l_linenumber END AS y1 FROM lineitem)"""
_SPOTS = "(SELECT p_partkey AS spot, p_retailprice + 0.0 AS x, CAST(p_partkey * 13 % 2000 AS DOUBLE) AS y FROM part)"


def _page(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey", "l_quantity")
    lines = editing.numbered(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "slot")
    x, y = F.col("l_extendedprice") / 50, ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 31) % 2000).cast("double")
    large = F.col("l_partkey") % 500 == 0
    rect = geometry.box(x, y, x + 2 + F.when(large, 400).otherwise(F.col("l_quantity") / 5), y + 2 + F.when(large, 300).otherwise(F.col("l_linenumber")))
    return lines.select(F.lit(1).alias("page"), F.col("slot").cast("int").alias("slot"), rect.alias("rect"))


def _spots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.lit(1).alias("page"), F.col("p_partkey").alias("spot"), F.col("p_retailprice").cast("double").alias("x"), (F.col("p_partkey") * 13 % 2000).cast("double").alias("y"))


@query(f"""SELECT spot, slot, CAST(row_number() OVER (PARTITION BY spot ORDER BY slot DESC) AS INTEGER) AS depth FROM {_SPOTS} JOIN {_PAGE} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""")
def one_page_hits(spark, sf_dir):
    return editing.elements_at(_page(spark, sf_dir), _spots(spark, sf_dir), ["page"], "slot").select("spot", "slot", "depth")


@query(f"""SELECT spot, CAST(max(slot) AS INTEGER) AS slot FROM {_SPOTS} LEFT JOIN {_PAGE} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY spot""")
def one_page_topmost(spark, sf_dir):
    rows = _page(spark, sf_dir).withColumn("flags", F.lit(0))
    return annotations.topmost_at(rows, _spots(spark, sf_dir), ["page"]).select("spot", "slot")


@query(f"""SELECT spot, arg_min(slot, {{'d': pow(greatest(x0 - x, 0, x - x1), 2) + pow(greatest(y0 - y, 0, y - y1), 2), 's': slot}}) AS run FROM {_SPOTS}, {_PAGE} GROUP BY spot""")
def one_page_nearest(spark, sf_dir):
    runs = _page(spark, sf_dir).select("page", F.col("slot").alias("run_index"), F.col("rect").alias("bounds"))
    return layout.nearest_run(runs, _spots(spark, sf_dir), ["page"]).select("spot", "run")


@query(f"""SELECT slot FROM {_PAGE} ANTI JOIN {_SPOTS} ON x0 <= x + 5 AND x1 >= x AND y0 <= y + 3 AND y1 >= y""")
def one_page_redactions(spark, sf_dir):
    marks = _spots(spark, sf_dir).select("page", geometry.box(F.col("x"), F.col("y"), F.col("x") + 5, F.col("y") + 3).alias("rect"))
    return annotations.redacted(_page(spark, sf_dir).withColumn("item", F.col("slot")), marks, ["page"]).select("slot")


@query(f"""SELECT spot, string_agg(CAST(slot AS VARCHAR), ' ' ORDER BY slot) AS text FROM {_SPOTS} JOIN {_PAGE} ON (x0 + x1) / 2 BETWEEN x AND x + 9 AND (y0 + y1) / 2 BETWEEN y AND y + 6 GROUP BY spot""")
def one_page_texts(spark, sf_dir):
    runs = _page(spark, sf_dir).select("page", F.col("slot").alias("run_index"), F.col("slot").cast("string").alias("text"), F.col("rect").alias("bounds"))
    areas = _spots(spark, sf_dir).select("page", "spot", geometry.box(F.col("x"), F.col("y"), F.col("x") + 9, F.col("y") + 6).alias("area"))
    return layout.texts_in_boxes(runs, areas, ["page"]).select("spot", "text")


@query(f"""WITH i AS (SELECT spot, x, y, x + 40 AS x1, y + 10 AS y1 FROM {_SPOTS}), b AS (SELECT * FROM {_PAGE} WHERE slot % 4 = 0),
    j AS (SELECT spot, slot, greatest(0, least(i.x1, b.x1) - greatest(i.x, b.x0)) > 0.1 * least(i.x1 - i.x, b.x1 - b.x0) AND b.y0 >= i.y1 AS above, b.y0 - i.y1 AS gap, b.y1 >= (i.y + i.y1) / 2 AS back FROM i, b)
    SELECT spot, coalesce(arg_min(slot, {{'g': gap, 's': slot}}) FILTER (above), max(slot) FILTER (back), -1) + CAST(0.5 AS DOUBLE) AS order_key FROM j GROUP BY spot""")
def one_page_pictures(spark, sf_dir):
    blocks = _page(spark, sf_dir).filter("slot % 4 = 0").select("page", F.col("slot").alias("block_index"), "rect")
    images = _spots(spark, sf_dir).select("page", "spot", geometry.box(F.col("x"), F.col("y"), F.col("x") + 40, F.col("y") + 10).alias("rect"))
    return editing.image_places(images, blocks, ["page"], "spot").select("spot", F.col("order_key").cast("double").alias("order_key"))


@query(f"""WITH r AS (SELECT *, p % 3 AS gap, lag(p % 3) OVER (PARTITION BY doc_id ORDER BY slot) AS before FROM {_LINES})
    SELECT doc_id, string_agg(CASE WHEN before IS NULL THEN '' WHEN gap <> before THEN chr(10) WHEN s % 2 = 0 THEN ' ' ELSE '' END || 'w' || p, '' ORDER BY slot) AS text FROM r GROUP BY doc_id""")
def page_texts(spark, sf_dir):
    number = lambda v: F.lit(float(v))
    # each run begins where the one before ends, or three tenths of an em later; lines are ten ems apart
    step = F.when(F.col("s") % 2 == 0, number(3)).otherwise(number(0)) + 40
    w = Window.partitionBy("doc_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(spark, sf_dir).withColumn("at", F.sum(step).over(w))
    matrix = F.struct(number(10).alias("a"), number(0).alias("b"), number(0).alias("c"), number(10).alias("d"), F.col("at").alias("e"), (F.col("p") % 3 * 100.0).alias("f"))
    return layout.joined_pages(rows.select("doc_id", F.col("slot").alias("run_index"), F.concat(F.lit("w"), F.col("p").cast("string")).alias("text"), number(4).alias("width"), matrix.alias("matrix")), ["doc_id"])


#: The font's public metrics once more, by groups of characters of one width (fixed values), so that the SQL doesn't read the code's list.
_WIDTHS = """CASE WHEN c IN ('i', 'j', 'l') THEN 222 WHEN c = chr(39) THEN 191 WHEN c = '|' THEN 260 WHEN c IN (' ', '!', ',', '.', '/', ':', ';', 'I', '[', ']', chr(92), 'f', 't') THEN 278
    WHEN c IN ('(', ')', '-', '`', 'r') THEN 333 WHEN c IN ('{', '}') THEN 334 WHEN c = '"' THEN 355 WHEN c = '*' THEN 389 WHEN c = '^' THEN 469 WHEN c IN ('J', 'c', 'k', 's', 'v', 'x', 'y', 'z') THEN 500
    WHEN c IN ('+', '<', '=', '>', '~') THEN 584 WHEN c IN ('F', 'T', 'Z') THEN 611 WHEN c IN ('&', 'A', 'B', 'E', 'K', 'P', 'S', 'V', 'X', 'Y') THEN 667 WHEN c IN ('C', 'D', 'H', 'N', 'R', 'U', 'w') THEN 722
    WHEN c IN ('G', 'O', 'Q') THEN 778 WHEN c IN ('M', 'm') THEN 833 WHEN c = '%' THEN 889 WHEN c = 'W' THEN 944 WHEN c = '@' THEN 1015 ELSE 556 END"""


@query(f"""SELECT conv_id, turn, round(list_sum(list_transform(string_split(text, ''), lambda c: {_WIDTHS})) * 12.0 / 1000, 6) AS width FROM conversations WHERE length(text) > 0""")
def text_widths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("length(text) > 0").select("conv_id", "turn", F.round(editing.text_width(F.col("text"), 12.0), 6).alias("width"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) - INTERVAL 90 MINUTE AS short_year, CAST(o_orderdate AS TIMESTAMP) AS long_year FROM orders WHERE year(o_orderdate) BETWEEN 1950 AND 2049""")
def asn1_times(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter("year(o_orderdate) between 1950 and 2049")
    short = F.concat(F.date_format("o_orderdate", "yyMMddHHmmss"), F.lit("+0130"))
    return orders.select("o_orderkey", editing.asn1_time(short, F.lit(True)).alias("short_year"), editing.asn1_time(F.concat(F.date_format("o_orderdate", "yyyyMMddHHmm"), F.lit("Z")), F.lit(False)).alias("long_year"))


@query("""SELECT p_partkey, CASE WHEN p_size < 40 THEN '0.' || p_size WHEN p_size < 80 THEN '1.' || (p_size - 40) ELSE '2.' || (p_size - 80) END || '.' || p_partkey % 16384 || '.' || p_size AS oid FROM part""")
def object_identifiers(spark, sf_dir):
    p = F.col("p_partkey") % 16384
    parts = F.array(F.col("p_size").cast("long"), (128 + F.floor(p / 128)).cast("long"), (p % 128).cast("long"), F.col("p_size").cast("long"))
    return table(spark, sf_dir, "part").select("p_partkey", editing.oid_text(parts).alias("oid"))


@query("""WITH c AS (SELECT n_nationkey AS cert, n_nationkey % 5 AS subject, (n_nationkey + 1) % 7 AS issuer FROM nation), j AS (SELECT c.cert, i.cert AS issuer_cert, (i.cert + c.cert) % 3 = 0 AS sure FROM c LEFT JOIN c AS i ON c.issuer = i.subject AND i.cert <> c.cert)
    SELECT cert, issuer_cert, CASE WHEN issuer_cert IS NOT NULL THEN sure END AS verified FROM j QUALIFY row_number() OVER (PARTITION BY cert ORDER BY CASE WHEN sure THEN 0 ELSE 1 END, issuer_cert) = 1""")
def certificate_issuers(spark, sf_dir):
    key = F.col("n_nationkey")
    verified = F.filter(F.sequence(F.lit(0), F.lit(40)).cast("array<bigint>"), lambda i: (i + key) % 3 == 0)
    certs = table(spark, sf_dir, "nation").select(key.cast("long").alias("cert"), (key % 5).cast("long").alias("subject"), ((key + 1) % 7).cast("long").alias("issuer"), verified.alias("verifies"))
    return editing.issuers(certs).select("cert", "issuer_cert", F.when(F.col("issuer_cert").isNotNull(), F.col("verified")).alias("verified"))


@query("""WITH c AS (SELECT c_nationkey AS doc, c_mktsegment AS issuer, c_custkey % 10 AS serial, c_custkey AS cert FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT c_custkey AS signer, c_nationkey AS doc, c_mktsegment AS issuer, c_custkey % 10 AS serial FROM customer WHERE c_custkey % 3 = 1),
    f AS (SELECT doc, min(cert) AS first FROM c GROUP BY doc)
    SELECT signer, s.doc, coalesce(min(c.cert), min(f.first)) AS cert FROM s LEFT JOIN c ON s.doc = c.doc AND s.issuer = c.issuer AND s.serial = c.serial LEFT JOIN f ON s.doc = f.doc GROUP BY signer, s.doc""")
def signer_certificates(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cert"), F.col("c_nationkey").alias("doc"), F.col("c_mktsegment").alias("issuer"), (F.col("c_custkey") % 10).alias("serial"))
    signers = rows.filter("cert % 3 = 1").select(F.col("cert").alias("signer"), "doc", "issuer", "serial")
    return editing.signer_certificates(signers, rows.filter("cert % 3 = 0").withColumn("position", F.col("cert")), "doc").select("signer", "doc", "cert")


# colours, geometry, numbers


@query(f"""SELECT doc_id, CAST(round(avg(p % 256)) AS INTEGER) AS r, CAST(round(avg(s % 256)) AS INTEGER) AS g, 7 AS b FROM {_LINES} GROUP BY doc_id""")
def average_colours(spark, sf_dir):
    stop = F.struct((F.col("p") % 256).cast("double").alias("r"), (F.col("s") % 256).cast("double").alias("g"), F.lit(7.0).alias("b"))
    return _lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(stop).alias("stops")).select("doc_id", editing.average_colour(F.col("stops")).alias("c")).select("doc_id", "c.*")


@query("""WITH l AS (SELECT p_partkey, (p_size * 2.0 + 16) / 116 AS m, (p_partkey % 100 - 50) / 500.0 AS a, (p_size - 25) / 200.0 AS b FROM part),
    t AS (SELECT p_partkey, m + a AS tx, m AS ty, m - b AS tz FROM l),
    x AS (SELECT p_partkey, 0.9642 * CASE WHEN tx >= 6.0::DOUBLE / 29 THEN tx * tx * tx ELSE (108.0::DOUBLE / 841) * (tx - 4.0::DOUBLE / 29) END AS x, CASE WHEN ty >= 6.0::DOUBLE / 29 THEN ty * ty * ty ELSE (108.0::DOUBLE / 841) * (ty - 4.0::DOUBLE / 29) END AS y, 0.8249 * CASE WHEN tz >= 6.0::DOUBLE / 29 THEN tz * tz * tz ELSE (108.0::DOUBLE / 841) * (tz - 4.0::DOUBLE / 29) END AS z FROM t),
    n AS (SELECT p_partkey, 3.1339 * x - 1.6169 * y - 0.4906 * z AS lr, -0.9785 * x + 1.9160 * y + 0.0333 * z AS lg, 0.0720 * x - 0.2290 * y + 1.4057 * z AS lb FROM x)
    SELECT p_partkey, CAST(round(greatest(0, least(1, CASE WHEN lr <= 0.0031308 THEN 12.92 * lr ELSE 1.055 * pow(greatest(lr, 0), 1 / 2.4::DOUBLE) - 0.055 END)) * 255) AS INTEGER) AS r,
        CAST(round(greatest(0, least(1, CASE WHEN lg <= 0.0031308 THEN 12.92 * lg ELSE 1.055 * pow(greatest(lg, 0), 1 / 2.4::DOUBLE) - 0.055 END)) * 255) AS INTEGER) AS g,
        CAST(round(greatest(0, least(1, CASE WHEN lb <= 0.0031308 THEN 12.92 * lb ELSE 1.055 * pow(greatest(lb, 0), 1 / 2.4::DOUBLE) - 0.055 END)) * 255) AS INTEGER) AS b FROM n""")
def lab_colours(spark, sf_dir):
    rgb = editing.rgb_from_lab(F.col("p_size") * 2.0, (F.col("p_partkey") % 100 - 50).cast("double"), (F.col("p_size") - 25).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", "c.*")


@query("""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 60 AS DOUBLE) AS y FROM part)
    SELECT p_partkey, CASE WHEN greatest(x, 10) < least(x + 30, 50) AND greatest(y, 20) < least(y + 20, 60) THEN greatest(x, 10) ELSE 10 END AS l_side, CASE WHEN greatest(x, 10) < least(x + 30, 50) AND greatest(y, 20) < least(y + 20, 60) THEN least(y + 20, 60) ELSE 60 END AS t_side,
        x <= 50 AND x + 30 >= 10 AND y <= 60 AND y + 20 >= 20 AS meets, CASE p_partkey % 4 WHEN 1 THEN y WHEN 2 THEN 100 - x WHEN 3 THEN 200 - y ELSE x END AS view_x, CASE p_partkey % 4 WHEN 1 THEN x WHEN 2 THEN y WHEN 3 THEN 100 - x ELSE 200 - y END AS view_y,
        round(2 * (0.4 + 1.2 * least(1, x / 40)), 9) AS pen, CAST(round(least(1, x / 40) * 255) AS INTEGER) AS gray, round(x * 2 + 3, 9) AS there_x, round(x, 9) AS back_x, round(sqrt(6), 9) AS scale FROM b""")
def geometry_values(spark, sf_dir):
    x, y, n = F.col("p_size").cast("double"), (F.col("p_partkey") % 60).cast("double"), F.lit
    media = geometry.box(n(10.0), n(20.0), n(50.0), n(60.0))
    own = geometry.normal_box(x + 30, y + 20, x, y)
    shown = geometry.to_view(x, y, n(100.0), n(200.0), (F.col("p_partkey") % 4 * 90).cast("int"))
    m = F.struct(n(2.0).alias("a"), n(0.0).alias("b"), n(0.0).alias("c"), n(3.0).alias("d"), n(3.0).alias("e"), n(5.0).alias("f"))
    there = geometry.matrix_apply(m, x, y)
    held = table(spark, sf_dir, "part").select("p_partkey", geometry.page_box(media, own).alias("page"), geometry.intersects(own, media).alias("meets"), shown.alias("v"), geometry.ink_width(n(2.0), x / 40).alias("pen"), geometry.rgb_from_gray(x / 40)["r"].alias("gray"), there.alias("there"), geometry.matrix_apply(geometry.matrix_inverse(m), there["x"], there["y"]).alias("back"), geometry.matrix_scale(m).alias("scale"))
    return held.select("p_partkey", F.col("page.left").alias("l_side"), F.col("page.top").alias("t_side"), "meets", F.col("v.x").alias("view_x"), F.col("v.y").alias("view_y"), F.round("pen", 9).alias("pen"), "gray", F.round("there.x", 9).alias("there_x"), F.round("back.x", 9).alias("back_x"), F.round("scale", 9).alias("scale"))


@query(f"""WITH n AS (SELECT *, lead(x0) OVER w AS nx, lead(y0) OVER w AS ny FROM {_LINES} WINDOW w AS (PARTITION BY doc_id ORDER BY slot))
    SELECT doc_id, round(coalesce(sum(sqrt((nx - x0) * (nx - x0) + (ny - y0) * (ny - y0))), 0), 6) AS along, round(avg(x0), 6) AS middle_x, round(avg(y0), 6) AS middle_y FROM n GROUP BY doc_id""")
def paths_and_centres(spark, sf_dir):
    p = F.col("points")
    return _points(spark, sf_dir).select("doc_id", F.round(geometry.path_length(p), 6).alias("along"), F.round(geometry.centroid(p)["x"], 6).alias("middle_x"), F.round(geometry.centroid(p)["y"], 6).alias("middle_y"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size // 4 AS VARCHAR) WHEN p_size % 4 = 2 THEN (p_size // 4) || '.5' ELSE (p_size // 4) || CASE WHEN p_size % 4 = 1 THEN '.25' ELSE '.75' END END AS shown FROM part""")
def real_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", measure.real_text(F.col("p_size") / 4.0).alias("shown"))


# queues, feeds, logs, stores


@query("""WITH e AS (SELECT user_id, event_id AS seq, event_id % 5 AS page, event_id % 3 AS priority FROM events), c AS (SELECT user_id, page, priority, max(seq) AS last FROM e WHERE seq % 11 = 0 GROUP BY ALL)
    SELECT e.user_id, seq, CAST(row_number() OVER (PARTITION BY e.user_id ORDER BY e.priority, seq) AS INTEGER) AS place FROM e LEFT JOIN c ON e.user_id = c.user_id AND e.page = c.page AND e.priority = c.priority WHERE seq % 11 <> 0 AND (last IS NULL OR last < seq)""")
def queue_order(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("page"), (F.col("event_id") % 3).alias("priority"))
    return editing.served(events.filter("seq % 11 <> 0"), events.filter("seq % 11 = 0"), "user_id").select("user_id", "seq", "place")


@query("""SELECT user_id, event_id, ts + INTERVAL 45 MINUTE AS fires FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events) WHERE after IS NULL OR after >= ts + INTERVAL 45 MINUTE""")
def settled_events(spark, sf_dir):
    return editing.debounced(table(spark, sf_dir, "events"), ["user_id"], "ts", "45 minutes", "event_id").select("user_id", "event_id", "fires")


@query("""SELECT event_id, event_id AS at_ms, 'raster' AS event, CAST(user_id % 9 AS INTEGER) AS page, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 50 + 0.5::DOUBLE END AS took_ms FROM events WHERE event_id % 7 <> 0""")
def log_lines(spark, sf_dir):
    e, u = F.col("event_id"), (F.col("user_id") % 9).cast("string")
    line = F.when(e % 7 == 0, F.concat(F.lit("flutter: starting "), e.cast("string"))).otherwise(F.concat(F.lit("flutter: [perf "), e.cast("string"), F.lit("] raster page="), u, F.when(e % 3 == 0, F.lit(" skipped")).otherwise(F.concat(F.lit(" "), (e % 50).cast("string"), F.lit(".5ms")))))
    return editing.log_events(table(spark, sf_dir, "events").select("event_id", line.alias("line"))).select("event_id", "at_ms", "event", "page", "took_ms")


@query("""SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN CAST(p_size AS INTEGER) END AS page, CASE WHEN p_size % 7 > 0 THEN CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE p_size % 3 * 1.5 END END AS zoom FROM part""")
def viewports(spark, sf_dir):
    size = F.col("p_size")
    text = F.when(size % 7 == 0, F.lit("{no}")).otherwise(editing.viewport_text(size, F.lit(0.5), F.lit(None), size % 3 * 1.5))
    return table(spark, sf_dir, "part").select("p_partkey", editing.viewport_read(text).alias("v")).select("p_partkey", "v.page", "v.zoom")


@query("""WITH w AS (SELECT DISTINCT c_custkey AS page FROM customer WHERE c_custkey % 3 <> 0) SELECT page, CASE WHEN page % 2 = 0 THEN 'held' ELSE 'made' END AS text, page % 2 = 0 AS cached FROM w""")
def cached_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page"))
    store = pages.filter("page % 2 = 0").distinct().withColumn("text", F.lit("held"))
    return editing.read_through(pages.filter("page % 3 <> 0"), store, ["page"], lambda missing: missing.select("page", F.lit("made").alias("text")))


@query("""SELECT c_nationkey, CAST(sum(c_custkey) AS BIGINT) AS bytes, count(*) AS entries FROM customer GROUP BY c_nationkey""")
def stored_sizes(spark, sf_dir):
    return editing.stored_bytes(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_custkey")


@query("""WITH t AS (SELECT o_orderpriority AS tool, count(*) AS pages, CAST(sum(o_custkey) AS DOUBLE) AS ms FROM orders GROUP BY 1), b AS (SELECT ms / pages AS base FROM t WHERE tool = '1-URGENT')
    SELECT tool, '| ' || tool || ' | ' || pages || ' | ' || printf('%.1f', ms / pages) || ' | ' || printf('%.2fx', base / (ms / pages)) || ' |' AS line FROM t LEFT JOIN b ON TRUE""")
def benchmark_report(spark, sf_dir):
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tool")).agg(F.count(F.lit(1)).alias("pages"), F.sum("o_custkey").cast("double").alias("ms"))
    return editing.report_lines(totals, "1-URGENT")


@query("""WITH RECURSIVE e AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS n, CASE event_id % 4 WHEN 0 THEN 'undo' WHEN 1 THEN 'redo' ELSE 'edit' END AS op FROM events),
    w AS (SELECT user_id, CAST(0 AS BIGINT) AS n, 0 AS cursor, 0 AS revisions FROM (SELECT DISTINCT user_id FROM events) UNION ALL
        SELECT w.user_id, e.n, CASE e.op WHEN 'edit' THEN cursor + 1 WHEN 'undo' THEN greatest(cursor - 1, 0) ELSE least(cursor + 1, revisions) END, CASE e.op WHEN 'edit' THEN cursor + 1 ELSE revisions END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
    SELECT user_id, cursor, revisions FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC) = 1""")
def undo_cursors(spark, sf_dir):
    e = F.col("event_id") % 4
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(e == 0, F.lit("undo")).when(e == 1, F.lit("redo")).otherwise(F.lit("edit")).alias("op"))
    return annotations.undo_log(events, ["user_id"], "event_id")


@query("""SELECT event_id, value FROM events WHERE value >= 20 AND event_id % 4 <> 0 AND event_id % 5 <> 0""")
def sure_spans(spark, sf_dir):
    e = F.col("event_id")
    bounds = geometry.box(F.lit(0.0), F.lit(0.0), F.when(e % 4 == 0, F.lit(0.0)).otherwise(F.lit(1.0)), F.lit(1.0))
    spans = table(spark, sf_dir, "events").select("event_id", "value", F.col("value").alias("confidence"), bounds.alias("bounds"), F.when(e % 5 == 0, F.lit(" ")).otherwise(F.lit("w")).alias("text"))
    return recognition.confident_spans(spans, 20.0).select("event_id", "value")


# graphics state and kept state

#: Forty orders make a page of operations: scopes, moves and scales, lines of text.
_OPS = """(SELECT l_orderkey // 40 AS page, row_number() OVER (PARTITION BY l_orderkey // 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS i, l_partkey % 9 AS k,
    CAST(l_suppkey % 3 - 1 AS DOUBLE) AS u, CAST(l_linenumber AS DOUBLE) AS v, CASE l_suppkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 2.0 END AS z FROM lineitem)"""
_OPERATORS = ("q", "q", "Q", "cm", "Tj", "BT", "Tm", "Td", "Tj")


@query(f"""WITH RECURSIVE o AS (SELECT * FROM {_OPS}), g AS (
    SELECT DISTINCT page, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS k, [1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS m, CAST([] AS DOUBLE[][]) AS held, [1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] AS line FROM o
    UNION ALL SELECT o.page, o.i, o.k, CASE o.k WHEN 2 THEN coalesce(g.held[-1], g.m) WHEN 3 THEN [z * m[1], z * m[2], u * m[1] + m[3], v * m[2] + m[4]] ELSE m END,
        CASE WHEN o.k IN (0, 1) THEN list_append(g.held, m) WHEN o.k = 2 THEN g.held[:-2] ELSE g.held END,
        CASE o.k WHEN 5 THEN [1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE] WHEN 6 THEN [z, u, v] WHEN 7 THEN [line[1], u * line[1] + line[2], v * line[1] + line[3]] ELSE line END
    FROM g JOIN o ON g.page = o.page AND o.i = g.i + 1)
    SELECT page, i, CAST(len(held) AS INTEGER) AS depth, m[1] AS width, m[3] AS x, m[4] AS y, line[1] AS size, line[2] AS line_x, line[3] AS line_y FROM g WHERE k IN (4, 8)""")
def shown_text_matrices(spark, sf_dir):
    order = Window.partitionBy("page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("page", F.expr("l_orderkey div 40"))
    u, v = (F.col("l_suppkey") % 3 - 1).cast("double"), F.col("l_linenumber").cast("double")
    z, zero = F.get(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("l_suppkey") % 3).cast("int")), F.lit(0.0)
    name = F.get(F.array(*map(F.lit, _OPERATORS)), (F.col("l_partkey") % 9).cast("int"))
    ops = lines.select("page", (F.row_number().over(order) - 1).cast("long").alias("op_index"), name.alias("operator"), F.array(z, zero, zero, z, u, v).alias("six"), F.array(u, v).alias("two"))
    ops = ops.withColumn("numbers", F.when(F.col("operator").isin("cm", "Tm"), F.col("six")).when(F.col("operator") == "Td", F.col("two")))
    found = graphics.text_matrices(ops, ["page"])
    return found.select("page", F.col("op_index").alias("i"), "depth", F.col("ctm.a").alias("width"), F.col("ctm.e").alias("x"), F.col("ctm.f").alias("y"), F.col("line.a").alias("size"), F.col("line.e").alias("line_x"), F.col("line.f").alias("line_y"))


@query("""SELECT user_id, name, event_id AS seq, event_type AS snapshot FROM (SELECT *, event_id % 20 AS name FROM events) QUALIFY event_id = max(event_id) OVER (PARTITION BY user_id, name) AND event_id % 7 <> 0""")
def bucketed_feed(spark, sf_dir):
    # batches come out of order: each has every fourth event
    kind = F.when(F.col("event_id") % 7 == 0, F.lit("removed")).otherwise(F.lit("modified"))
    feed = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 20).alias("name"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("event_type").alias("snapshot"))
    state = Buckets(shared_folder(spark, "bucketed-feed"), feed.schema, ("user_id", "name"), number=16)
    for batch in range(4):
        state.merge(feed.filter(F.col("seq") % 4 == 3 - batch), batch)
    return state.state(spark).select("user_id", "name", "seq", "snapshot")


@query("""WITH RECURSIVE c AS (SELECT DISTINCT (l_partkey * 7 + l_linenumber) % 400 AS x, l_orderkey % 300 AS y, l_orderkey % 300 * 4294967296 + (l_partkey * 7 + l_linenumber) % 400 AS id FROM lineitem),
    e AS (SELECT a.id AS a, b.id AS b FROM c AS a JOIN c AS b ON b.y = a.y AND b.x = a.x + 1 UNION ALL SELECT a.id, b.id FROM c AS a JOIN c AS b ON b.x = a.x AND b.y = a.y + 1), b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r AS (SELECT id, id AS other FROM c UNION SELECT r.id, b.b FROM r JOIN b ON r.other = b.a), l AS (SELECT id, min(other) AS region FROM r GROUP BY id)
    SELECT region, min(x) AS l_side, min(y) AS t_side, max(x) AS r_side, max(y) AS b_side, count(*) AS n FROM l JOIN c USING (id) GROUP BY region""")
def one_page_regions(spark, sf_dir):
    cells = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("page"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 400).alias("x"), (F.col("l_orderkey") % 300).alias("y"))
    found = regions.regions(cells, ["page"], tile=64)
    return found.select("region", F.col("left").alias("l_side"), F.col("top").alias("t_side"), F.col("right").alias("r_side"), F.col("bottom").alias("b_side"), "n")
