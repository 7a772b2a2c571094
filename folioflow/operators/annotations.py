"""Annotations and form fields as tables: types, permissions, hits, edits, change feeds in batch, forms, visibility, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import intersects
from folioflow.operators import spatial

# bits of an annotation's flags, counted from 1 in the format's tables (fixed values)
HIDDEN, READ_ONLY, LOCKED, LOCKED_CONTENTS = 1 << 1, 1 << 6, 1 << 7, 1 << 9
# bits of a field's flags (fixed values)
RADIO, PUSH_BUTTON, COMBO, EDIT, MULTILINE = 1 << 15, 1 << 16, 1 << 17, 1 << 18, 1 << 12


def has(flags: Column, bit: int) -> Column:
    return F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(bit)) != 0


def field_type(kind: Column, flags: Column) -> Column:
    """From a field's kind (Btn, Tx, Ch, Sig) and its flags."""
    return (
        F.when(kind == "Btn", F.when(has(flags, PUSH_BUTTON), F.lit("push_button")).when(has(flags, RADIO), F.lit("radio")).otherwise(F.lit("check_box")))
        .when(kind == "Ch", F.when(has(flags, COMBO), F.lit("combo")).otherwise(F.lit("list")))
        .when(kind == "Tx", F.lit("text"))
        .when(kind == "Sig", F.lit("signature"))
        .otherwise(F.lit("unknown"))
    )


def is_editable(flags: Column, allowed: Column | None = None) -> Column:
    fine = ~has(flags, READ_ONLY) & ~has(flags, LOCKED)
    return fine if allowed is None else fine & allowed


def in_rubber_band(annotations: DataFrame, area: Column) -> DataFrame:
    """Visible, editable annotations whose box meets the area, sides included."""
    return annotations.filter(~has(F.col("flags"), HIDDEN) & is_editable(F.col("flags")) & intersects(F.col("rect"), area))


def topmost_at(annotations: DataFrame, points: DataFrame, keys: list[str], slot: str = "slot") -> DataFrame:
    """For each point of a page, the slot of the topmost annotation whose box holds it; null where none does."""
    shown = annotations.filter(~has(F.col("flags"), HIDDEN)).select(*keys, slot, "rect")
    at = [*keys, "x", "y"]
    best = spatial.at_places(points, shown, keys).groupBy(*at).agg(F.max(slot).alias(slot))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}")) for c in at]
    return points.distinct().alias("p").join(best.alias("q"), same, "left").select("p.*", F.col(f"q.{slot}").alias("slot"))


def first_by_name(annotations: DataFrame, name: str, *order: str) -> DataFrame:
    """The first annotation of each name, by page and slot."""
    w = Window.partitionBy(name).orderBy(*order)
    return annotations.filter(F.col(name).isNotNull()).withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def with_names(annotations: DataFrame, *identity: str) -> DataFrame:
    """A name made from what identifies a row, where there is none; popups, widgets and links need none."""
    made = F.concat(F.lit("n-"), F.substring(F.sha2(F.to_json(F.struct(*identity)), 256), 1, 16))
    return annotations.withColumn("name", F.when(F.col("name").isNull() & ~F.col("subtype").isin("Popup", "Widget", "Link"), made).otherwise(F.col("name")))


def applied(changes: DataFrame, keys: list[str], seq: str, kind: str = "kind") -> DataFrame:
    """The state after a feed: of each key the last change, unless it is a removal; changes without a key are refused."""
    known = changes.filter(" and ".join(f"{k} is not null" for k in keys))
    last = known.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).filter("_nth = 1").drop("_nth")
    return last.filter(F.col(kind) != "removed")


def inverse(changes: DataFrame, kind: str = "kind", before: str = "before", after: str = "after") -> DataFrame:
    """What undoes changes: created and removed change places, and so do the states."""
    swapped = F.when(F.col(kind) == "created", F.lit("removed")).when(F.col(kind) == "removed", F.lit("created")).otherwise(F.col(kind))
    return changes.withColumns({kind: swapped, before: F.col(after), after: F.col(before)})


def undo_log(events: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Where the cursor stands after each of a log's edits, undos and redos, and how many revisions there are; an edit drops what could be redone.

    Both are a fold in order, done on each key's collected events.
    """
    start = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("revisions"))

    def step(s: Column, e: Column) -> Column:
        cursor = F.when(e["op"] == "edit", s["cursor"] + 1).when(e["op"] == "undo", F.greatest(s["cursor"] - 1, F.lit(0))).when(e["op"] == "redo", F.least(s["cursor"] + 1, s["revisions"])).otherwise(s["cursor"])
        return F.struct(cursor.alias("cursor"), F.when(e["op"] == "edit", s["cursor"] + 1).otherwise(s["revisions"]).alias("revisions"))

    log = events.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(seq, "op"))).alias("log"))
    return log.select(*keys, F.aggregate("log", start, step).alias("s")).select(*keys, "s.cursor", "s.revisions")


def widget_pages(widgets: DataFrame, pages: DataFrame, listed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Each widget's page: the one it names, else the first that lists it, else -1."""
    own = pages.select(doc, F.col("page_ref").alias("p"), F.col("page_index").alias("by_ref"))
    seen = listed.groupBy(doc, "widget").agg(F.min("page_index").alias("by_list"))
    return widgets.join(own.withColumnRenamed("p", "page_ref"), [doc, "page_ref"], "left").join(seen, [doc, "widget"], "left").withColumn("page_index", F.coalesce("by_ref", "by_list", F.lit(-1))).drop("by_ref", "by_list")


def group_visible(group: Column, base_off: Column, on: Column, off: Column) -> Column:
    """An optional group's state: off where listed off, else on where listed on, else as the base says."""
    return F.when(F.array_contains(off, group), F.lit(False)).when(F.array_contains(on, group), F.lit(True)).otherwise(~base_off)


def membership_visible(states: Column, policy: Column) -> Column:
    """AnyOn (the default), AllOn, AnyOff or AllOff over the groups' states; without groups it is visible."""
    return (
        F.when(F.size(states) == 0, F.lit(True))
        .when(policy == "AllOn", F.forall(states, lambda s: s))
        .when(policy == "AnyOff", F.exists(states, lambda s: ~s))
        .when(policy == "AllOff", F.forall(states, lambda s: ~s))
        .otherwise(F.exists(states, lambda s: s))
    )


def visibility(expression, states: dict[str, Column]) -> Column:
    """A nested list such as ["And", "a", ["Not", "b"]] as a column; what is malformed is visible."""
    if isinstance(expression, str):
        return states.get(expression, F.lit(True))
    if not isinstance(expression, list) or not expression or expression[0] not in ("And", "Or", "Not"):
        return F.lit(True)
    parts = [visibility(x, states) for x in expression[1:]]
    if not parts or (expression[0] == "Not" and len(parts) != 1):
        return F.lit(True)
    if expression[0] == "Not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if expression[0] == "And" else out | p
    return out


def visible_operations(ops: DataFrame, keys: list[str], index: str = "op_index") -> DataFrame:
    """Operations outside hidden marked content. ``hides`` tells whether a BDC opens hidden content; BMC and BDC nest, EMC closes.

    An operation is hidden while some open level hides: its nesting after hiding levels is a fold over
    the page in order.
    """
    def step(s: Column, o: Column) -> Column:
        opens, closes = o["operator"].isin("BDC", "BMC"), o["operator"] == "EMC"
        stack = F.when(opens, F.concat(s["stack"], F.array(F.coalesce(o["hides"], F.lit(False))))).when(closes & (F.size(s["stack"]) > 0), F.slice(s["stack"], F.lit(1), F.size(s["stack"]) - 1)).otherwise(s["stack"])
        hidden = F.exists(F.when(closes, s["stack"]).otherwise(stack), lambda h: h)
        return F.struct(stack.alias("stack"), F.when(hidden, s["kept"]).otherwise(F.concat(s["kept"], F.array(o[index]))).alias("kept"))

    start = F.struct(F.array().cast("array<boolean>").alias("stack"), F.array().cast("array<int>").alias("kept"))
    pages = ops.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, "operator", "hides"))).alias("all_ops"))
    kept = pages.select(*keys, F.explode(F.aggregate("all_ops", start, step)["kept"]).alias(index))
    return ops.join(kept, [*keys, index], "left_semi")


def filled(fields: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Fields with new values where these are valid: check boxes and radios take one of their states or Off, choices an export or a display (the export is kept), free text only where a combo allows it."""
    both = fields.join(values.select(*keys, F.col("value").alias("_new")), keys, "left")
    new, options = F.col("_new"), F.col("options")
    export = F.get(F.transform(F.filter(options, lambda o: (o["export"] == new) | (o["display"] == new)), lambda o: o["export"]), F.lit(0))
    state = F.when((new == "Off") | F.exists(options, lambda o: o["export"] == new), new)
    valid = (
        F.when(has(F.col("flags"), 1), F.lit(None))
        .when(F.col("type") == "text", new)
        .when(F.col("type").isin("check_box", "radio"), state)
        .when(F.col("type") == "combo", F.coalesce(export, F.when(has(F.col("flags"), EDIT), new)))
        .when(F.col("type") == "list", export)
    )
    return both.withColumn("refused", new.isNotNull() & valid.isNull()).withColumn("value", F.coalesce(valid, F.col("value"))).drop("_new")


def redacted(items: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose box no mark of their page meets.

    The rows of a small page meet all its marks at once; those of a large page are left at the first mark in a cell.
    """
    large, others = spatial.pages(keys, items, marks)
    (few, many), (some, most) = spatial.on_pages(items, large, keys, others), spatial.on_pages(marks, large, keys, others)
    columns, r = items.columns, F.col("rect")
    held = some.filter(spatial.is_box(r)).groupBy(*keys).agg(F.collect_list("rect").alias("_marks"))
    met = F.coalesce(spatial.is_box(r) & F.exists("_marks", lambda m: intersects(r, m)), F.lit(False))
    there = few.join(held.hint("merge"), keys, "left").withColumn("_met", F.max(met).over(Window.partitionBy(*keys, "item")))
    left = there.filter((~F.col("_met")) | F.col("item").isNull()).select(*columns)
    if large is None:
        return left
    hit = spatial.meeting(many.select(*keys, "item", "rect"), most, keys, r, r, spatial.fitted_grid(many))
    return left.unionByName(many.join(hit.select(*keys, "item").distinct().hint("merge"), [*keys, "item"], "left_anti"))


def document_context(pages: DataFrame, fields: DataFrame, doc: str) -> DataFrame:
    """A document's pages and fields as one nested value in JSON."""
    p = pages.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("page_index", "text"))).alias("pages"))
    f = fields.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("name", "type", "value"))).alias("fields"))
    return p.join(f, doc, "left").select(doc, F.to_json(F.struct("pages", F.coalesce("fields", F.array().cast("array<struct<name:string,type:string,value:string>>")).alias("fields"))).alias("context"))


def prompt_text(pages: DataFrame, doc: str) -> DataFrame:
    """A report of a document: how many pages, and each page's text."""
    parts = F.sort_array(F.collect_list(F.struct("page_index", "text")))
    told = pages.groupBy(doc).agg(parts.alias("p"))
    lines = F.transform("p", lambda x: F.concat(F.lit("Page "), (x["page_index"] + 1).cast("string"), F.lit(":\n"), F.coalesce(x["text"], F.lit(""))))
    return told.select(doc, F.concat(F.lit("Pages: "), F.size("p").cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("prompt"))
