"""Edits of annotations, fields, content and selections as operations on tables, and the feeds and logs around them.

A table of annotations has its document, page, slot, subtype, rect (left, bottom, right, top), flags and
what else its kind needs. Nulls in flags count as 0; rows are told apart by the keys that a call names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import box, centroid, path_length, shoelace
from folioflow.operators import spatial
from folioflow.operators.annotations import HIDDEN, has

#: Kinds that can't be copied, and markups whose quads must be upright to be restyled (fixed values).
NEVER_COPIED, MARKUPS = ("Popup", "Link", "Widget"), ("Highlight", "Underline", "StrikeOut", "Squiggly")
#: Points by which each repeated paste is moved.
CASCADE = 12.0


# selections and filters


def toggled_range(df: DataFrame, page: str, selected: str, anchor: Column, index: Column) -> DataFrame:
    """Pages between the anchor and an index, both included and in either order, change their selection; null counts as not selected."""
    inside = F.col(page).between(F.least(anchor, index), F.greatest(anchor, index))
    return df.withColumn(selected, F.coalesce(F.col(selected), F.lit(False)) != F.coalesce(inside, F.lit(False)))


def on_states(widgets: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """Each field's states other than Off, once each, in the order of its widgets; nulls don't count."""
    listed = F.sort_array(F.collect_list(F.struct(order, state)))
    found = widgets.filter(F.col(state).isNotNull() & (F.col(state) != "Off")).groupBy(*keys).agg(listed.alias("s"))
    return found.select(*keys, F.array_distinct(F.col("s")[state]).alias("states"))


def sidebar_filter(df: DataFrame, wanted: str, title: str, detail: str) -> DataFrame:
    """Rows whose title or detail holds a text, whatever the case; an empty text keeps all."""
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(wanted.strip().lower())), F.lit(False))
    return df if not wanted.strip() else df.filter(holds(F.col(title)) | holds(F.col(detail)))


def check_marks(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """How many stamps named Check each document has."""
    return annotations.groupBy(*keys).agg(F.count_if((F.col("subtype") == "Stamp") & (F.col("stamp") == "Check")).alias("check_marks"))


def elements_at(elements: DataFrame, points: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The elements whose boxes hold each point, numbered from the topmost, which is the last drawn."""
    hit = spatial.at_places(points, elements.select(*keys, index, "rect"), keys)
    at = [*keys, "x", "y"]
    place = hit.select(*at, index, F.row_number().over(Window.partitionBy(*at).orderBy(F.desc(index))).alias("_rank"))
    # a point that comes n times has each element n times in a row
    times = points.groupBy(*points.columns).agg(F.count(F.lit(1)).cast("int").alias("_n")).withColumn("_nth", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    # an element's row goes through all points of its place: the next rows repeat its values, which files hold once
    met = place.join(times.hint("merge"), at)
    return met.select(*points.columns, index, ((F.col("_rank") - 1) * F.col("_n") + F.col("_nth")).alias("depth"))


def field_at(widgets: DataFrame, points: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """The field and widget of the topmost visible widget under each point that belongs to a field; points on none are left out."""
    shown = widgets.filter((F.col("subtype") == "Widget") & ~has(F.col("flags"), HIDDEN) & F.col("field").isNotNull())
    hit = spatial.at_points(points, shown.select(*keys, "rect", "field", "widget", slot), keys)
    return hit.groupBy(*points.columns).agg(F.max_by(F.struct("field", "widget"), slot).alias("f")).select(*points.columns, "f.field", "f.widget")


def can_restyle(a: DataFrame) -> Column:
    """Which annotations carry enough style to be drawn anew.

    Needs subtype, has_appearance, is_cloudy, n_points, n_strokes, upright_quads, standard_font and contents.
    """
    drawn = F.coalesce(a["has_appearance"], F.lit(False))
    points = F.coalesce(a["n_points"], F.lit(0))
    return (
        F.when(a["subtype"].isin("Square", "Circle"), drawn & ~F.coalesce(a["is_cloudy"], F.lit(False)))
        .when(a["subtype"] == "Line", drawn & (points == 2))
        .when(a["subtype"] == "PolyLine", drawn & (points >= 2))
        .when(a["subtype"] == "Polygon", drawn & (points >= 3))
        .when(a["subtype"] == "FreeText", drawn & F.coalesce(a["standard_font"], F.lit(False)))
        .when(a["subtype"] == "Ink", F.coalesce(a["n_strokes"], F.lit(0)) > 0)
        .when(a["subtype"].isin(*MARKUPS), F.coalesce(a["upright_quads"], F.lit(False)))
        .when(a["subtype"] == "Text", drawn)
        .when(a["subtype"] == "Stamp", drawn & (F.length(F.coalesce(a["contents"], F.lit(""))) > 0))
        .otherwise(F.lit(False))
    )


# geometry of new and changed annotations


def points_box(points: Column, pad: Column) -> Column:
    """The box of points (x, y), wider by ``pad`` on all sides; null without points."""
    of = lambda f, c: f(F.transform(points, lambda p: p[c]))
    return F.when(F.size(points) > 0, box(of(F.array_min, "x") - pad, of(F.array_min, "y") - pad, of(F.array_max, "x") + pad, of(F.array_max, "y") + pad))


def quads_box(rects: Column) -> Column:
    """The box around an array of boxes."""
    of = lambda f, c: f(F.transform(rects, lambda r: r[c]))
    return F.when(F.size(rects) > 0, box(of(F.array_min, "left"), of(F.array_min, "bottom"), of(F.array_max, "right"), of(F.array_max, "top")))


def quad_points(rects: Column) -> Column:
    """The eight numbers of each box in the order upper left, upper right, lower left, lower right."""
    return F.flatten(F.transform(rects, lambda r: F.array(r["left"], r["top"], r["right"], r["top"], r["left"], r["bottom"], r["right"], r["bottom"])))


def markups(selections: DataFrame, subtype: str, rects: str = "rects") -> DataFrame:
    """A text markup (Highlight, Underline, StrikeOut or Squiggly) for each row's boxes; rows without a box make none."""
    if subtype not in MARKUPS:
        raise ValueError(f"{subtype} is no text markup")
    some = selections.filter(F.coalesce(F.size(rects), F.lit(0)) > 0)
    return some.withColumns({"subtype": F.lit(subtype), "rect": quads_box(F.col(rects)), "quad_points": quad_points(F.col(rects))})


def shapes(rows: DataFrame, subtype: str, points: str = "points", width: str = "stroke_width") -> DataFrame:
    """Line, PolyLine, Polygon or Ink annotations from points; the box is theirs, wider by the pen's width. Rows with too few points make none.

    Square and Circle have two opposite corners, in any order, and lie within their box: it is not widened.
    """
    if subtype in ("Square", "Circle"):
        a, b = F.get(points, F.lit(0)), F.get(points, F.lit(1))
        rect = box(F.least(a["x"], b["x"]), F.least(a["y"], b["y"]), F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"]))
        return rows.filter(F.coalesce(F.size(points) == 2, F.lit(False))).withColumns({"subtype": F.lit(subtype), "rect": rect})
    least = {"Line": 2, "PolyLine": 2, "Polygon": 3, "Ink": 1}[subtype]
    enough = F.size(points) == 2 if subtype == "Line" else F.size(points) >= least
    return rows.filter(F.coalesce(enough, F.lit(False))).withColumns({"subtype": F.lit(subtype), "rect": points_box(F.col(points), F.col(width))})


def moved(rect: Column, dx: Column, dy: Column) -> Column:
    return box(rect["left"] + dx, rect["bottom"] + dy, rect["right"] + dx, rect["top"] + dy)


def fitted(points: Column, old: Column, new: Column) -> Column:
    """Points of one box carried to another, each side in proportion; a box without extent only moves."""
    along = lambda v, a, b, low, high: F.when(b > a, low + (v - a) / F.when(b > a, b - a) * (high - low)).otherwise(v - a + low)
    return F.transform(points, lambda p: F.struct(along(p["x"], old["left"], old["right"], new["left"], new["right"]).alias("x"), along(p["y"], old["bottom"], old["top"], new["bottom"], new["top"]).alias("y")))


def turned_box(rect: Column, angle: Column) -> Column:
    """The upright box around a rectangle turned by ``angle`` degrees about its centre."""
    a = F.radians(angle)
    c, s = F.abs(F.cos(a)), F.abs(F.sin(a))
    w, h = rect["right"] - rect["left"], rect["top"] - rect["bottom"]
    x, y, tw, th = (rect["left"] + rect["right"]) / 2, (rect["bottom"] + rect["top"]) / 2, w * c + h * s, w * s + h * c
    return box(x - tw / 2, y - th / 2, x + tw / 2, y + th / 2)


def measurements(rows: DataFrame, scale: Column, points: str = "points") -> DataFrame:
    """Distance, perimeter and area of each row's points in real units, and where a caption sits.

    A distance is between the first and the last of two points, a perimeter goes along all and an area
    is that of the closed shape; what has too few points is null. The caption of an area is at the mean
    point, else at the middle of the line between the ends.
    """
    p = F.col(points)
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    middle = F.struct(((first["x"] + last["x"]) / 2).alias("x"), ((first["y"] + last["y"]) / 2).alias("y"))
    return rows.withColumns(
        {
            "distance": F.when(F.size(p) == 2, path_length(p) * scale),
            "perimeter": F.when(F.size(p) >= 2, path_length(p) * scale),
            "area": F.when(F.size(p) >= 3, shoelace(p) * scale * scale),
            "anchor": F.when(F.size(p) >= 3, centroid(p)).when(F.size(p) >= 2, middle),
        }
    )


def calibrated(real: Column, drawn: Column) -> Column:
    """Real units for one point, from a reference whose real and drawn lengths are known; null for a drawn length of 0 or less."""
    return F.when(drawn > 0, real / F.when(drawn > 0, drawn))


def pasted(annotations: DataFrame, keys: list[str], page_box: Column, repeat: Column) -> DataFrame:
    """Copies of annotations on their page, moved down and right by 12 points for each repeat, the group kept within the page's box.

    Popups, links and widgets are never copied. A group that is wider or higher than the page starts at
    its left or bottom side.
    """
    some = annotations.filter(~F.coalesce(F.col("subtype"), F.lit("")).isin(*NEVER_COPIED))
    w = Window.partitionBy(*keys)
    side = lambda f, c: f(F.col(f"rect.{c}")).over(w)
    kept = lambda low, high, least, most: F.when((low < least) | (high - low > most - least), least - low).when(high > most, most - high).otherwise(F.lit(0.0))
    dx, dy = repeat * CASCADE, -repeat * CASCADE
    sides = {"_l": side(F.min, "left") + dx, "_r": side(F.max, "right") + dx, "_b": side(F.min, "bottom") + dy, "_t": side(F.max, "top") + dy}
    told = some.withColumns(sides)
    x = dx + kept(F.col("_l"), F.col("_r"), page_box["left"], page_box["right"])
    y = dy + kept(F.col("_b"), F.col("_t"), page_box["bottom"], page_box["top"])
    return told.withColumn("rect", moved(F.col("rect"), x, y)).drop(*sides)


def with_metadata(annotations: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Contents, author, name and flags set where an edit has them; an empty text removes, null leaves, and a widget's author is refused.

    The column ``refused`` tells of authors for widgets. Of several edits of one key, the last by ``seq`` counts for each column.
    """
    columns = ("contents", "author", "name", "flags")
    last = edits.groupBy(*keys).agg(*(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns))
    both = annotations.join(last, keys, "left")
    refused = (F.col("subtype") == "Widget") & F.col("_author").isNotNull()
    new = lambda c: F.when(F.col(f"_{c}").isNull(), F.col(c)).when(F.col(f"_{c}").cast("string") != "", F.col(f"_{c}"))
    told = {c: new(c) for c in columns} | {"author": F.when(refused, F.col("author")).otherwise(new("author")), "refused": F.coalesce(refused, F.lit(False))}
    return both.withColumns(told).drop(*(f"_{c}" for c in columns))


def removed(annotations: DataFrame, gone: DataFrame, keys: list[str], slot: str) -> DataFrame:
    """Without the slots that are gone; those above move down."""
    left = annotations.join(gone.select(*keys, slot).distinct(), [*keys, slot], "left_anti")
    return left.withColumn(slot, (F.row_number().over(Window.partitionBy(*keys).orderBy(slot)) - 1).cast("int"))


# fields


def added_fields(fields: DataFrame, new: DataFrame, doc: str, name: str = "name") -> DataFrame:
    """The fields and those of ``new`` whose names their document has neither before nor earlier among the new (by ``seq``); the others are refused.

    The column ``state`` says old, added or refused; empty and null names are refused.
    """
    once = new.withColumn("_nth", F.row_number().over(Window.partitionBy(doc, name).orderBy("seq")))
    known = once.join(fields.select(doc, name, F.lit(True).alias("_there")).distinct(), [doc, name], "left")
    fine = (F.col("_nth") == 1) & F.col("_there").isNull() & (F.length(F.coalesce(F.col(name), F.lit(""))) > 0)
    told = known.withColumn("state", F.when(fine, F.lit("added")).otherwise(F.lit("refused"))).drop("_nth", "_there", "seq")
    return fields.withColumn("state", F.lit("old")).unionByName(told, allowMissingColumns=True)


def renamed_fields(fields: DataFrame, renames: DataFrame, doc: str, name: str = "name") -> DataFrame:
    """Fields with the last part of their dotted name changed where no other field of the document has the new name; else they keep theirs."""
    both = fields.join(renames.select(doc, name, "new_part"), [doc, name], "left")
    above = F.regexp_replace(F.col(name), "[^.]*$", "")
    asked = both.withColumn("_new", F.when(F.length("new_part") > 0, F.concat(above, F.col("new_part"))))
    taken = fields.select(doc, F.col(name).alias("_new"), F.lit(True).alias("_taken")).distinct()
    rivals = F.count("_new").over(Window.partitionBy(doc, "_new"))
    told = asked.join(taken, [doc, "_new"], "left").withColumn("_rivals", rivals)
    fine = F.col("_new").isNotNull() & F.col("_taken").isNull() & (F.col("_rivals") == 1)
    return told.withColumn(name, F.when(fine, F.col("_new")).otherwise(F.col(name))).select(*fields.columns)


# content


def without_elements(ops: DataFrame, drops: DataFrame, keys: list[str], index: str = "op_index") -> DataFrame:
    """A page's operations without the ranges (first, last; both included) of dropped elements; unknown ranges drop nothing."""
    gone = drops.filter("first <= last").select(*keys, F.explode(F.sequence("first", "last")).alias(index)).distinct()
    return ops.join(gone, [*keys, index], "left_anti")


def replaced_text(ops: DataFrame, find: str, put: str, text: str = "text") -> DataFrame:
    """Shown strings with a text replaced, and in ``replaced`` how often; strings that Latin-1 can't hold afterwards stay as they are."""
    if not find:
        return ops.withColumn("replaced", F.lit(0))
    times = F.size(F.split(F.col(text), "\\Q" + find.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)) - 1
    new = F.replace(F.col(text), F.lit(find), F.lit(put))
    fine = (F.coalesce(times, F.lit(0)) > 0) & new.rlike("^[\\x00-\\xFF]*$")
    return ops.withColumns({"replaced": F.when(fine, times).otherwise(F.lit(0)), text: F.when(fine, new).otherwise(F.col(text))})


def stamped(ops: DataFrame, drawn: DataFrame, keys: list[str], index: str = "op_index") -> DataFrame:
    """A page's operations and after them those drawn on it, numbered on."""
    both = ops.withColumn("_late", F.lit(0)).unionByName(drawn.withColumn("_late", F.lit(1)))
    return both.withColumn(index, (F.row_number().over(Window.partitionBy(*keys).orderBy("_late", index)) - 1).cast("int")).drop("_late")


def with_info(info: Column, new: dict[str, Column]) -> Column:
    """A document's information (a map) with new entries: an empty text removes one, null leaves it."""
    names = [F.lit(k) for k in new]
    given = F.map_from_arrays(F.array(*names), F.array(*(v.cast("string") for v in new.values())))
    asked = F.map_filter(given, lambda k, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(info, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(asked, k))
    return F.map_concat(kept, F.map_filter(asked, lambda k, v: v != ""))


def text_layer(spans: DataFrame, least: float = 0.0) -> DataFrame:
    """An invisible run for each recognized span that is sure enough, with the size of its box; blank spans make none."""
    some = spans.filter((F.coalesce(F.col("confidence"), F.lit(1.0)) >= least) & (F.btrim("text") != ""))
    return some.withColumns({"render_mode": F.lit(3), "font_size": F.col("rect.top") - F.col("rect.bottom")})


def flattened(ops: DataFrame, annotations: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Operations with the appearances of visible annotations drawn after them in the order of slots, and the annotations that are left (popups, and what has no appearance)."""
    shown = F.col("appearance").isNotNull() & ~has(F.col("flags"), HIDDEN) & (F.col("subtype") != "Popup")
    drawn = annotations.filter(shown).select(*keys, F.col("slot").alias("op_index"), F.lit("Do").alias("operator"), F.col("appearance").alias("operand"))
    return stamped(ops.select(*keys, "op_index", "operator", "operand"), drawn, keys), annotations.filter(~F.coalesce(shown, F.lit(False)))


def reachable(edges: DataFrame, roots: DataFrame, most: int = 1000) -> DataFrame:
    """The objects that references lead to from the roots, themselves included; loops end. Raises where ``most`` steps don't suffice.

    What a step finds is written once; the steps are put together when they are read.
    """
    found = new = roots.select(F.col("object")).distinct().checkpoint()
    edge = edges.select(F.col("source").alias("object"), "target").checkpoint()
    for _ in range(most):
        new = edge.join(new, "object", "left_semi").select(F.col("target").alias("object")).filter("object is not null").distinct().join(found, "object", "left_anti").checkpoint()
        if new.isEmpty():
            return found
        found = found.unionByName(new)
    raise ValueError(f"references are more than {most} steps deep")


# pictures and runs


def figures(images: DataFrame, keys: list[str], index: str = "image_index", least: float = 24.0, most: int = 1000) -> DataFrame:
    """Pictures without rules and icons (a side under ``least``) and without those that cover over 0.9 of an earlier kept one of the same stream.

    Pairs that cover each other come from the spatial join. A picture stays as soon as all earlier ones that it
    covers are gone, and goes as soon as one of them stays; each round settles all that it can, and
    chains that need over ``most`` rounds raise.
    """
    r = F.col("rect")
    big = images.filter((r["right"] - r["left"] >= least) & (r["top"] - r["bottom"] >= least)).select(*keys, "stream", index, "rect")
    area = lambda r: (r["right"] - r["left"]) * (r["top"] - r["bottom"])
    mine = [*keys, "stream"]
    other = big.select(*mine, F.col(index).alias("_before"), F.col("rect").alias("_rect"))
    pairs = spatial.overlapping(big, other, mine, r, F.col("_rect"), spatial.fitted_grid(big)).filter(F.col("_before") < F.col(index))
    o = F.col("_rect")
    w, h = F.least(r["right"], o["right"]) - F.greatest(r["left"], o["left"]), F.least(r["top"], o["top"]) - F.greatest(r["bottom"], o["bottom"])
    pairs = pairs.filter(w * h / F.least(area(r), area(o)) > 0.9).select(*mine, index, "_before").checkpoint()
    gone, open_pairs = None, pairs
    for _ in range(most):
        if open_pairs.isEmpty():
            break
        # earlier pictures that cover no undecided one stay, so what covers them goes, and so does what they wait for
        waiting = open_pairs.select(*mine, F.col(index).alias("_before")).distinct()
        lost = open_pairs.join(waiting, [*mine, "_before"], "left_anti").select(*mine, index).distinct().checkpoint()
        gone = lost if gone is None else gone.unionByName(lost)
        left = open_pairs.join(lost, [*mine, index], "left_anti")
        open_pairs = left.join(lost.select(*mine, F.col(index).alias("_before")), [*mine, "_before"], "left_anti").checkpoint()
    else:
        raise ValueError(f"pictures cover one another over more than {most} steps")
    kept = images.join(big.select(*mine, index).distinct(), [*mine, index], "left_semi")
    return kept if gone is None else kept.join(gone, [*mine, index], "left_anti")


def image_places(images: DataFrame, blocks: DataFrame, keys: list[str], image: str = "image_index", block: str = "block_index") -> DataFrame:
    """Where each picture comes among a page's blocks: half a step behind the nearest block above with over a tenth of the narrower's width in common, else behind the last block whose top is not below the picture's middle, else first.

    Pictures of pages with few blocks meet them all. On other pages, each picture's box is placed once, however many
    pictures have it: blocks above are sought in a strip over it, eight times as high in each round, until one is found or the
    strip holds all. The fallback is a running maximum from the top, by slices of the page and then in a slice.
    """
    r, o = F.col("rect"), F.col("_r")
    mine = images.select(*keys, image, "rect")
    b = blocks.filter(spatial.is_box(F.col("rect"))).select(*keys, F.col(block).alias("_b"), F.col("rect").alias("_r"))
    large, others = spatial.pages(keys, b)
    (few, many), (there, beyond) = spatial.on_pages(b, large, keys, others), spatial.on_pages(mine, large, keys, others)
    known = r["bottom"].isNotNull() & r["top"].isNotNull()
    for c in keys:
        known = known & F.col(c).isNotNull()
    above = _shares_width(r, o) & (o["bottom"] >= r["top"]) & spatial.is_box(box(r["left"], r["top"], r["right"], r["top"]))
    best = F.min(F.when(above, F.struct((o["bottom"] - r["top"]).alias("gap"), F.col("_b").alias("b")))).alias("best")
    behind = F.max(F.when(o["top"] >= (r["bottom"] + r["top"]) / 2, F.col("_b"))).alias("fallback")
    held = there.filter(known).join(few.hint("merge"), keys, "left").groupBy(*keys, image).agg(best, behind)
    if large is not None:
        held = held.unionByName(_placed_by_strips(beyond, many, keys, image))
    return held.select(*keys, image, (F.coalesce(F.col("best.b"), F.col("fallback"), F.lit(-1)) + 0.5).alias("order_key"))


def _shares_width(r: Column, o: Column) -> Column:
    common = F.least(r["right"], o["right"]) - F.greatest(r["left"], o["left"])
    return common > 0.1 * F.least(r["right"] - r["left"], o["right"] - o["left"])


def _placed_by_strips(images: DataFrame, b: DataFrame, keys: list[str], image: str) -> DataFrame:
    """Of each image the nearest block above (``best``: gap and block) and the last one behind which it comes otherwise (``fallback``)."""
    r, o = F.col("rect"), F.col("_r")
    place = [*keys, "rect"]
    mine, small = spatial.kept(images.select(*place).distinct())
    grid = spatial.fitted_grid(b, "_r")
    low, high = mine.agg(F.min(r["top"])).first()[0], b.agg(F.max(o["bottom"])).first()[0]
    gap = o["bottom"] - r["top"]
    best, left, strip = None, mine, 8 * grid.height
    while low is not None and high is not None:
        edge = box(o["left"], o["bottom"], o["right"], o["bottom"])
        met = spatial.overlapping(left, b, keys, box(r["left"], r["top"], r["right"], r["top"] + strip), edge, grid, small and strip <= 512 * grid.height)
        met = met.filter(_shares_width(r, o) & (gap >= 0) & (gap <= strip))
        new = met.groupBy(*place).agg(F.min(F.struct(gap.alias("gap"), F.col("_b").alias("b"))).alias("best")).checkpoint()
        best = new if best is None else best.unionByName(new)
        if strip > high - low:
            break
        left, strip = left.join(new, place, "left_anti").checkpoint(), 8 * strip
    slice_of = lambda h: F.floor(F.greatest(F.lit(-spatial.FAR), F.least(F.lit(spatial.FAR), h / (64 * grid.height)))).cast("long")
    # of blocks whose tops are equal only the last counts
    tops = b.groupBy(*keys, o["top"].alias("_h")).agg(F.max("_b").alias("_last")).select("*", F.lit(0).alias("_kind"), F.lit(None).cast(mine.schema["rect"].dataType).alias("rect"))
    asked = mine.select(*keys, ((r["bottom"] + r["top"]) / 2).alias("_h"), F.lit(None).cast(b.schema["_b"].dataType).alias("_last"), F.lit(1).alias("_kind"), "rect")
    both = tops.unionByName(asked).withColumn("_slice", slice_of(F.col("_h")))
    above = Window.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    slices = both.groupBy(*keys, "_slice").agg(F.max("_last").alias("_most")).withColumn("_before", F.max("_most").over(above)).drop("_most")
    down = Window.partitionBy(*keys, "_slice").orderBy(F.desc("_h"), "_kind").rowsBetween(Window.unboundedPreceding, 0)
    behind = both.withColumn("_here", F.max("_last").over(down)).filter("_kind = 1").join(slices, [*keys, "_slice"])
    found = behind.groupBy(*place).agg(F.max(F.greatest("_here", "_before")).alias("fallback"))
    none = F.lit(None).cast(f"struct<gap: double, b: {b.schema['_b'].dataType.simpleString()}>")
    held = found.join(best, place, "left") if best is not None else found.withColumn("best", none)
    return images.join(held, place).groupBy(*keys, image).agg(F.min("best").alias("best"), F.max("fallback").alias("fallback"))


def run_box(matrix: Column, start: Column, end: Column) -> Column:
    """The upright box of a stretch of a run, from a quarter em below the line to three quarters above it."""
    corner = lambda x, y: F.struct((matrix["a"] * x + matrix["c"] * y + matrix["e"]).alias("x"), (matrix["b"] * x + matrix["d"] * y + matrix["f"]).alias("y"))
    low, high = F.lit(-0.25), F.lit(0.75)
    return points_box(F.array(corner(start, low), corner(end, low), corner(end, high), corner(start, high)), F.lit(0.0))


def range_boxes(runs: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """The boxes that a range of a page's text (start, end) covers: a row for each run that it meets, in proportion to its characters."""
    size = F.length("text")
    both = ranges.join(runs.filter(size > 0).select(*keys, "run_index", "text", "width", "matrix", "start_index"), keys)
    a, b = F.greatest("start", "start_index"), F.least("end", F.col("start_index") + size)
    at = lambda x: F.col("width") * (x - F.col("start_index")) / size
    return both.filter(a < b).select(*ranges.columns, "run_index", run_box(F.col("matrix"), at(a), at(b)).alias("rect"))


# text


#: Widths of Helvetica's characters from the space to the tilde, in thousandths of an em (fixed values of the font's public metrics).
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278, 556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778, 667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556, 556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]


def text_width(text: Column, size: float) -> Column:
    """The width of a text in Helvetica; characters without a known width count 556."""
    table = F.array(*(F.lit(w) for w in HELVETICA))
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), F.ascii)
    widths = F.transform(codes, lambda c: F.coalesce(F.get(table, F.when(c >= 32, c - 32).otherwise(F.lit(1000))), F.lit(556)))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, w: a + w) * (size / 1000)


def wrapped(text: Column, size: float, most: float) -> Column:
    """A text's lines of at most a width: words are added while they fit, a single longer word has its own line, and line breaks stay."""
    words = lambda paragraph: F.transform(F.split(paragraph, " "), lambda w: F.struct(w.alias("w"), text_width(w, size).alias("n")))
    space = HELVETICA[0] * size / 1000
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("n"))

    def step(s: Column, x: Column) -> Column:
        full = (s["line"] != "") & (s["n"] + space + x["n"] > most)
        return F.struct(
            F.when(full, F.concat(s["lines"], F.array(s["line"]))).otherwise(s["lines"]).alias("lines"),
            F.when((s["line"] == "") | full, x["w"]).otherwise(F.concat(s["line"], F.lit(" "), x["w"])).alias("line"),
            F.when((s["line"] == "") | full, x["n"]).otherwise(s["n"] + space + x["n"]).alias("n"),
        )

    return F.flatten(F.transform(F.split(text, "\n"), lambda p: F.aggregate(words(p), start, step, lambda s: F.concat(s["lines"], F.array(s["line"])))))


def asn1_time(text: Column, utc: Column) -> Column:
    """The instant of an ASN.1 time: two digits of a year from 50 on are of the last century; seconds may be missing, offsets count; null for what is none."""
    digits = F.regexp_extract(text, "^(\\d+)", 1)
    full = F.when(utc, F.concat(F.when(F.substring(digits, 1, 2) >= "50", F.lit("19")).otherwise(F.lit("20")), digits)).otherwise(digits)
    base = F.try_to_timestamp(F.concat(F.substring(full, 1, 12), F.when(F.length(full) >= 14, F.substring(full, 13, 2)).otherwise(F.lit("00"))), F.lit("yyyyMMddHHmmss"))
    zone = F.regexp_extract(text, "([+-]\\d{4})$", 1)
    minutes = F.when(zone != "", (F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, 4, 2).cast("int")) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)).otherwise(0)
    return F.when(F.length(full) >= 12, base - F.make_interval(mins=minutes))


def oid_text(numbers: Column) -> Column:
    """A dotted object identifier from its content bytes (whole numbers): groups of seven bits, the first two parts in one."""
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<bigint>").alias("parts"))

    def step(s: Column, b: Column) -> Column:
        held = s["held"] * 128 + b.bitwiseAND(F.lit(127))
        goes_on = b >= 128
        return F.struct(F.when(goes_on, held).otherwise(F.lit(0).cast("long")).alias("held"), F.when(goes_on, s["parts"]).otherwise(F.concat(s["parts"], F.array(held))).alias("parts"))

    parts = F.aggregate(numbers, start, step)["parts"]
    head = F.get(parts, F.lit(0))
    top = F.least(F.floor(head / 40), F.lit(2)).cast("long")
    return F.when(F.size(parts) > 0, F.array_join(F.concat(F.array(top, head - top * 40), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).cast("array<string>"), "."))


# certificates as tables


def issuers(certificates: DataFrame, cert: str = "cert") -> DataFrame:
    """Each certificate's issuer among the others: one whose subject is its issuer, one that verifies it first, then the least id; null where there is none.

    ``verifies`` lists the ids that a certificate's key verifies.
    """
    above = certificates.select(F.col(cert).alias("issuer_cert"), F.col("subject").alias("issuer"), "verifies")
    both = certificates.select(cert, "issuer").join(above, "issuer", "left").filter(F.col("issuer_cert").isNull() | (F.col("issuer_cert") != F.col(cert)))
    sure = F.coalesce(F.array_contains("verifies", F.col(cert)), F.lit(False))
    best = both.groupBy(cert).agg(F.min(F.struct(F.when(sure, 0).otherwise(1).alias("unsure"), "issuer_cert")).alias("b"))
    return certificates.select(cert).join(best, cert, "left").select(cert, F.col("b.issuer_cert").alias("issuer_cert"), (F.col("b.unsure") == 0).alias("verified"))


def signer_certificates(signers: DataFrame, certificates: DataFrame, doc: str) -> DataFrame:
    """The certificate with a signer's issuer and serial number, else the document's first, else null."""
    own = certificates.select(doc, "issuer", "serial", F.col("position").alias("_p"), F.col("cert").alias("_own"))
    exact = signers.join(own, [doc, "issuer", "serial"], "left").groupBy(*signers.columns).agg(F.min_by("_own", "_p").alias("_own"))
    first = certificates.groupBy(doc).agg(F.min_by("cert", "position").alias("_first"))
    return exact.join(first, doc, "left").withColumn("cert", F.coalesce("_own", "_first")).drop("_own", "_first")


# colours


def average_colour(stops: Column) -> Column:
    """The mean of an array of colours (r, g, b); null without one."""
    n = F.size(stops)
    mean = lambda c: F.round(F.aggregate(stops, F.lit(0.0), lambda a, s: a + s[c]) / n).cast("int").alias(c)
    return F.when(n > 0, F.struct(mean("r"), mean("g"), mean("b")))


def rgb_from_lab(lightness: Column, a: Column, b: Column) -> Column:
    """CIE Lab (white point D50) as sRGB whole numbers."""
    m = (lightness + 16) / 116
    turn = lambda t: F.when(t >= 6 / 29, t * t * t).otherwise((108 / 841) * (t - 4 / 29))
    x, y, z = 0.9642 * turn(m + a / 500), turn(m), 0.8249 * turn(m - b / 200)
    # from XYZ (D50) to linear sRGB (fixed values)
    linear = (3.1339 * x - 1.6169 * y - 0.4906 * z, -0.9785 * x + 1.9160 * y + 0.0333 * z, 0.0720 * x - 0.2290 * y + 1.4057 * z)
    shown = lambda v: F.when(v <= 0.0031308, 12.92 * v).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), 1 / 2.4) - 0.055)
    whole = lambda v: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), shown(v))) * 255).cast("int")
    return F.struct(*(whole(v).alias(n) for v, n in zip(linear, "rgb", strict=True)))


# queues, feeds, logs, snapshots


def served(requests: DataFrame, cancels: DataFrame, worker: str) -> DataFrame:
    """The order in which queued requests run: lowest priority first, then as submitted; those that a later cancel of their page and priority names are gone."""
    c = cancels.groupBy(worker, "page", "priority").agg(F.max("seq").alias("_cancelled"))
    left = requests.join(c, [worker, "page", "priority"], "left").filter(F.col("_cancelled").isNull() | (F.col("_cancelled") < F.col("seq"))).drop("_cancelled")
    return left.withColumn("place", F.row_number().over(Window.partitionBy(worker).orderBy("priority", "seq")))


def debounced(events: DataFrame, keys: list[str], time: str, idle: str, *ties: str) -> DataFrame:
    """The last event of each burst: no other follows within the idle time; ``fires`` is when that is known."""
    after = F.lead(time).over(Window.partitionBy(*keys).orderBy(time, *ties))
    fires = F.col(time) + F.expr(f"interval {idle}")
    return events.withColumn("_after", after).filter(F.col("_after").isNull() | (F.col("_after") >= fires)).drop("_after").withColumn("fires", fires)


def baseline(annotations: DataFrame) -> DataFrame:
    """All named annotations as created changes, to start a replica with."""
    return annotations.filter(F.length(F.coalesce(F.col("name"), F.lit(""))) > 0).withColumn("kind", F.lit("created"))


def change_feed(states: DataFrame, keys: list[str], revision: str, snapshot: str) -> DataFrame:
    """What changed from revision to revision: created, modified or removed, with the snapshot after it.

    ``states`` has a row for each item and revision in which it is there; revisions count on by one within
    the first of ``keys``. An item that is missing in a revision that its document has was removed in it.
    """
    doc = keys[0]
    w = Window.partitionBy(*keys).orderBy(revision)
    last = states.groupBy(doc).agg(F.max(revision).alias("_last"))
    told = states.withColumns({"_before": F.lag(revision).over(w), "_old": F.lag(snapshot).over(w), "_after": F.lead(revision).over(w)}).join(last, doc)
    r = F.col(revision)
    fresh = F.col("_before").isNull() | (F.col("_before") < r - 1)
    kind = F.when(fresh, F.lit("created")).when(~F.col(snapshot).eqNullSafe(F.col("_old")), F.lit("modified"))
    come = told.select(*keys, revision, kind.alias("kind"), snapshot).filter("kind is not null")
    gone = told.filter((F.col("_after").isNull() & (r < F.col("_last"))) | (F.col("_after") > r + 1)).select(*keys, (r + 1).alias(revision), F.lit("removed").alias("kind"), F.lit(None).cast(states.schema[snapshot].dataType).alias(snapshot))
    return come.unionByName(gone)


def log_events(lines: DataFrame, line: str = "line") -> DataFrame:
    """Lines of a performance log, ``[perf <ms>] <message>``: at_ms, message, event (its first word), page and took_ms where the message has them; other lines are left out."""
    got = lambda p, i=1: F.nullif(F.regexp_extract(F.col("message"), p, i), F.lit(""))
    some = lines.withColumns({"at_ms": F.regexp_extract(line, "\\[perf (\\d+)\\]", 1), "message": F.regexp_extract(line, "\\[perf \\d+\\] (.*)$", 1)}).filter("at_ms <> ''")
    return some.withColumns({"at_ms": F.col("at_ms").cast("long"), "event": got("^(\\S+)"), "page": got("(?:page|p)[ =]?(\\d+)").cast("int"), "took_ms": got("(\\d+(?:\\.\\d+)?) ?ms").cast("double")})


def snapshots(annotations: DataFrame, columns: list[str], version: int = 1) -> DataFrame:
    """A detached copy of each annotation as JSON with its version, without its name; popups, links and widgets have none."""
    some = annotations.filter(~F.coalesce(F.col("subtype"), F.lit("")).isin(*NEVER_COPIED))
    return some.withColumn("snapshot", F.to_json(F.struct(F.lit(version).alias("version"), *(c for c in columns if c != "name"))))


def from_snapshot(snapshot: Column, schema: str, version: int = 1) -> Column:
    """A snapshot's values, or null where it has another version or can't be read."""
    read = F.from_json(snapshot, f"version int, {schema}")
    return F.when(read["version"] == version, read)


def viewport_text(page: Column, dx: Column, dy: Column, zoom: Column) -> Column:
    return F.to_json(F.struct(page.cast("int").alias("page"), dx.cast("double").alias("dx"), dy.cast("double").alias("dy"), zoom.cast("double").alias("zoom")))


def viewport_read(text: Column) -> Column:
    """Page, offset and zoom; null for what is none, and a zoom of 0 or less is 1."""
    read = F.from_json(text, "page int, dx double, dy double, zoom double")
    zoom = F.when(F.coalesce(read["zoom"], F.lit(0.0)) > 0, read["zoom"]).otherwise(F.lit(1.0))
    return F.when(read["page"].isNotNull() & (read["page"] >= 0), F.struct(read["page"].alias("page"), F.coalesce(read["dx"], F.lit(0.0)).alias("dx"), F.coalesce(read["dy"], F.lit(0.0)).alias("dy"), zoom.alias("zoom")))


def read_through(wanted: DataFrame, store: DataFrame, keys: list[str], compute) -> DataFrame:
    """The stored rows of what is wanted, and those that ``compute`` (a function of a table) makes for the rest; ``cached`` tells which."""
    asked = wanted.distinct()
    held = store.join(asked.select(*keys), keys, "left_semi").withColumn("cached", F.lit(True))
    return held.unionByName(compute(asked.join(store.select(*keys), keys, "left_anti")).withColumn("cached", F.lit(False)))


def stored_bytes(entries: DataFrame, scope: list[str], size: str) -> DataFrame:
    return entries.groupBy(*scope).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("entries"))


def slowest(results: DataFrame, most: int, cost: str, *ties: str) -> DataFrame:
    """The ``most`` rows with the highest cost: the report is the limit."""
    return results.orderBy(F.desc_nulls_last(cost), *ties).limit(most)


def report_lines(totals: DataFrame, base: str, tool: str = "tool") -> DataFrame:
    """A line of a Markdown table for each tool: pages, milliseconds a page, and how many times as fast as the base."""
    per = F.col("ms") / F.col("pages")
    slow = totals.filter(F.col(tool) == base).agg(F.max(per)).scalar()
    times = F.when(per > 0, F.format_string("%.2fx", slow / per)).otherwise(F.lit("—"))
    return totals.select(tool, F.concat(F.lit("| "), F.col(tool), F.lit(" | "), F.col("pages").cast("string"), F.lit(" | "), F.format_string("%.1f", per), F.lit(" | "), F.coalesce(times, F.lit("—")), F.lit(" |")).alias("line"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Each row with its place in the whole order, from 0, in ``name``; the first of the order's columns is a whole number, nulls first.

    Rows are ordered within ranges of that column, at most 10,000 or so; a row for each range tells how many come before it.
    """
    ends = df.agg(F.min(order[0]).alias("low"), F.max(order[0]).alias("high")).first()
    width = max(10_000, (ends.high - ends.low) // 10_000 + 1) if ends.high is not None else 1
    # the range of nulls comes before that of the least value
    told = df.withColumn("_range", F.coalesce(F.floor(F.col(order[0]) / width), F.lit((ends.low or 0) // width - 1)))
    sizes = told.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_range", before.alias("_before")))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return told.withColumn("_nth", within).join(starts, "_range").withColumn(name, F.col("_before") + F.col("_nth") - 1).drop("_range", "_nth", "_before")


def next_rows(df: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """Each row with the row of the next greater key in ``next`` (a struct, null for the last); keys are whole numbers and unique.

    Rows are ordered within ranges of ``width`` keys, the least keys of ranges within ranges of ranges; only the
    last row of each range is joined with the row that it is followed by.
    """
    told = df.withColumn("_range", F.floor(F.col(key) / width))
    row = F.struct(*df.columns)
    heads = told.groupBy("_range").agg(F.min(key).alias("_head")).withColumn("_outer", F.floor(F.col("_range") / width))
    outer = heads.groupBy("_outer").agg(F.min("_head").alias("_head"))  # a row for width x width keys
    outer = outer.select("_outer", F.lead("_head").over(Window.orderBy("_outer")).alias("_beyond"))
    after = heads.withColumn("_next", F.lead("_head").over(Window.partitionBy("_outer").orderBy("_range"))).join(outer, "_outer")
    after = after.select("_range", F.coalesce("_next", "_beyond").alias("_next"))
    inner = told.withColumn("next", F.lead(row).over(Window.partitionBy("_range").orderBy(key)))
    last = inner.filter("next is null").join(after, "_range").join(df.select(F.col(key).alias("_next"), row.alias("_row")), "_next", "left")
    return inner.filter("next is not null").drop("_range").unionByName(last.withColumn("next", F.col("_row")).select(*df.columns, "next"))
