"""Points, boxes, matrices, ink and colours as column expressions. Page space is y-up; a box has left, bottom, right, top."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    return F.struct(left.alias("left"), bottom.alias("bottom"), right.alias("right"), top.alias("top"))


def normal_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def contains(b: Column, x: Column, y: Column) -> Column:
    """Closed on all sides."""
    return (x >= b["left"]) & (x <= b["right"]) & (y >= b["bottom"]) & (y <= b["top"])


def intersects(a: Column, b: Column) -> Column:
    return (a["left"] <= b["right"]) & (b["left"] <= a["right"]) & (a["bottom"] <= b["top"]) & (b["bottom"] <= a["top"])


def intersection(a: Column, b: Column) -> Column:
    """The common box, or null where there is none with an area."""
    found = box(F.greatest(a["left"], b["left"]), F.greatest(a["bottom"], b["bottom"]), F.least(a["right"], b["right"]), F.least(a["top"], b["top"]))
    return F.when((found["left"] < found["right"]) & (found["bottom"] < found["top"]), found)


def page_box(media: Column, crop: Column) -> Column:
    """The crop box within the media box, which is Letter where missing; the media box where they don't meet."""
    whole = F.coalesce(media, box(F.lit(0.0), F.lit(0.0), F.lit(612.0), F.lit(792.0)))
    return F.coalesce(intersection(F.coalesce(crop, whole), whole), whole)


def rotation(degrees: Column) -> Column:
    """In [0, 360), down to a multiple of 90."""
    turned = F.pmod(degrees, F.lit(360))
    return turned - F.pmod(turned, F.lit(90))


def box_union(left: Column, bottom: Column, right: Column, top: Column) -> Column:
    """Aggregate: the bounding box."""
    return box(F.min(left), F.min(bottom), F.max(right), F.max(top))


def shoelace(points: Column) -> Column:
    """The area of a polygon from its points (x, y); 0 for fewer than three."""
    n = F.size(points)
    after = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2)


def path_length(points: Column) -> Column:
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def centroid(points: Column) -> Column:
    mean = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k]) / F.size(points)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def segment_distance(px: Column, py: Column, a: Column, b: Column) -> Column:
    """From a point to the segment from a to b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    size = dx * dx + dy * dy
    t = F.when(size == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - a["x"]) * dx + (py - a["y"]) * dy) / size)))
    return F.hypot(px - (a["x"] + t * dx), py - (a["y"] + t * dy))


def ink_hit(strokes: Column, width: Column, px: Column, py: Column, tolerance: float = 4.0) -> Column:
    """Whether a point is within ``tolerance`` and half the pen's width of a stroke's centre line; a single point is a dot."""
    reach = F.lit(tolerance) + width / 2
    near = lambda s: F.exists(F.zip_with(s, F.concat(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, -1, 1)), lambda a, b: segment_distance(px, py, a, b)), lambda d: d <= reach)
    return F.exists(strokes, lambda s: (F.size(s) > 0) & near(s))


def matrix_apply(m: Column, x: Column, y: Column) -> Column:
    """A point through a matrix a b c d e f."""
    return F.struct((m["a"] * x + m["c"] * y + m["e"]).alias("x"), (m["b"] * x + m["d"] * y + m["f"]).alias("y"))


def matrix_product(m: Column, n: Column) -> Column:
    """First m, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"),
        (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"), (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"),
        (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def matrix_inverse(m: Column) -> Column:
    """Null for a matrix without one."""
    det = m["a"] * m["d"] - m["b"] * m["c"]
    part = lambda x, name: (x / det).alias(name)
    found = F.struct(
        part(m["d"], "a"), part(-m["b"], "b"), part(-m["c"], "c"), part(m["a"], "d"),
        part(m["c"] * m["f"] - m["d"] * m["e"], "e"), part(m["b"] * m["e"] - m["a"] * m["f"], "f"),
    )
    return F.when(det != 0, found)


def matrix_scale(m: Column) -> Column:
    """The size of a unit square's side after the matrix."""
    return F.sqrt(F.abs(m["a"] * m["d"] - m["b"] * m["c"]))


def to_view(x: Column, y: Column, width: Column, height: Column, turn: Column) -> Column:
    """A page point (y-up) in a view (y-down) turned clockwise by a multiple of 90 degrees."""
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.when(turn == 90, point(y, x)).when(turn == 180, point(width - x, y)).when(turn == 270, point(height - y, width - x)).otherwise(point(x, height - y))


def ink_width(width: Column, pressure: Column) -> Column:
    return width * (0.4 + 1.2 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), pressure)))


def smooth_controls(points: Column) -> Column:
    """The control points of the Catmull-Rom curve through some points, a pair for each step; ends count twice."""
    n = F.size(points)
    at = lambda i: F.get(points, F.greatest(F.lit(0), F.least(i, n - 1)))
    def pair(i: Column) -> Column:
        a, b, c, d = at(i - 1), at(i), at(i + 1), at(i + 2)
        point = lambda p, q, r, s: F.struct((p["x"] + s * (q["x"] - r["x"]) / 6).alias("x"), (p["y"] + s * (q["y"] - r["y"]) / 6).alias("y"))
        return F.struct(point(b, c, a, 1).alias("first"), point(c, d, b, -1).alias("second"))
    return F.when(n < 2, F.array().cast("array<struct<first:struct<x:double,y:double>,second:struct<x:double,y:double>>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), pair))


def rgb_from_gray(g: Column) -> Column:
    v = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), g)) * 255).cast("int")
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"))


def rgb_from_cmyk(c: Column, m: Column, y: Column, k: Column) -> Column:
    part = lambda v: F.round((1 - F.least(F.lit(1.0), v + k)) * 255).cast("int")
    return F.struct(part(c).alias("r"), part(m).alias("g"), part(y).alias("b"))
