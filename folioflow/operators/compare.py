"""Comparison: token differences, hunks, page pairs, revisions, pixels and regions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import PYTHON_SPACES, label
from folioflow.operators import regions


#: Pairs of texts whose stretches are held at once in a task.
PAIRS = 64


def lcs_segments(a: list[str], b: list[str]) -> list[tuple[str, list[str], list[str]]]:
    """Equal, deleted and inserted stretches by longest common subsequence; where both go, tokens are deleted first.

    Common ends are set aside, then one row of the table at a time is kept in numpy with the choices of
    each cell in bits.
    """
    n, m = len(a), len(b)
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    x, y = a[head:], b[head:]
    codes = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    u, v = np.array([codes[t] for t in x], dtype=np.int64), np.array([codes[t] for t in y], dtype=np.int64)
    below = np.zeros(len(v) + 1, dtype=np.int32)
    drop = np.zeros((len(u), len(v)), dtype=bool)
    for i in range(len(u) - 1, -1, -1):
        equal = u[i] == v
        best = np.where(equal, below[1:] + 1, below[:-1])
        row = np.append(np.maximum.accumulate(best[::-1])[::-1], 0).astype(np.int32)
        drop[i] = below[:-1] >= row[1:]
        below = row
    out: list[tuple[str, list[str], list[str]]] = [("equal", a[:head], a[:head])] if head else []
    gone: list[str] = []
    came: list[str] = []

    def flush() -> None:
        if gone:
            out.append(("deleted", gone.copy(), []))
        if came:
            out.append(("inserted", [], came.copy()))
        gone.clear()
        came.clear()

    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            flush()
            if out and out[-1][0] == "equal":
                out[-1][1].append(x[i])
                out[-1] = ("equal", out[-1][1], out[-1][1])
            else:
                part = [x[i]]
                out.append(("equal", part, part))
            i, j = i + 1, j + 1
        elif drop[i, j]:
            gone.append(x[i])
            i += 1
        else:
            came.append(y[j])
            j += 1
    gone += x[i:]
    came += y[j:]
    flush()
    return out


def token_diff(pairs: DataFrame, key: str, before: str = "before", after: str = "after") -> DataFrame:
    """(key, seg_index, kind, before, after): the stretches of tokens of each pair of texts. The time is the product of the lengths, a row at a time; null texts are empty."""
    kind = pairs.schema[key].dataType.simpleString()
    words = re.compile(f"[^{PYTHON_SPACES}]+").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, PAIRS) for whole in batches for at in range(0, whole.num_rows, PAIRS)):
            rows = [(k, i, *s) for k, a, b in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True) for i, s in enumerate(lcs_segments(words(a or ""), words(b or "")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows]), pa.array([list(r[3]) for r in rows], pa.list_(pa.string())), pa.array([list(r[4]) for r in rows], pa.list_(pa.string()))], names=["key", "seg_index", "kind", "before", "after"])

    return pairs.select(key, before, after).mapInArrow(run, f"key {kind}, seg_index int, kind string, before array<string>, after array<string>").withColumnRenamed("key", key)


def hunks(segments: DataFrame, key: str) -> DataFrame:
    """Neighbouring stretches that aren't equal as one change with a label."""
    w = Window.partitionBy(key).orderBy("seg_index").rowsBetween(Window.unboundedPreceding, 0)
    changed = segments.withColumn("part", F.sum((F.col("kind") == "equal").cast("int")).over(w)).filter("kind <> 'equal'")
    both = changed.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("seg_index", "before", "after"))).alias("s"))
    gone, came = F.array_join(F.flatten(F.col("s.before")), " "), F.array_join(F.flatten(F.col("s.after")), " ")
    told = both.select(key, "part", gone.alias("before"), came.alias("after"))
    kind = F.when(F.col("before") == "", F.lit("insertion")).when(F.col("after") == "", F.lit("deletion")).otherwise(F.lit("replacement"))
    name = F.when(F.col("before") == "", label(F.col("after"))).when(F.col("after") == "", label(F.col("before"))).otherwise(F.concat(label(F.col("before")), F.lit(" → "), label(F.col("after"))))
    order = Window.partitionBy(key).orderBy("part")
    return told.select(key, (F.row_number().over(order) - 1).cast("int").alias("hunk_index"), kind.alias("kind"), "before", "after", name.alias("label"))


def page_pairs(before: DataFrame, after: DataFrame, keys: list[str], page: str) -> DataFrame:
    """Pages of two revisions by their place: matched, inserted or removed."""
    a, b = before.select(*keys, F.col(page).alias("before_page"), F.col(page)), after.select(*keys, F.col(page).alias("after_page"), F.col(page))
    kind = F.when(F.col("before_page").isNull(), F.lit("inserted")).when(F.col("after_page").isNull(), F.lit("removed")).otherwise(F.lit("matched"))
    return a.join(b, [*keys, page], "full_outer").select(*keys, "before_page", "after_page", kind.alias("kind"))


def revision_diff(before: DataFrame, after: DataFrame, name: str, values: list[str]) -> DataFrame:
    """(name, kind): created, removed or modified items of two revisions, matched by name; equal ones are missing. A row without a name is matched by what it holds."""
    body = lambda df: df.select(F.coalesce(F.col(name).cast("string"), F.concat(F.lit("#"), F.sha2(F.to_json(F.struct(*values)), 256))).alias("item"), F.sha2(F.to_json(F.struct(*values)), 256).alias("held"), F.lit(1).alias("there"))
    a, b = body(before), body(after)
    both = a.select("item", F.col("held").alias("old"), F.col("there").alias("was")).join(b.select("item", F.col("held").alias("new"), F.col("there").alias("is")), "item", "full_outer")
    kind = F.when(F.col("was").isNull(), F.lit("created")).when(F.col("is").isNull(), F.lit("removed")).when(F.col("old") != F.col("new"), F.lit("modified"))
    return both.select(F.col("item").alias("name"), kind.alias("kind")).filter("kind is not null")


def pixel_class(before: Column, after: Column, tolerance: int = 8, ink: int = 250) -> Column:
    """Of two pixels (arrays of channels): removed, added or changed; null where no channel differs by over the tolerance."""
    differs = F.array_max(F.zip_with(before, after, lambda x, y: F.abs(x - y))) > tolerance
    inked = lambda p: F.exists(p, lambda x: x < ink)
    return F.when(differs, F.when(inked(before) & ~inked(after), F.lit("removed")).when(inked(after) & ~inked(before), F.lit("added")).otherwise(F.lit("changed")))


def changed_regions(pixels: DataFrame, keys: list[str], width: str, height: str, cell: int = 24) -> DataFrame:
    """Boxes of changed pixels (x, y): those of cells that touch by a side are one region, cut to the picture; in order of top, left.

    Pixels are first reduced to cells, whose regions are found by tiles.
    """
    cells = pixels.select(*keys, width, height, F.floor(F.col("x") / cell).cast("int").alias("x"), F.floor(F.col("y") / cell).cast("int").alias("y"))
    sizes = cells.groupBy(*keys).agg(F.first(width).alias("_w"), F.first(height).alias("_h"))
    found = regions.regions(cells.select(*keys, "x", "y"), keys).join(sizes, keys)
    boxes = found.select(
        *keys, (F.col("top") * cell).cast("int").alias("top"), (F.col("left") * cell).cast("int").alias("left"),
        F.least(F.col("_h"), (F.col("bottom") + 1) * cell).cast("int").alias("bottom"), F.least(F.col("_w"), (F.col("right") + 1) * cell).cast("int").alias("right"),
    )
    order = Window.partitionBy(*keys).orderBy("top", "left", "bottom", "right")
    return boxes.select(*keys, (F.row_number().over(order) - 1).alias("region_index"), "top", "left", "bottom", "right")
