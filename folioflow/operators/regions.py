"""Connected regions of cells (x, y) of any number of pages: tiles are labelled by themselves and joined along their borders.

A tile's cells are labelled in one task of bounded size; what leaves it is a row for each of its parts and
its border cells. Parts that touch across a border are linked by an equality join of cells, and the
links' components are found by taking the least neighbour and jumping along pointers. So a page of any
size is many tasks, and what the steps between tiles handle are borders, not areas.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a tile.
TILE = 512


def labelled(mask: np.ndarray) -> np.ndarray:
    """For each cell of a mask the least place (row by row) of its part, -1 outside: union-find over runs of cells in rows."""
    flat = np.flatnonzero(mask.ravel())
    out = np.full(mask.size, -1, dtype=np.int64)
    if not len(flat):
        return out.reshape(mask.shape)
    width = mask.shape[1]
    fresh = np.append(True, (np.diff(flat) != 1) | (flat[1:] % width == 0))
    run = np.cumsum(fresh) - 1
    parent = list(range(int(run[-1]) + 1))
    numbers = np.full(mask.size, -1, dtype=np.int64)
    numbers[flat] = run
    above = flat[flat >= width] - width
    met = numbers[above] >= 0
    pairs = np.unique(np.stack([numbers[above[met]], numbers[above[met] + width]], axis=1), axis=0) if met.any() else np.zeros((0, 2), dtype=np.int64)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(i) for i in range(len(parent))])
    out[flat] = flat[fresh][roots[run]]
    return out.reshape(mask.shape)


def joined(links: DataFrame, keys: list[str], most: int = 64) -> DataFrame:
    """keys, part and label: of linked parts (part, other) the least that each is connected with; parts without links are missing."""
    same = [*keys, "part"]
    both = links.select(*keys, "part", "other").unionByName(links.select(*keys, F.col("other").alias("part"), F.col("part").alias("other"))).distinct().checkpoint()
    now = both.groupBy(*same).agg(F.least(F.min("other"), F.first("part")).alias("label")).checkpoint()
    for _ in range(most):
        near = both.join(now.select(*keys, F.col("part").alias("other"), "label"), [*keys, "other"]).groupBy(*same).agg(F.min("label").alias("_near"))
        spread = now.join(near, same).select(*same, F.least("label", "_near").alias("_to"), F.col("label").alias("_was"))
        jumped = spread.join(now.select(*keys, F.col("part").alias("_to"), F.col("label").alias("_far")), [*keys, "_to"])
        after = jumped.select(*same, F.least("_to", "_far").alias("label"), "_was").checkpoint()
        now = after.drop("_was")
        if after.filter("label <> _was").isEmpty():
            return now
    raise ValueError(f"links are not settled after {most} rounds")


def regions(cells: DataFrame, keys: list[str], value: str | None = None, tile: int | None = None) -> DataFrame:
    """keys, region (its least cell, row by row, as y * 2**32 + x), left, top, right, bottom (cells, the last included), n and total of ``value``.

    Cells are whole numbers from 0 under 2**31, sides that touch join them, and a cell that comes again counts once, with
    its greatest value. Rows with nulls in place or keys take no part.
    """
    tile = tile or TILE
    one = F.coalesce(F.max(value).cast("double"), F.lit(0.0)) if value else F.lit(0.0)
    fine = F.col("x").isNotNull() & F.col("y").isNotNull()
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    placed = cells.filter(fine).groupBy(*keys, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(one.alias("v"))
    placed = placed.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)
    fields = [*keys, "part", "x", "y", "left", "top", "right", "bottom", "n", "total"]

    def label(group: pa.Table) -> pa.Table:
        x, y, v = (group[c].to_numpy() for c in ("x", "y", "v"))
        x0, y0 = x[0] // tile * tile, y[0] // tile * tile
        mask = np.zeros((tile, tile), dtype=bool)
        mask[y - y0, x - x0] = True
        place = labelled(mask)[y - y0, x - x0]
        own = ((place // tile + y0) << 32) | (place % tile + x0)
        names, at = np.unique(own, return_inverse=True)
        sides = {}
        for name, op, values in (("left", np.minimum, x), ("top", np.minimum, y), ("right", np.maximum, x), ("bottom", np.maximum, y)):
            sides[name] = np.full(len(names), -1 if op is np.maximum else 1 << 40, dtype=np.int64)
            op.at(sides[name], at, values)
        edge = (x == x0) | (y == y0) | (x == x0 + tile - 1) | (y == y0 + tile - 1)
        border, blank = int(edge.sum()), np.zeros(int(edge.sum()), dtype=np.int64)
        columns = {
            "part": np.concatenate([names, own[edge]]), "x": np.concatenate([np.full(len(names), -1), x[edge]]), "y": np.concatenate([np.full(len(names), -1), y[edge]]),
            **{k: np.concatenate([s, blank]) for k, s in sides.items()}, "n": np.concatenate([np.bincount(at), blank]), "total": np.concatenate([np.bincount(at, weights=v), blank.astype(float)]),
        }
        told = {k: pa.array([group[k][0].as_py()] * (len(names) + border), group.schema.field(k).type) for k in keys}
        return pa.table(told | {k: pa.array(c) for k, c in columns.items()}).select(fields)

    numbers = ", ".join(f"{c} long" for c in fields[len(keys) : -1])
    made = placed.groupBy(*keys, "tx", "ty").applyInArrow(label, f"{kinds}, {numbers}, total double").checkpoint()
    parts, border = made.filter("x < 0"), made.filter("x >= 0").select(*keys, "part", "x", "y")
    beside = border.select(*keys, F.col("part").alias("other"), "x", "y")
    # only cells on either side of a border between tiles can link parts of two
    right = border.filter(F.col("x") % tile == tile - 1).withColumn("x", F.col("x") + 1).join(beside, [*keys, "x", "y"])
    down = border.filter(F.col("y") % tile == tile - 1).withColumn("y", F.col("y") + 1).join(beside, [*keys, "x", "y"])
    links = right.unionByName(down).select(*keys, "part", "other").distinct()
    known = parts.join(joined(links, keys), [*keys, "part"], "left").withColumn("region", F.coalesce("label", "part"))
    least, greatest = ("left", "top"), ("right", "bottom")
    return known.groupBy(*keys, "region").agg(*(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in greatest), F.sum("n").alias("n"), F.sum("total").alias("total"))
