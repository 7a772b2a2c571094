"""After text recognition: decoding of label scores, boxes from probability maps, filters; and ink slicing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import regions


def first_maximum(scores: Column) -> Column:
    """The 0-based place of the first largest value."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def winner_probability(scores: Column) -> Column:
    """The softmax probability of the largest value."""
    top = F.array_max(scores)
    return 1.0 / F.aggregate(F.transform(scores, lambda x: F.exp(x.cast("double") - top.cast("double"))), F.lit(0.0), lambda a, x: a + x)


def ctc_decode(steps: DataFrame, keys: list[str], dictionary: Column, step: str = "step", scores: str = "scores", softmax: bool = False) -> DataFrame:
    """Text and confidence of label scores by step: blanks (0) and repeats of the step before go; confidence is the mean of what stays, 1 for nothing."""
    w = Window.partitionBy(*keys).orderBy(step)
    told = steps.withColumn("_best", first_maximum(F.col(scores))).withColumn("_last", F.lag("_best").over(w))
    weight = winner_probability(F.col(scores)) if softmax else F.array_max(scores).cast("double")
    kept = (F.col("_best") != 0) & (F.col("_best") != F.coalesce(F.col("_last"), F.lit(-1)))
    sign = F.coalesce(F.get(dictionary, F.col("_best") - 1), F.lit(""))
    parts = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(kept, F.struct(F.col(step).alias("s"), sign.alias("t"))))).alias("p"), F.avg(F.when(kept, weight)).alias("c"))
    return parts.select(*keys, F.array_join(F.col("p.t"), "").alias("text"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("c", F.lit(1.0)))).alias("confidence"))


def tiled_text_boxes(pixels: DataFrame, keys: list[str], threshold: float = 0.3, least_side: int = 3, least_score: float = 0.5, unclip: float = 1.6, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """As ``text_boxes`` for maps of any size, given as pixels (x, y, prob) with their map's width and height: regions are found by tiles."""
    sizes = pixels.groupBy(*keys).agg(F.first("width").alias("_w"), F.first("height").alias("_h"))
    found = regions.regions(pixels.filter(F.col("prob") >= threshold).select(*keys, "x", "y", "prob"), keys, "prob").join(sizes, keys)
    wide, high = F.col("right") - F.col("left") + 1, F.col("bottom") - F.col("top") + 1
    score = F.col("total") / F.col("n")
    some = found.filter((wide >= least_side) & (high >= least_side) & (score >= least_score))
    middle_x, middle_y = (F.col("left") + F.col("right") + 1) / 2, (F.col("top") + F.col("bottom") + 1) / 2
    cut = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    w, h = F.col("_w") * scale_x, F.col("_h") * scale_y
    boxes = some.select(
        *keys, cut((middle_y - high / 2 * unclip) * scale_y, h).alias("top"), cut((middle_x - wide / 2 * unclip) * scale_x, w).alias("left"),
        cut((middle_y + high / 2 * unclip) * scale_y, h).alias("bottom"), cut((middle_x + wide / 2 * unclip) * scale_x, w).alias("right"), score.alias("score"),
    )
    order = Window.partitionBy(*keys).orderBy("top", "left", "bottom", "right", "score")
    return boxes.select(*keys, (F.row_number().over(order) - 1).alias("box_index"), "top", "left", "bottom", "right", "score")


def text_boxes(maps: DataFrame, keys: list[str], threshold: float = 0.3, least_side: int = 3, least_score: float = 0.5, unclip: float = 1.6, scale_x: float = 1.0, scale_y: float = 1.0) -> DataFrame:
    """Boxes of a probability map's (width, height, probs) 4-neighbour components, grown about their centres, in order of top, left."""
    types = maps.select(*keys).schema
    names = [f.name for f in types]

    def boxes(width: int, height: int, probs: np.ndarray) -> list[tuple]:
        grid = probs.reshape(height, width)
        left = grid >= threshold
        found = []
        for y, x in zip(*np.nonzero(left), strict=True):
            if not left[y, x]:
                continue
            left[y, x] = False
            queue, cells = [(y, x)], []
            while queue:
                cy, cx = queue.pop()
                cells.append((cy, cx))
                for ny, nx in ((cy - 1, cx), (cy + 1, cx), (cy, cx - 1), (cy, cx + 1)):
                    if 0 <= ny < height and 0 <= nx < width and left[ny, nx]:
                        left[ny, nx] = False
                        queue.append((ny, nx))
            ys, xs = [c[0] for c in cells], [c[1] for c in cells]
            score = float(np.mean([grid[c] for c in cells]))
            if max(xs) - min(xs) + 1 < least_side or max(ys) - min(ys) + 1 < least_side or score < least_score:
                continue
            middle_x, middle_y = (min(xs) + max(xs) + 1) / 2, (min(ys) + max(ys) + 1) / 2
            half_x, half_y = (max(xs) - min(xs) + 1) / 2 * unclip, (max(ys) - min(ys) + 1) / 2 * unclip
            cut = lambda v, most: min(max(v, 0.0), most)
            found.append((cut((middle_y - half_y) * scale_y, height * scale_y), cut((middle_x - half_x) * scale_x, width * scale_x), cut((middle_y + half_y) * scale_y, height * scale_y), cut((middle_x + half_x) * scale_x, width * scale_x), score))
        return sorted(found)

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            rows = [[*(r[k] for k in names), i, *b] for r in page.to_dict("records") for i, b in enumerate(boxes(int(r["width"]), int(r["height"]), np.asarray(r["probs"], dtype=float)))]
            yield pd.DataFrame(rows, columns=[*names, "box_index", "top", "left", "bottom", "right", "score"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types)
    return maps.select(*keys, "width", "height", "probs").mapInPandas(run, f"{schema}, box_index int, top double, left double, bottom double, right double, score double")


def confident_spans(spans: DataFrame, least: float) -> DataFrame:
    """Spans with some text, a box with an area, and confidence enough."""
    b = F.col("bounds")
    return spans.filter((F.col("confidence") >= least) & (F.btrim("text") != "") & (b["right"] > b["left"]) & (b["top"] > b["bottom"]))


def in_categories(items: DataFrame, category: str, wanted: list[str]) -> DataFrame:
    """Items of the wanted categories; those without one stay."""
    return items.filter(F.col(category).isNull() | F.col(category).isin(wanted))


def parsed_reply(reply: Column) -> Column:
    """Items (text, confidence, category, bbox) of a recognizer's JSON reply, whose keys vary."""
    items = F.from_json(reply, "array<struct<text:string,content:string,confidence:double,score:double,conf:double,category:string,type:string,bbox:array<double>,polygon:array<array<double>>>>")

    def one(x: Column) -> Column:
        xs, ys = F.transform(x["polygon"], lambda p: p[0]), F.transform(x["polygon"], lambda p: p[1])
        outline = F.when(x["polygon"].isNotNull(), F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
        return F.struct(F.coalesce(x["text"], x["content"]).alias("text"), F.coalesce(x["confidence"], x["score"], x["conf"], F.lit(1.0)).alias("confidence"), F.coalesce(x["category"], x["type"]).alias("category"), F.coalesce(x["bbox"], outline).alias("bbox"))

    return F.transform(items, one)


def janky(frames: DataFrame, build: str, raster: str, most_ms: float = 16.0) -> DataFrame:
    return frames.filter((F.col(build) > most_ms) | (F.col(raster) > most_ms))


def slice_stroke(points: list[tuple[float, float]], pressures: list[float] | None, path: list[tuple[float, float]], radius: float, least: float = 0.05) -> list[tuple[list, list | None]]:
    """What is left of a stroke after an eraser of some radius has gone along a path; cut points and pressures are interpolated, and shorter fragments go."""
    capsules = list(zip(path, path[1:], strict=False)) or [(path[0], path[0])]

    def inside(a, b, p, q) -> tuple[float, float] | None:
        """The stretch of the step from a to b within the capsule about p to q, found by halving on a convex distance."""
        def gap(t: float) -> float:
            x, y = a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t
            dx, dy = q[0] - p[0], q[1] - p[1]
            size = dx * dx + dy * dy
            s = 0.0 if size == 0 else max(0.0, min(1.0, ((x - p[0]) * dx + (y - p[1]) * dy) / size))
            return math.hypot(x - p[0] - s * dx, y - p[1] - s * dy) - radius

        low, high = 0.0, 1.0
        for _ in range(80):  # the distance to a convex body is convex along a line
            one, two = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, two) if gap(one) <= gap(two) else (one, high)
        best = (low + high) / 2
        if gap(best) > 0:
            return None

        def edge(out: float, within: float) -> float:
            if gap(out) <= 0:
                return out
            for _ in range(60):
                mid = (out + within) / 2
                out, within = (mid, within) if gap(mid) > 0 else (out, mid)
            return within

        return edge(0.0, best), edge(1.0, best)

    if len(points) == 1:
        gone = any(inside(points[0], points[0], p, q) for p, q in capsules)
        return [] if gone else [(points, pressures)]
    at = lambda i, t: tuple(points[i][k] + (points[i + 1][k] - points[i][k]) * t for k in (0, 1))
    force = lambda i, t: pressures[i] + (pressures[i + 1] - pressures[i]) * t if pressures else None
    out, held, held_force = [], [points[0]], [pressures[0] if pressures else None]

    def close() -> None:
        length = sum(math.dist(a, b) for a, b in zip(held, held[1:], strict=False))
        if len(held) > 1 and length > least:
            out.append((held.copy(), held_force.copy() if pressures else None))
        held.clear()
        held_force.clear()

    for i in range(len(points) - 1):
        cuts = sorted(c for p, q in capsules if (c := inside(points[i], points[i + 1], p, q)))
        joined: list[list[float]] = []
        for low, high in cuts:
            if joined and low <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], high)
            else:
                joined.append([low, high])
        for low, high in joined:
            if low > 0:
                held.append(at(i, low))
                held_force.append(force(i, low))
            close()
            if high < 1:
                held.append(at(i, high))
                held_force.append(force(i, high))
        if not joined or joined[-1][1] < 1:
            held.append(points[i + 1])
            held_force.append(pressures[i + 1] if pressures else None)
    close()
    return out


def sliced_ink(strokes: DataFrame, keys: list[str], path: list[tuple[float, float]], radius: float) -> DataFrame:
    """Strokes (points of x, y and pressures) after an eraser's sweep: a row for each fragment."""
    types = strokes.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                parts = slice_stroke([(p["x"], p["y"]) for p in r["points"]], r["pressures"], path, radius)
                rows += [{**{k: r[k] for k in keys}, "fragment": i, "points": [{"x": x, "y": y} for x, y in pts], "pressures": force} for i, (pts, force) in enumerate(parts)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(batch.schema.field(k) for k in keys), ("fragment", pa.int32()), ("points", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), ("pressures", pa.list_(pa.float64()))]))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in types)
    return strokes.select(*keys, "points", "pressures").mapInArrow(run, f"{schema}, fragment int, points array<struct<x:double,y:double>>, pressures array<double>")
