"""Layout of text runs: separators, visual lines, reading order of columns, paragraphs."""

from __future__ import annotations

import re
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import box, matrix_apply, matrix_scale
from folioflow.operators import spatial


def separator(previous: Column, width: Column, matrix: Column) -> Column:
    """Between two runs: a line break when they differ by over half an em in height, a space when by over 0.15 em along, else nothing."""
    em = matrix_scale(previous)
    end = matrix_apply(previous, width, F.lit(0.0))
    return (
        F.when(previous.isNull(), F.lit(""))
        .when(em <= 0, F.lit(" "))
        .when(F.abs(matrix["f"] - end["y"]) > 0.5 * em, F.lit("\n"))
        .when(F.abs(matrix["e"] - end["x"]) > 0.15 * em, F.lit(" "))
        .otherwise(F.lit(""))
    )


def page_text(runs: DataFrame, keys: list[str], index: str = "run_index") -> DataFrame:
    """Runs (text, width, matrix) with the separator before each and where each starts in its page's text."""
    w = Window.partitionBy(*keys).orderBy(index)
    told = runs.withColumn("separator", separator(F.lag("matrix").over(w), F.lag("width").over(w), F.col("matrix")))
    size = F.length("separator") + F.length("text")
    return told.withColumn("start_index", (F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")).cast("int"))


def in_visual_order(df: DataFrame, keys: list[str], top: str, left: str, *ties: str) -> DataFrame:
    """Items numbered from 1 in ``place``: from the top, then from the left, then by ``ties``."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(top), left, *ties)))


def joined_pages(runs: DataFrame, keys: list[str], index: str = "run_index") -> DataFrame:
    """Each page's text."""
    told = page_text(runs, keys, index).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, F.concat("separator", "text").alias("part")))).alias("parts"))
    return told.select(*keys, F.array_join(F.col("parts.part"), "").alias("text"))


def text_in_box(runs: DataFrame, keys: list[str], area: Column, index: str = "run_index") -> DataFrame:
    """The runs whose centres lie in a box, in document order, joined by one space."""
    x, y = (F.col("bounds.left") + F.col("bounds.right")) / 2, (F.col("bounds.bottom") + F.col("bounds.top")) / 2
    inside = (x >= area["left"]) & (x <= area["right"]) & (y >= area["bottom"]) & (y <= area["top"])
    held = runs.filter(inside).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(index, "text"))).alias("parts"))
    return held.select(*keys, F.array_join(F.col("parts.text"), " ").alias("text"))


def texts_in_boxes(runs: DataFrame, areas: DataFrame, keys: list[str], area: str = "area", index: str = "run_index") -> DataFrame:
    """For each area of a page the text of the runs whose centres lie in it, in document order, joined by one space; areas without runs are left out."""
    x, y = (F.col("bounds.left") + F.col("bounds.right")) / 2, (F.col("bounds.bottom") + F.col("bounds.top")) / 2
    centres = runs.select(*keys, index, "text", x.alias("x"), y.alias("y"))
    # equal areas have equal texts: each is put together once
    places, few = spatial.kept(areas.select(*keys, area).distinct())
    here = box(F.col("x"), F.col("y"), F.col("x"), F.col("y"))
    met = spatial.overlapping(places, centres, keys, F.col(area), here, spatial.fitted_grid(places, area), few)
    held = met.groupBy(*keys, area).agg(F.sort_array(F.collect_list(F.struct(index, "text"))).alias("parts"))
    texts = held.select(*keys, area, F.col("parts.text").alias("_t"))
    # an area that comes n times has each text n times
    times = areas.groupBy(*areas.columns).agg(F.count(F.lit(1)).cast("int").alias("_n")).join(texts.hint("merge"), [*keys, area])
    each = F.when(F.col("_n") == 1, F.col("_t")).otherwise(F.flatten(F.transform("_t", lambda t: F.array_repeat(t, F.col("_n")))))
    return times.select(*areas.columns, F.array_join(each, " ").alias("text"))


def nearest_run(runs: DataFrame, points: DataFrame, keys: list[str], tolerance: float = float("inf"), index: str = "run_index") -> DataFrame:
    """For each point of a page the run with the nearest box, the first of equals; -1 beyond the tolerance."""
    found = spatial.nearest(points, runs, keys, index, "bounds", tolerance)
    return found.select(*points.columns, F.coalesce(index, F.lit(-1)).alias("run"))


_LIST = re.compile(r"^\s*([•◦▪‣*–-]|\(?([0-9]{1,3}|[A-Za-z])[.)])\s+")


def visual_lines(runs: list[dict]) -> list[dict]:
    """Runs of a page (text, left, bottom, right, top, size) in lines: bands by height, each cut at wide gaps."""
    bands: list[list[dict]] = []
    alive = [r | {"size": max(1.0, r["size"]), "middle": (r["bottom"] + r["top"]) / 2} for r in runs if r["text"].strip()]
    for run in sorted(alive, key=lambda r: (-r["middle"], r["left"])):
        for band in bands:
            mean = sum(r["middle"] for r in band) / len(band)
            if abs(run["middle"] - mean) <= max(2.0, 0.55 * median([*(r["size"] for r in band), run["size"]])):
                band.append(run)
                break
        else:
            bands.append([run])
    lines = []
    for band in bands:
        held: list[dict] = []
        for run in sorted(band, key=lambda r: r["left"]):
            if held and run["left"] - held[-1]["right"] > max(36.0, 4 * median([*(r["size"] for r in held), run["size"]])):
                lines.append(_line(held))
                held = []
            held.append(run)
        lines.append(_line(held))
    return lines


def _line(runs: list[dict]) -> dict:
    text = runs[0]["text"].strip()
    for a, b in zip(runs, runs[1:], strict=False):
        text += (" " if b["left"] - a["right"] > max(1.0, 0.18 * (a["size"] + b["size"]) / 2) else "") + b["text"].strip()
    return {
        "text": re.sub("[ \t\f\v]+", " ", text).strip(), "left": min(r["left"] for r in runs), "bottom": min(r["bottom"] for r in runs),
        "right": max(r["right"] for r in runs), "top": max(r["top"] for r in runs), "size": median(r["size"] for r in runs),
    }


def _overlap(a: dict, b: dict) -> float:
    return max(0.0, min(a["right"], b["right"]) - max(a["left"], b["left"])) / max(1e-9, min(a["right"] - a["left"], b["right"] - b["left"]))


def reading_order(lines: list[dict]) -> list[dict]:
    """Lines column by column where the page has columns, else from the top; lines across columns come before what is below them."""
    down = sorted(lines, key=lambda x: (-x["top"], x["left"]))
    if not lines:
        return []
    width = max(x["right"] for x in lines) - min(x["left"] for x in lines)
    narrow = [x for x in down if x["right"] - x["left"] < 0.72 * width]
    if len(narrow) < 4:
        return down
    columns: list[dict] = []
    for line in narrow:
        best = max(columns, key=lambda c: _overlap(c, line), default=None)
        if best is not None and _overlap(best, line) >= 0.28:
            best["lines"].append(line)
            best["left"], best["right"], best["top"] = min(best["left"], line["left"]), max(best["right"], line["right"]), max(best["top"], line["top"])
        else:
            columns.append({"left": line["left"], "right": line["right"], "top": line["top"], "lines": [line]})
    columns = sorted((c for c in columns if len(c["lines"]) > 1), key=lambda c: c["left"])
    if len(columns) < 2:
        return down
    crossing = [x for x in down if x["right"] - x["left"] >= 0.72 * width or sum(_overlap(c, x) > 0.2 for c in columns) > 1]
    out: list[dict] = []

    def put(some: list[dict]) -> None:
        out.extend(x for x in some if not any(x is o for o in out))

    for column in columns:
        put([x for x in crossing if x["bottom"] >= column["top"]])
        put([x for x in down if any(x is y for y in column["lines"]) and not any(x is y for y in crossing)])
    put(crossing)
    put(down)
    return out


def paragraphs(lines: list[dict]) -> list[dict]:
    """Lines in blocks; a new one starts at a list item, a wide gap, a line that doesn't overlap, or a far indent."""
    blocks: list[list[dict]] = []
    for line in lines:
        if blocks:
            last = blocks[-1][-1]
            mean = (last["size"] + line["size"]) / 2
            apart = last["bottom"] - line["top"] > 0.85 * mean or _overlap(last, line) <= 0 or abs(last["left"] - line["left"]) > 4 * mean
        if not blocks or apart or _LIST.match(line["text"]):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    out = []
    for block in blocks:
        text = ""
        for line in block:
            text = line["text"] if not text else text[:-1] + line["text"] if text.endswith("-") else f"{text} {line['text']}"
        out.append({"text": text, "size": median(x["size"] for x in block), "is_list_item": bool(_LIST.match(block[0]["text"])), "n_lines": len(block)} | {k: f(x[k] for x in block) for k, f in (("left", min), ("bottom", min), ("right", max), ("top", max))})
    return out


def reflow(runs: DataFrame, keys: list[str]) -> DataFrame:
    """A page's runs (text, left, bottom, right, top, size) as blocks in reading order. Bands depend on what came before, so a page is one group."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select(*keys).schema)
    fields = ["text", "left", "bottom", "right", "top", "size", "is_list_item", "n_lines"]

    def run(key: tuple, page: pd.DataFrame) -> pd.DataFrame:
        blocks = paragraphs(reading_order(visual_lines(page.to_dict("records"))))
        return pd.DataFrame([[*key, i, *(b[f] for f in fields)] for i, b in enumerate(blocks)], columns=[*keys, "item_index", *fields])

    return runs.groupBy(*keys).applyInPandas(run, f"{schema}, item_index int, text string, left double, bottom double, right double, top double, size double, is_list_item boolean, n_lines int")


def line_blocks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Blocks of plain texts, whose lines are split at blank lines and list items; hyphens at line ends are repaired."""
    from folioflow.functions.text import is_list_item, joined_lines

    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_index", "line"))
    w = Window.partitionBy(key).orderBy("line_index")
    blank = F.btrim("line") == ""
    fresh = lines.withColumn("starts", (blank | is_list_item(F.col("line")) | F.coalesce(F.lag(F.btrim("line")).over(w) == "", F.lit(True))).cast("int"))
    numbered = fresh.withColumn("part", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(~blank)
    blocks = numbered.groupBy(key, "part").agg(F.sort_array(F.collect_list(F.struct("line_index", "line"))).alias("lines"), F.count(F.lit(1)).alias("n_lines"))
    order = Window.partitionBy(key).orderBy("part")
    return blocks.select(key, (F.row_number().over(order) - 1).cast("int").alias("block_index"), joined_lines(F.col("lines.line")).alias("block"), "n_lines")
