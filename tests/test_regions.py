"""Regions by tiles against a flood fill: snakes over many tiles, several pages, values, repeated cells, empty tables."""

import numpy as np
import pytest

from folioflow.operators import recognition
from folioflow.operators.regions import labelled, regions


def flood(cells):
    left, out = dict(cells), []
    while left:
        queue, part = [next(iter(left))], []
        total = 0.0
        while queue:
            x, y = queue.pop()
            if (x, y) in left:
                total += left.pop((x, y))
                part.append((x, y))
                queue += [(x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)]
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        first = min((y, x) for x, y in part)
        out.append((first[0] << 32 | first[1], min(xs), min(ys), max(xs), max(ys), len(part), total))
    return sorted(out)


def test_labels_of_a_tile():
    rng = np.random.default_rng(1)
    for _ in range(40):
        mask = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < 0.6
        got = labelled(mask)
        want = {(x, y) for y, x in zip(*np.nonzero(mask), strict=True)}
        assert len(set(got[mask].tolist())) == len(flood({c: 0.0 for c in want})) and (got[~mask] == -1).all()


@pytest.mark.parametrize("tile", [5, 512])
def test_regions_equal_a_flood_fill(spark, tile):
    rng = np.random.default_rng(2)
    pages = {1: rng.random((40, 37)) < 0.55, 2: rng.random((13, 60)) < 0.65, 3: np.zeros((50, 50), dtype=bool)}
    pages[3][::2] = True  # rows that are joined at alternating ends: one snake through all tiles
    pages[3][1::4, -1] = pages[3][3::4, 0] = True
    rows = [(p, int(x), int(y), float(x + y)) for p, m in pages.items() for y, x in zip(*np.nonzero(m), strict=True)]
    table = spark.createDataFrame([*rows, *rows[:50], (1, None, 2, 1.0), (None, 1, 1, 1.0)], "page int, x int, y int, v double")
    found = regions(table, ["page"], "v", tile).collect()
    for p in pages:
        got = sorted((r.region, r.left, r.top, r.right, r.bottom, r.n, r.total) for r in found if r.page == p)
        assert got == flood({(x, y): v for q, x, y, v in rows if q == p})
    assert len([r for r in found if r.page == 3]) == 1 and len(found) == sum(len(flood({(x, y): v for q, x, y, v in rows if q == p})) for p in pages)


def test_tiled_text_boxes_equal_those_of_whole_maps(spark):
    rng = np.random.default_rng(3)
    probs = (rng.random((30, 44)) < 0.5).astype(float) * rng.random((30, 44)).round(2)
    probs[4:9, 5:20] = 0.9
    whole = spark.createDataFrame([(1, 44, 30, probs.ravel().tolist())], "page int, width int, height int, probs array<double>")
    pixels = spark.createDataFrame([(1, 44, 30, int(x), int(y), float(probs[y, x])) for y in range(30) for x in range(44)], "page int, width int, height int, x int, y int, prob double")
    options = {"threshold": 0.2, "least_score": 0.1, "scale_x": 2.0}
    a, b = ([tuple(round(v, 9) for v in r) for r in df.orderBy("box_index").collect()] for df in (recognition.text_boxes(whole, ["page"], **options), recognition.tiled_text_boxes(pixels, ["page"], **options)))
    assert a == b and len(a) > 1


def test_no_cells(spark):
    assert regions(spark.createDataFrame([], "page int, x int, y int"), ["page"]).count() == 0
