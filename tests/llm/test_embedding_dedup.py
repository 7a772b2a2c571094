"""Linked vectors against brute force: clusters, exact copies, ties at the threshold, odd vectors, clashing columns; traversal order and recall."""

from collections import defaultdict

import numpy as np
import pytest

from folioflow.llm import embedding_dedup
from folioflow.llm.embedding_dedup import Grid, linked_vectors, multi_sequence, unit_rows

SCHEMA = "vec_id long, embedding array<double>, label int, node long, links int, n_links string, grp string"


def expected(rows, threshold):
    fine = [i for i, (v, e, lab, *_) in enumerate(rows) if v is not None and lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links = defaultdict(set)
    for a in fine:
        for b in fine:
            x, y = rows[a], rows[b]
            if a < b and x[2] == y[2] and len(x[1]) == len(y[1]):
                u, v = (np.array(z[1]) / (np.abs(z[1]).max() if z[0] in (430, 431) else 1) for z in (x, y))
                if u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, done = [], {}
    for a in range(len(rows)):
        if a not in done:
            todo, part = [a], set()
            while todo:
                x = todo.pop()
                if x not in part:
                    part.add(x)
                    todo += links[x]
            least = min((rows[x][0] for x in part if rows[x][0] is not None), default=None)
            done |= dict.fromkeys(part, least)
        out.append((rows[a][0], len(links[a]), done[a], rows[a][0] == done[a]))
    return sorted(out, key=str)


def near(rng, v, cosine):
    """A vector of the given cosine to ``v``."""
    w = rng.normal(size=len(v))
    w -= (w @ v) / (v @ v) * v
    return cosine * v / np.linalg.norm(v) + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(13)
    out = []
    for i in range(300):
        v = rng.normal(size=10)
        if i % 3 == 1:
            v = near(rng, np.array(out[-1][1]), rng.uniform(0.9, 0.96))
        if i % 10 == 5:
            v = np.array(out[i // 2][1]) * rng.choice([0.5, 1, 3])
        if 100 <= i < 160:
            v = near(rng, np.ones(10), 0.97)
        out.append((i, v.tolist(), i % 2 if i % 7 else 5))
    out += [(i, [1.0, 0.0, 2.0], 1) for i in range(400, 420)] + [(401, [1.0, 0.0, 2.0], 1), (402, [1.0, 0.0, 2.0], None), (None, [1.0, 0.0, 2.0], 1), (430, [1e308, 0.0, 1e308], 1), (431, [1e-300, 0.0, 1e-300], 1)]
    out += [(500, None, 1), (501, [0.0] * 10, 1), (502, [None] + [1.0] * 9, 1), (503, [float("nan")] + [1.0] * 9, 1), (504, [float("inf")] + [1.0] * 9, 1), (505, [], 1), (506, [2.0], 1), (507, [3.0], 1), (508, [-3.0], 1)]
    # a cosine of exactly 0.6
    out += [(600, [1.0, 0.0, 0.0, 0.0], 9), (601, [0.6, 0.8, 0.0, 0.0], 9), (602, [3.0, 4.0, 0.0, 0.0], 9)]
    return [(*r, 7, 8, "x", "y") for r in out]


@pytest.mark.parametrize(("threshold", "block"), [(0.93, 1024), (0.6, 4)])
def test_links_agree_with_brute_force(spark, rows, threshold, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "CELL", 8)
    found = linked_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), threshold)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == [(*w[:3], w[3]) for w in expected(rows, threshold)]


def test_smaller_recall_loses_few_links_and_adds_none(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    exact = {r.vec_id: r.n_links for r in linked_vectors(table.filter("vec_id < 300"), 0.93).collect()}
    some = {r.vec_id: r.n_links for r in linked_vectors(table.filter("vec_id < 300"), 0.93, recall=0.9).collect()}
    assert all(some[v] <= exact[v] for v in exact)
    assert sum(some.values()) >= 0.85 * sum(exact.values())


def test_empty_and_single(spark):
    assert linked_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert linked_vectors(spark.createDataFrame([(1, [1.0], 1, 0, 0, "", "")], SCHEMA)).collect()[0].asDict() == {"vec_id": 1, "n_links": 0, "component_id": 1, "kept": True}


def test_traversal_is_in_order_and_complete():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, limit = rng.random(rng.integers(1, 9)).round(1), rng.random(rng.integers(1, 9)).round(1), rng.random() * 2
        found = list(multi_sequence(a, b, limit))
        sums = [a[i] + b[j] for i, j in found]
        assert sums == sorted(sums) and len(found) == len(set(found))
        assert set(found) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= limit}


def test_bounds_hold():
    rng = np.random.default_rng(3)
    units = unit_rows(rng.normal(size=(400, 7)))
    grid = Grid(units, [0] * 400, 12, 0.9, 1.0)
    cells = grid.cells(units)
    for i in range(100):
        seen = set(grid.visits(units[i : i + 1]))
        assert {int(c) for c in cells[units @ units[i] >= 0.9]} <= seen
