"""Matrices of shown text from the table of operations, against an interpreter that runs through them."""

import random

import pytest

from folioflow.operators import graphics


def product(m, n):
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def interpreted(ops):
    out = []
    for page in sorted({o[0] for o in ops}):
        ctm, stack, line = (1, 0, 0, 1, 0, 0), [], (1, 0, 0, 1, 0, 0)
        for _, i, op, n in sorted((o for o in ops if o[0] == page), key=lambda o: o[1]):
            if op == "q":
                stack.append(ctm)
            elif op == "Q" and stack:
                ctm = stack.pop()
            elif op == "cm":
                ctm = product(n, ctm)
            elif op in ("BT", "Tm"):
                line = tuple(n) if op == "Tm" else (1, 0, 0, 1, 0, 0)
            elif op == "Td":
                line = product((1, 0, 0, 1, *n), line)
            elif op == "Tj":
                out.append((page, i, len(stack), line, ctm))
    return out


@pytest.mark.parametrize(("block", "fold", "gaps"), [(4096, 64, 1), (8, 8, 7)])
def test_matrices_equal_an_interpreter(spark, monkeypatch, block, fold, gaps):
    monkeypatch.setattr(graphics, "BLOCK", block)
    monkeypatch.setattr(graphics.running, "__defaults__", (block,))
    monkeypatch.setattr(graphics, "FOLD", fold)
    rng, ops = random.Random(block), []
    number = lambda: rng.choice([-1.0, 0.5, 2.0, 3.0, 0.0, 1.0])
    for page in range(4):
        for i in range([150, 100, 1, 60][page]):
            op = rng.choice(["q", "q", "Q", "Q", "cm", "BT", "Tm", "Td", "Tj", "Tj", "re"]) if page else rng.choice(["q", "q", "q", "Q", "cm", "Tj"])
            ops.append((page, i * gaps, op, {"cm": 6, "Tm": 6, "Td": 2}.get(op, 0) * [0]))
            if ops[-1][3]:
                ops[-1] = (*ops[-1][:3], [number() * (0.5 if op == "cm" else 1) for _ in ops[-1][3]])
    table = spark.createDataFrame(ops, "page int, op_index long, operator string, numbers array<double>").repartition(3)
    got = sorted((r.page, r.op_index, r.depth, tuple(r.line), tuple(r.ctm)) for r in graphics.text_matrices(table, ["page"]).collect())
    want = interpreted(ops)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9) and g[4] == pytest.approx(w[4], rel=1e-9, abs=1e-9)


def test_empty_and_unbalanced(spark):
    schema = "page int, op_index long, operator string, numbers array<double>"
    assert graphics.text_matrices(spark.createDataFrame([], schema), ["page"]).count() == 0
    got = graphics.text_matrices(spark.createDataFrame([(1, 0, "Q", None), (1, 1, "cm", [1.0]), (1, 2, "Tj", None)], schema), ["page"]).collect()
    assert [(r.depth, tuple(r.ctm)) for r in got] == [(0, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))]


def test_pages_of_one_block_are_folded_and_others_scanned(spark, monkeypatch):
    schema = "page int, op_index long, operator string, numbers array<double>"
    ops = [(p, i, ["q", "cm", "Tj", "BT", "Td", "Tj", "Q", "Tj", "Tm", "Tj"][i % 10], [[], [2.0, 0.0, 0.0, 2.0, 1.0, float(i)], [], [], [3.0, float(i)], [], [], [], [0.5, 0.0, 0.0, 0.5, float(i), 1.0], []][i % 10]) for p, n in ((0, 30), (1, 90), (2, 7)) for i in range(n)]
    table = spark.createDataFrame([*ops, (None, 0, "Tj", [])], schema).repartition(3)
    told = lambda df: sorted((r.page, r.op_index, r.depth, tuple(r.line), tuple(r.ctm)) for r in df.collect())
    want = interpreted(ops)
    whole = graphics.text_matrices(table, ["page"])
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0  # a row a page, folded as it lies
    monkeypatch.setattr(graphics, "BLOCK", 32)
    mixed = graphics.text_matrices(table, ["page"])
    for got in (told(whole), told(mixed)):
        assert [g[:3] for g in got] == [w[:3] for w in want]
        assert all(g[3] == pytest.approx(w[3]) and g[4] == pytest.approx(w[4]) for g, w in zip(got, want, strict=True))
