"""Collocations against brute force: pieces, overlaps, odd white space, ties, nulls, repeated rows, clashing columns, several automata and sketches."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioflow.llm import collocations as module
from folioflow.llm.collocations import Pieces, Rules, Sketch, collocations, counters, guarded, ranked
from folioflow.llm.hashing import text_slices

SCHEMA = "doc_id long, text string, lang string, phrase string, words int, a string, row int"


def pieces_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def expected(rows, rules):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        totals[lang] += 0
        for words in pieces_of(text or ""):
            totals[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= rules.least}
        some = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= rules.displaced * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in found.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            some.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (score, a, phrase, left, right) in enumerate(sorted(some)[: rules.kept]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = [*"abcdefgh", "été", "日本", "\x00", "\x1c", "it's", "a.b", "𝒳", "İ"]
    out = []
    for i in range(60):
        words = rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 120))
        text = "".join(w.upper() if rng.random() < 0.2 else w + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r\n", "\x0b", ";"]) for w in words)
        out.append((i, text, ["en", "de", None, "und"][i % 4]))
    out += [(60, None, "en"), (61, "", "fr"), (62, " \n\t.", "fr"), (63, "a a a a a " * 3000, "xx"), out[5], out[5], out[6]]
    return [(*r, "x", 1, "y", 2) for r in out]


@pytest.mark.parametrize(("phrases", "held", "least"), [(60_000, 16 << 20, 4), (7, 500, 2), (60_000, 16 << 20, 30)])
def test_collocations_agree_with_brute_force(spark, rows, phrases, held, least, monkeypatch):
    monkeypatch.setattr(module, "PHRASES", phrases)
    monkeypatch.setattr(module, "HELD_BYTES", held)
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "REMEMBERED", held)
    monkeypatch.setattr(module, "HELD_COUNTS", held)
    monkeypatch.setattr(module, "SLICE", phrases)
    rules = Rules(least=least, kept=40)
    found = collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), rules)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == expected(rows, rules)


def test_a_narrow_sketch_changes_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(module, "LEAST_COUNTERS", 16)
    monkeypatch.setattr(module, "MOST_COUNTERS", 64)
    rules = Rules(least=5, kept=2000)
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(rows, SCHEMA), rules).collect()) == expected(rows, rules)


def test_each_place_goes_to_few_automata(spark, monkeypatch):
    """With many automata, the text that they scan in all stays near the text itself."""
    rng = random.Random(5)
    made = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 400)}" for _ in range(400)) + ".", "en", "", 0, "", 0) for i in range(200)]
    whole, sent, held = sum(len(r[1]) for r in made), [], module.stretches

    def watched(*told):
        found = held(*told)
        sent.extend((r.file, len(module.zstandard.decompress(r.text))) for r in found.collect())
        return found

    monkeypatch.setattr(module, "PHRASES", 60)
    monkeypatch.setattr(module, "stretches", watched)
    rules = Rules(least=4, kept=5000)
    assert sorted(tuple(r) for r in collocations(spark.createDataFrame(made, SCHEMA).repartition(3), rules).collect()) == expected(made, rules)
    assert len({f for f, _ in sent}) > 30 and sum(n for _, n in sent) < 6 * whole  # each automaton scanned the whole text


@pytest.mark.parametrize(("span", "n", "kind"), [(1 << 12, 0, np.uint8), (1 << 12, 60, np.uint8), (1 << 12, 3000, np.uint8), (1 << 12, 60, np.uint32)])
def test_ranges_of_counters(span, n, kind):
    rng = np.random.default_rng(2)
    at = np.sort(rng.choice(span, n, replace=False))
    times = rng.integers(1, 250, n).astype(kind)
    sums, want = np.arange(span), np.arange(span)
    want[at] += times
    module.add_range(sums, module.packed_range(at, times, span), kind)
    assert (sums == want).all()
    both = np.concatenate([at, at]).astype(np.uint64) << np.uint64(32) | np.concatenate([times, times]).astype(np.uint64)
    found, counts = module.summed([both])
    assert (found == at).all() and (counts == 2 * times.astype(np.int64)).all()


def test_empty_tables(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert collocations(spark.createDataFrame([(1, None, None, "", 0, "", 0)], SCHEMA)).count() == 0


def test_counts_past_64_bits_are_exact(spark):
    big = 9_000_000_000_000_000_000
    three = big // 5 * 4 - 1
    known = spark.createDataFrame([("en", "a", big), ("en", "b", big), ("en", "c", big), ("en", "a b", big - 2), ("en", "b c", big), ("en", "a b c", three)], "lang string, phrase string, a long")
    found = {r.phrase: r for r in ranked(known, spark.createDataFrame([("en", big)], "lang string, n long"), Rules()).collect()}
    # 100 times the longest is just under 80 times "b c" and not under 80 times "a b"
    assert set(found) == {"b c", "a b c"}
    assert found["b c"].score == 1_000_000 and found["a b c"].score == min(2_000_000 * three // (2 * big), 2_000_000 * three // (2 * big - 2))


def test_pieces_and_guards():
    import pyarrow as pa

    texts = ["One two. THREE\tfour\n", "", None, "five", "É É"]
    (_, _, data, offsets), *_ = text_slices(pa.array([t if t is None else t.encode() for t in texts], pa.binary()))
    pieces = Pieces(data, offsets)
    assert pieces.left.tolist() == [2, 1, 2, 1, 1, 2, 1]
    assert pieces.texts(np.flatnonzero(pieces.runs(2)[1]), 2) == [b"one two", b"three four", "É É".encode()]
    assert guarded("One two. THREE\tfour\n".encode()) == " one two \n three four "
    sketch = Sketch(64)
    assert counters(pieces.words.hashes, 0, sketch.width).max() < 64
