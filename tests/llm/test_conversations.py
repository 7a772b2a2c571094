"""Conversation repair against a search over all edit scripts, with nulls, ties, repeats, odd roles, long conversations and clashing columns."""

import hashlib
import heapq
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioflow.llm import conversations
from folioflow.llm.conversations import MUST_GO, Repairer, damaged, repair_conversations, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, part int, live string, audit string"


def cheapest(codes):
    """The least (cost, audit) by Dijkstra's algorithm over scripts."""
    heap, done = [(0, "", 0, 0)], set()
    after = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(codes) and state in (0, 3):
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        for letter in "ua":
            if state in after[letter]:
                heapq.heappush(heap, (cost + 3, audit + "I", i, after[letter][state]))
        if i < len(codes):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if codes[i] < MUST_GO:
                extra, own = 3 * (codes[i] >= 4), "sua-"[codes[i] % 4]
                if state in after.get(own, {}):
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, after[own][state]))
                for letter in "ua":
                    if state in after[letter]:
                        heapq.heappush(heap, (cost + extra + 3, audit + "R", i + 1, after[letter][state]))
    raise AssertionError


def expected(rows):
    """Result rows by conversation from (conv_id, turn, role, text), as the contract words it."""
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv] += []
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        found[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(fate, 1)
    out = {}
    for conv, turns in found.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        codes, counts, seen = [], [0, 0, 0], set()
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            code = {"s": 0, "u": 1, "a": 2}.get(role[:1], 3)
            if not bare:
                counts[0] += 1
                code = MUST_GO
            elif (role, text) in seen:
                counts[1] += 1
                code = MUST_GO
            elif bare[-1] not in ".!?":
                counts[2] += 1
                code += 4
            seen.add((role, text))
            codes.append(code)
        illegal = sum(1 for a, b in zip(turns, turns[1:], strict=False) if a[1][:1] + b[1][:1] not in ("su", "ua", "au"))
        numbers = {t for t, _, _ in turns if t is not None}
        cost, audit = cheapest(codes)
        lines, rest, last = [], iter(turns), "a"
        for letter in audit:
            turn = next(rest) if letter != "I" else (None, "", "")
            if letter == "D":
                continue
            role = turn[1] if letter == "K" else ("assistant" if last == "u" else "user")
            last = role[0]
            lines.append((role, turn[2]))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *counts, illegal, cost, audit, digest), lines
    return out


def talk(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "USER", "agent"]
    texts = ["Yes.", "No!", "why", "", " \n", None, "Ça va ?", "é…", "one. two", "a. \t"]
    out = []
    for turn in range(n):
        role = ("user", "assistant")[turn % 2] if rng.random() < 0.6 else rng.choice(roles)
        out.append((conv, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1, 5]), role, rng.choice(texts) if rng.random() < 0.5 else f"Line {rng.randrange(n)}."))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    out = [r for conv in range(120) for r in talk(rng, conv, rng.randint(1, 9))]
    out += talk(rng, None, 6) + talk(rng, 500, 900) + [(700, t, "user", "same.") for t in range(300)]
    out += [(600, None, "user", "x" * 200_000 + "."), (600, None, "assistant", "x" * 200_000), (601, 3, "user", "A."), (601, 3, "user", "A."), (601, 3, "assistant", "B."), out[3], out[3]]
    rng.shuffle(out)
    return out


def test_repairer_agrees_with_search_over_scripts():
    rng, repairer = random.Random(5), Repairer()
    for _ in range(1500):
        codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 7, 8]) for _ in range(rng.randint(0, 9)))
        assert repairer.repair(codes) == cheapest(codes), list(codes)
    assert len(repairer.words) < 1000


@pytest.mark.parametrize("most", [4096, 5])
def test_repair_agrees_with_brute_force(spark, rows, most, monkeypatch):
    monkeypatch.setattr(conversations, "MOST_TURNS", most)
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA).repartition(5)
    hurt = damaged(table)
    found = repair_conversations(hurt).collect()
    want = expected(rows)
    assert len(found) == len(want)
    assert {r[0]: tuple(r)[1:] for r in found} == {c: w for c, (w, _) in want.items()}
    told = defaultdict(list)
    for r in repaired_turns(hurt, repair_conversations(hurt)).orderBy("conv_id", "place").collect():
        told[r.conv_id].append((r.role, r.text))
    assert dict(told) == {c: lines for c, (_, lines) in want.items() if lines}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damaged(empty)).count() == 0
    gone = repair_conversations(spark.createDataFrame([(1, 0, "user", "x", False)], "conv_id long, turn long, role string, text string, live boolean"))
    assert gone.collect()[0].asDict() == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    assert repaired_turns(gone.select("conv_id", F.lit(1).alias("turn"), F.lit("a").alias("role"), F.lit("b").alias("text"), F.lit(False).alias("live")), gone).count() == 0
