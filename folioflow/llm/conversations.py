"""Repair of a conversation's structure with the fewest edits, by cost layers of reachable grammar states.

A conversation is well formed if the first letters of its roles read ``(s?(ua)+)?``. For each turn and
each cost there is a set of grammar states from which the rest of the conversation can be repaired at
that cost. States are bits, and a cost is four bits of a word: shifting a word by a cost's bits applies
an edit to all states and costs at once. The costs of a turn's states differ by at most 13, so a word
of 16 layers, counted from the least, holds all of them. The first layer of the first turn that has
the start state gives the cost; following the bits from there, always along the first letter
that keeps the cost, gives the least of the cheapest edit scripts.

1. Turns are dealt out by range of conversation and turn, so that a long conversation spreads over many
   tasks. A task repairs each conversation that it has as a whole in one pass, with bounded memory.
2. What touches a task's edges, or is longer than a task holds, is written as turns. Their first
   occurrences are counted by aggregation, their turns packed to a byte each, and a last task for
   each conversation follows these bytes, and the texts for the digest, as a stream. (An audit is one
   string and a digest one hash, so this last part of a conversation is a single stream by contract.)
"""

from __future__ import annotations

import hashlib
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import runs_of, trimmed, written

#: A conversation of more turns, or more bytes of text, than this is repaired in parts.
MOST_TURNS, MOST_BYTES = 4096, 4 << 20
#: Characters of a role and text by which turns of equal number are dealt out.
HEAD = 64
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LAYERS = 16
_FULL = (1 << 4 * LAYERS) - 1
#: Grammar states: nothing yet, after s, after u, after a. The state that u or a leads to, by state, and the role's name.
_TURN = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
#: A bit for each layer, for layers beyond those of a word too: an edit shifts before the word is cut anew.
_ONES = int("1" * (LAYERS + 16), 16)
#: Codes of a turn: a role's letter (s, u, a, another), with 4 added if it is truncated; or one that has to go.
_LETTERS = {"s": 0, "u": 1, "a": 2}
OTHER, MUST_GO = 3, 8
RESULT = "conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def kept_state(state: int, code: int) -> int | None:
    """The state that a kept turn leads to, if the grammar has one."""
    if code >= MUST_GO or code % 4 == OTHER:
        return None
    if code % 4 == 0:
        return 1 if state == 0 else None
    return code % 4 + 1 if _TURN[state][0] == code % 4 + 1 else None


def before_turn(word: int) -> int:
    """The states from which one user or assistant turn leads to states of ``word``, by layer."""
    to_user, to_assistant = word >> 2 & _ONES, word >> 3 & _ONES
    return to_user | to_user << 1 | to_user << 3 | to_assistant << 2


def closed(word: int) -> int:
    """``word`` with all that inserted turns reach."""
    for _ in range(3):
        word |= before_turn(word) << 4 * INSERT
    return word


def layered(word: int) -> tuple[int, int]:
    """The word counted from its first layer with a state, and that layer."""
    first = 0
    while not word & 15:
        word >>= 4
        first += 1
    return word & _FULL, first


def end_word() -> int:
    word = 0
    for layer in range(LAYERS):
        word |= 0b1001 << 4 * layer
    return closed(word) & _FULL


class Repairer:
    """The steps from one turn's word to that of the turn before, each computed once: there are few words."""

    def __init__(self):
        self.end = end_word()
        self.words, self.numbers = [self.end], {self.end: 0}
        self.steps: dict[tuple[int, int], tuple[int, int]] = {}
        self.moves: dict[tuple[int, int, int], tuple[str, int]] = {}

    def step(self, after: int, code: int) -> tuple[int, int]:
        """The number of the word before a turn, and how much its least cost exceeds that of the word after."""
        found = self.steps.get((after, code))
        if found is None:
            word = self.words[after]
            out = word << 4 * DELETE
            if code < MUST_GO:
                letter, extra = code % 4, TRUNCATED if code >= 4 else 0
                out |= before_turn(word) << 4 * (REROLE + extra)
                if letter == 0:
                    out |= (word >> 1 & _ONES) << 4 * extra
                elif letter == 1:
                    to = word >> 2 & _ONES
                    out |= (to | to << 1 | to << 3) << 4 * extra
                elif letter == 2:
                    out |= (word >> 3 & _ONES) << 2 << 4 * extra
            # what can be reached at a cost can be reached at each higher cost
            for layer in range(1, LAYERS + 8):
                out |= (out >> 4 * (layer - 1) & 15) << 4 * layer
            new, more = layered(closed(out))
            if new not in self.numbers:
                self.numbers[new] = len(self.words)
                self.words.append(new)
            found = self.steps[after, code] = self.numbers[new], more
        return found

    def cost(self, number: int, state: int) -> int:
        """The first layer of a word that has the state; more than all layers if none has."""
        word = self.words[number] >> state
        for layer in range(LAYERS):
            if word >> 4 * layer & 1:
                return layer
        return 1 << 30

    def move(self, after: int, code: int, state: int) -> tuple[str, int]:
        """The least letters that take a turn at the least cost, insertions before it included, and the state then."""
        found = self.moves.get((after, code, state))
        if found is None:
            number, more = self.step(after, code)
            extra = TRUNCATED if 4 <= code < MUST_GO else 0
            letters, here, last = "", state, ""
            while not last:
                left, turn = self.cost(number, here) + more, _TURN[here][0]
                kept = kept_state(here, code)
                if self.cost(after, here) + DELETE == left:
                    last = "D"
                elif self.cost(number, turn) + more + INSERT == left:
                    letters, here = letters + "I", turn
                elif kept is not None and self.cost(after, kept) + extra == left:
                    last, here = "K", kept
                else:
                    last, here = "R", turn
            found = self.moves[after, code, state] = letters + last, here
        return found

    def repair(self, codes: bytes) -> tuple[int, str]:
        """The least cost and the audit of a conversation's codes."""
        numbers, number, total = array("H", bytes(2 * len(codes))), 0, 0
        for i in range(len(codes) - 1, -1, -1):
            numbers[i] = number  # of the word after turn i
            number, more = self.step(number, codes[i])
            total += more
        audit, state = [], 0
        for after, code in zip(numbers, codes, strict=True):
            letters, state = self.move(after, code, state)
            audit.append(letters)
        audit.append("I" * {0: 0, 1: 2, 2: 1, 3: 0}[state])
        return total + self.cost(number, 0), "".join(audit)


_REPAIRER = Repairer()


def code_of(role: str, text: str) -> int:
    """The code of a turn that is no duplicate: bare of spaces, its text's last character decides whether it is truncated."""
    bare = text.rstrip(" \t\n\x0b\x0c\r")
    if not bare:
        return MUST_GO
    return _LETTERS.get(role[:1], OTHER) + (0 if bare[-1] in ".!?" else 4)


def script(audit: str) -> Iterator[str]:
    """The audit in parts: the insertions before each turn with the turn's own letter; at the end the insertions after all."""
    at = 0
    while at < len(audit):
        end = at
        while end < len(audit) and audit[end] == "I":
            end += 1
        yield audit[at : end + 1]
        at = end + 1


class Digest:
    """A running hash of the repaired conversation's lines."""

    def __init__(self):
        self.hash, self.first, self.state = hashlib.sha256(), True, 0

    def line(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False

    def edits(self, letters: str, role: str | None = None, text: str | None = None) -> None:
        for letter in letters:
            to, name = _TURN[self.state]
            if letter == "I":
                self.line(name, "")
                self.state = to
            elif letter == "R":
                self.line(name, text)
                self.state = to
            elif letter == "K":
                self.line(role, text)
                self.state = {"s": 1, "u": 2, "a": 3}[role[0]]


def pairs_illegal(letters: str) -> int:
    return sum(1 for pair in itertools.pairwise(letters) if "".join(pair) not in ("su", "ua", "au"))


def repaired(turns: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit and digest of (turn, role, text) in order."""
    seen: set[tuple[str, str]] = set()
    codes, blank, duplicate, truncated = bytearray(), 0, 0, 0
    for _, role, text in turns:
        code = code_of(role, text)
        if code == MUST_GO:
            blank += 1
        elif (role, text) in seen:
            duplicate, code = duplicate + 1, MUST_GO
        elif code >= 4:
            truncated += 1
        seen.add((role, text))
        codes.append(code)
    numbers = {t for t, _, _ in turns if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = pairs_illegal("".join(role[:1] if role[:1] in _LETTERS else "-" for _, role, _ in turns))
    cost, audit = _REPAIRER.repair(bytes(codes))
    digest, parts = Digest(), script(audit)
    for _, role, text in turns:
        digest.edits(next(parts), role, text)
    digest.edits(next(parts, ""))
    return gaps, blank, duplicate, truncated, illegal, cost, audit, digest.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``live`` (false: dropped) of the turns after the damage that crc32(``conv_id:turn``) % 20 deals; nulls count as one space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col("role").cast("string"), space), F.coalesce(F.col("text").cast("string"), space)
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("live"),
        F.when(fate == 3, F.lit(2)).otherwise(F.lit(1)).alias("copies"),
    )
    # a dropped turn is kept as a mark, so that a conversation that loses all of them is still known
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text, live): its faults, the cost and audit of its repair, and the digest of the repaired text.

    Turns are taken by turn (nulls first); those of equal turn by role and text (by bytes), so repeated
    rows stand side by side. Null roles and texts count as one space; the null conversation is one. A role
    counts by its first letter: one that starts with none of s, u and a fits nowhere and is renamed or
    deleted. Turns with ``live`` false only name their conversation; one without other turns has zeros,
    an empty audit and the digest of an empty string. An empty table gives an empty result.
    """
    space, kind = F.lit(" "), turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), "live")
    order = ["conv_id", "turn", "role", "text"]
    # of texts, only heads go to the driver as samples; they keep the order
    head = F.substring(F.concat("role", F.lit("\0"), "text"), 1, HEAD)
    dealt = rows.repartitionByRange("conv_id", "turn", head).sortWithinPartitions(*order)
    fields = f"{RESULT.format(kind)}, turn long, role string, text string, live boolean, part int, place long, content binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        schema = None
        whole: list[tuple] = []
        open_rows: list[tuple] = []

        def open_row(conv, turn, role, text, live) -> None:
            nonlocal place
            content = hashlib.sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
            open_rows.append((conv, turn, role, text, live, part, place, content))
            place += 1

        def told() -> Iterator[pa.RecordBatch]:
            if whole:
                columns = list(zip(*whole, strict=True)) + [[None] * len(whole)] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
                whole.clear()
            if open_rows:
                conv, *others = zip(*open_rows, strict=True)
                columns = [conv, *[[None] * len(open_rows)] * 8, *others]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
                open_rows.clear()

        # the first conversation may have begun, and the last may go on, in another task
        held, size, now, is_open, first = [], 0, None, True, True
        for batch in batches:
            if schema is None:
                longs, texts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"], ["audit", "repaired_sha256"]
                schema = pa.schema(
                    [("conv_id", batch.schema.field(0).type), *((x, pa.int64()) for x in longs), *((x, pa.string()) for x in texts),
                     ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("live", pa.bool_()), ("part", pa.int32()), ("place", pa.int64()), ("content", pa.binary())]
                )
            for conv, turn, role, text, live in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if first or conv != now:
                    if held:
                        whole.append((now, *repaired([h[1:4] for h in held if h[4]])))
                    held, size, is_open, now, first = [], 0, first, conv, False
                if is_open:
                    open_row(conv, turn, role, text, live)
                else:
                    held.append((conv, turn, role, text, live))
                    size += len(text)
                    if len(held) > MOST_TURNS or size > MOST_BYTES:
                        for h in held:
                            open_row(*h)
                        held, is_open = [], True
            yield from told()
        for h in held:
            open_row(*h)
        yield from told() if schema is not None else ()

    seen = written(dealt.mapInArrow(trimmed(run), fields), "conversations")
    result = [f.split()[0] for f in RESULT.format(kind).split(", ")]
    return seen.filter("part is null").select(*result).unionByName(joined(seen.filter("part is not null").select("conv_id", "turn", "role", "text", "live", "part", "place", "content"), kind))


def joined(rows: DataFrame, kind: str) -> DataFrame:
    """The result rows of conversations given as turns with their task and place."""
    at = F.struct("part", "place")
    live = rows.filter("live")
    firsts = live.groupBy("conv_id", "content").agg(F.min(at).alias("first")).toDF("of", "what", "first")
    letter = F.substring("role", 1, 1)
    known = live.select("conv_id", "part", "place", turn_code().alias("code"), F.when(letter.isin(*_LETTERS), letter).otherwise(F.lit("-")).alias("letter"), "content")
    known = known.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("what")))
    again = F.when((F.col("first") < at) & (F.col("code") != MUST_GO), MUST_GO + 1).otherwise(F.col("code"))
    packed_rows = known.select("conv_id", "part", "place", again.alias("code"), "letter")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_of(batches, 2):
            codes = bytes(unit["code"].to_pylist())
            yield pa.RecordBatch.from_arrays([unit["conv_id"][:1].combine_chunks(), unit["part"][:1].combine_chunks(), pa.array([codes], pa.binary()), pa.array(["".join(unit["letter"].to_pylist())])], names=["conv_id", "part", "codes", "letters"])

    packed = packed_rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place").mapInArrow(trimmed(pack), f"conv_id {kind}, part int, codes binary, letters string")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs_of(batches, 1):
            codes, letters = b"".join(unit["codes"].to_pylist()), "".join(unit["letters"].to_pylist())
            cost, audit = _REPAIRER.repair(bytes(codes).replace(bytes([MUST_GO + 1]), bytes([MUST_GO])))
            counts = [codes.count(MUST_GO), codes.count(MUST_GO + 1), sum(codes.count(c) for c in range(4, MUST_GO)), pairs_illegal(letters), cost]
            yield pa.RecordBatch.from_arrays([unit["conv_id"][:1].combine_chunks(), *(pa.array([c], pa.int64()) for c in counts), pa.array([audit], pa.string())], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    laid = packed.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    audits = written(laid.mapInArrow(trimmed(follow), f"conv_id {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts, of = None, iter(()), None

        def told() -> pa.RecordBatch:
            held.edits(next(parts, ""))
            return pa.RecordBatch.from_arrays([of, pa.array([held.hash.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            audits, roles, texts = (batch.column(i).to_pylist() for i in (3, 4, 5))
            for i, (audit, role, text) in enumerate(zip(audits, roles, texts, strict=True)):
                if audit is not None:
                    if held:
                        yield told()
                    held, parts, of = Digest(), script(audit), batch.column(0).slice(i, 1)
                else:
                    held.edits(next(parts), role, text)
        if held:
            yield told()

    none = F.lit(None).cast("string")
    stream = audits.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("place"), "audit", none.alias("role"), none.alias("text"))
    stream = stream.unionByName(live.select("conv_id", "part", "place", none.alias("audit"), "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    digests = stream.mapInArrow(trimmed(digest), f"conv_id {kind}, repaired_sha256 string")
    turns = rows.groupBy("conv_id", F.when(F.col("live"), F.col("turn")).alias("turn")).agg(F.lit(1).alias("one"))
    gaps = turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    out = gaps.alias("g").join(audits.alias("a"), F.col("g.conv_id").eqNullSafe(F.col("a.conv_id")), "left").join(digests.alias("d"), F.col("g.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    zero = lambda c: F.coalesce(F.col(f"a.{c}"), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("g.conv_id").alias("conv_id"), F.col("g.gaps").alias("gaps"), *map(zero, ("blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("a.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def turn_code() -> Column:
    """``code_of`` of role and text, in built-in functions."""
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    letter = F.substring("role", 1, 1)
    base = F.when(letter == "s", 0).when(letter == "u", 1).when(letter == "a", 2).otherwise(OTHER)
    return F.when(bare == "", MUST_GO).otherwise(base + F.when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(4))


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role and text of the repaired conversations, from the turns and ``repair_conversations``' audits.

    A turn's edits are found by its place among the turns and that of its letter among the letters other
    than I, both counted by windows over a conversation; turns are in the order that
    ``repair_conversations`` states.
    """
    space = F.lit(" ")
    rows = turns.filter("live").select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    letters = edits.select("conv_id", F.posexplode(F.split("audit", "")).alias("place", "letter")).filter("letter <> ''")
    own = Window.partitionBy("conv_id").orderBy("place")
    letters = letters.withColumn("nth", F.sum(F.when(F.col("letter") == "I", 0).otherwise(1)).over(own)).filter("letter <> 'D'")
    found = letters.alias("l").join(numbered.alias("t"), F.col("l.conv_id").eqNullSafe(F.col("t.conv_id")) & (F.col("l.nth") == F.col("t.nth")) & (F.col("l.letter") != "I"), "left")
    told = found.select(F.col("l.conv_id").alias("conv_id"), "place", "letter", "role", F.coalesce("text", F.lit("")).alias("text"))
    system = F.max(F.when((F.col("letter") == "K") & F.col("role").startswith("s"), 1).otherwise(0)).over(Window.partitionBy("conv_id"))
    told = told.withColumn("n", F.row_number().over(own)).withColumn("from_user", F.col("n") - system)
    name = F.when(F.col("from_user") % 2 == 1, F.lit("user")).otherwise(F.lit("assistant"))
    return told.select("conv_id", F.col("n").alias("place"), F.when(F.col("letter") == "K", F.col("role")).otherwise(name).alias("role"), "text")
