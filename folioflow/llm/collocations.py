"""Collocations: phrases of two to four words that come more often than their parts suggest.

1. Count-min sketches. Levels of one word, of two, and of three and four are counted in two rows of
   hashed counters each. A counter is never below the true count, so a phrase whose counters don't
   all reach the threshold can't; a level only counts phrases whose shorter parts may reach it. Tasks
   send their counts by ranges of counters, and what comes back is a bit for each counter: a sketch
   has a fixed largest size, which grows with the text up to that.
2. Phrases that the bits leave are gathered once each and compiled, some hundreds of thousands at a time,
   into Aho-Corasick automata. Each word has a delimiter on both sides, so a match is one of whole words.
3. Texts are scanned with their language's automaton. Where a language has several, a phrase's first two words
   tell its automaton, and each automaton only gets the stretches of text in which the bits leave such phrases:
   what is scanned grows with the text, not with text times automata. Overlapping matches are counted, and
   the counts of all tasks are summed. These exact counts, not the sketches', meet the thresholds.
4. Scores, the rule on longer phrases and the ranking are joins, aggregations and windows.
"""

from __future__ import annotations

import pickle
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import file_system, new_folder, trimmed, written
from folioflow.llm.hashing import Words, mixed, run_hashes, text_slices

#: Counters of a sketch's row: at least, at most, and a counter for so many bytes of text.
LEAST_COUNTERS, MOST_COUNTERS, BYTES_A_COUNTER = 1 << 16, 1 << 27, 32
ROWS = 2
#: Counters of a range, which one task sums at a time.
RANGE = 1 << 18
#: Counts that a task holds before it sends them on, and phrases that it remembers having sent.
HELD, REMEMBERED = 1 << 23, 1 << 19
#: So many times more phrases are remembered by their hashes alone.
MORE_HASHES = 8
#: Phrases of an automaton, and bytes of text that a task holds to scan with one automaton after another.
PHRASES, HELD_BYTES = 400_000, 16 << 20
#: Counts of an automaton's phrases that are summed together, and counts that a scanning task holds.
SLICE, HELD_COUNTS = 1 << 16, 1 << 22
#: Bytes of stretches that are sent to one automaton in a row, and those that one load of an automaton should scan.
STRETCHES, SHARE = 1 << 18, 1 << 24
#: Bytes in pieces of text: letters A-Z in lower case, tabs as spaces, and all that ends a piece as a line feed.
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_PLAIN_TABLE = np.frombuffer(_PLAIN, dtype=np.uint8)
_SALTS = mixed(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


@dataclass(frozen=True)
class Rules:
    """How often a phrase has to come, its words, in how many hundredths of its occurrences a longer one displaces it, and how many a language keeps."""

    least: int = 30
    words: int = 4
    displaced: int = 80
    kept: int = 2000


def language_hash(name: str) -> np.uint64:
    return mixed(np.array([int.from_bytes(name.encode()[:8].ljust(8, b"\0"), "little") + len(name)], dtype=np.uint64) + np.uint64(sum(name.encode())))[0]


class Pieces:
    """The words of some texts with their hashes, and for each the words left in its piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        plain = _PLAIN_TABLE[data]
        self.words = words = Words(plain, offsets)
        self.whole = plain.tobytes()
        n = len(words.starts)
        breaks = np.cumsum(plain == 10)
        piece = breaks[words.starts] if n else np.zeros(0, dtype=np.int64)
        self.owner = np.searchsorted(words.first, np.arange(n), side="right") - 1
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (piece[1:] != piece[:-1]) | (self.owner[1:] != self.owner[:-1])
        edges = np.append(np.flatnonzero(fresh), n)
        self.left = np.repeat(edges[1:], np.diff(edges)) - np.arange(n)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of so many words by place, and which of them lie in one piece."""
        hashes = self.words.hashes if size == 1 else run_hashes(self.words.hashes, size)
        return hashes, self.left[: len(hashes)] >= size

    def guarded(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes with a space before each word and a line feed between pieces, and where the words begin (with that space) and end in them."""
        starts, sizes, last = self.words.starts, self.words.ends - self.words.starts, self.left == 1
        after = np.cumsum(sizes + 1 + 2 * last)
        begin = after - sizes - 1 - 2 * last
        end = begin + 1 + sizes
        out = gathered(np.frombuffer(self.whole, np.uint8), starts - 1, after - begin)
        out[begin] = 32
        out[end[last]], out[end[last] + 1] = 32, 10
        return out, begin, end

    def texts(self, places: np.ndarray, size: int) -> list[bytes]:
        """The runs' words joined by one space."""
        starts, ends, whole = self.words.starts, self.words.ends, self.whole
        tight = np.ones(len(places), dtype=bool)  # words that stand one space apart
        for k in range(size - 1):
            tight &= starts[places + k + 1] - ends[places + k] == 1
        runs = zip(places.tolist(), starts[places].tolist(), ends[places + size - 1].tolist(), tight.tolist(), strict=True)
        return [whole[s:e] if alike else b" ".join(whole[starts[p + k] : ends[p + k]] for k in range(size)) for p, s, e, alike in runs]


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes from each start on, one stretch after the other; places beside the data give any byte."""
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    at += np.arange(len(at))
    return data.take(at, mode="clip")


def part_of(keys: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Which of so many parts the keys are dealt to."""
    return (((keys >> np.uint64(32)) * parts.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)


def counters(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mixed(hashes + _SALTS[row]) & np.uint64(width - 1)).astype(np.int64)


class Sketch:
    """A bit for each counter that reaches the threshold, by level and row; a level is the phrases of one, of two, or of more words."""

    def __init__(self, width: int):
        self.width, self.bits = width, {}

    def may_reach(self, level: int, hashes: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(hashes), dtype=bool), np.arange(len(hashes))
        for row in range(ROWS):
            at = counters(hashes[left], row, self.width)
            left = left[(self.bits[level, row][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
        out[left] = True
        return out

    def open_runs(self, pieces: Pieces, salts: np.ndarray, below: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size, places, hashes) of the runs that pass, with their shorter parts, the levels up to ``below``; ``salts`` are the words' languages."""
        alive = None
        for size in range(1, most + 1):
            hashes, inside = pieces.runs(size)
            if not len(hashes):
                return
            hashes = hashes + salts[: len(hashes)]
            if alive is not None:
                inside = inside & alive[: len(hashes)] & alive[1 : len(hashes) + 1]
            places, level = np.flatnonzero(inside), min(size, 3)
            hashes = hashes[places]
            if level <= below:
                some = self.may_reach(level, hashes)
                inside[places] = some
                places, hashes = places[some], hashes[some]
            yield size, places, hashes
            alive = inside


def languages(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Pieces, np.ndarray]]:
    """Languages of the texts, their pieces, and each word's hash of its language."""
    for batch in batches:
        names = batch.column(0).to_pylist()
        known = {name: language_hash(name) for name in set(names)}
        for a, b, data, offsets in text_slices(batch.column(1)):
            pieces = Pieces(data, offsets)
            salts = np.array([known[n] for n in names[a:b]], dtype=np.uint64)
            yield names[a:b], pieces, salts[pieces.owner]


def summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counters and their sums, of numbers with a counter above 32 bits and a count in them."""
    both = np.sort(np.concatenate(parts))
    at = (both >> np.uint64(32)).astype(np.int64)
    both &= np.uint64(0xFFFFFFFF)
    edges = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    return at[edges], np.add.reduceat(both, edges) if len(at) else both


def packed_range(at: np.ndarray, n: np.ndarray, span: int) -> bytes:
    """A range's counts: the counters' gaps and the counts, or all counters of the range where many have come."""
    if len(at) * 8 < span:
        gaps = np.diff(at, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T
        return zstandard.compress(b"\1" + gaps.tobytes() + n.tobytes(), 1)
    dense = np.zeros(span, dtype=n.dtype)
    dense[at] = n
    return zstandard.compress(b"\0" + dense.tobytes(), 1)


def add_range(sums: np.ndarray, data: bytes, kind: type) -> None:
    raw = zstandard.decompress(data)
    if raw[0]:
        n = (len(raw) - 1) // (4 + np.dtype(kind).itemsize)
        gaps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 1).reshape(4, n).T).view(np.uint32).ravel()
        sums[np.cumsum(gaps, dtype=np.int64)] += np.frombuffer(raw, kind, n, 1 + 4 * n)
    else:
        sums += np.frombuffer(raw, kind, len(sums), 1)


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def with_level(rows: DataFrame, sketch: Sketch, level: int, rules: Rules) -> None:
    """Counts the level's phrases over all texts and adds its bits to the sketch."""
    width, sizes = sketch.width, range(level, rules.words + 1) if level == 3 else range(level, level + 1)
    held, least, span = rows.sparkSession.sparkContext.broadcast(sketch), rules.least, min(RANGE, sketch.width)
    kind = np.uint8 if least < 256 else np.uint32  # whether a sum reaches the threshold is the same with parts cut at it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        parts: dict[int, list] = {row: [] for row in range(ROWS)}

        def told() -> Iterator[pa.RecordBatch]:
            for row, some in parts.items():
                if some:
                    at, n = summed(some)
                    some.clear()
                    edges = np.searchsorted(at, np.arange(0, width + 1, span))
                    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                        if b > a:
                            data = packed_range(at[a:b] - k * span, np.minimum(n[a:b], least).astype(kind), span)
                            yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["row", "range", "counts"])

        size_held = 0
        for _, pieces, salts in sliced(batches):
            for size, _, hashes in known.open_runs(pieces, salts, level - 1, max(sizes)):
                if size in sizes:
                    for row in range(ROWS):
                        at, n = np.unique(counters(hashes, row, width), return_counts=True)
                        parts[row].append(at.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))
                        size_held += len(at)
            if size_held > HELD:
                yield from told()
                size_held = 0
        yield from told()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def told() -> pa.RecordBatch:
            bits = np.packbits(sums >= least).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], names=["row", "range", "bits"])

        for batch in batches:
            for row, k, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (row, k):
                    if now:
                        yield told()
                    now, sums = (row, k), np.zeros(span, dtype=np.int64)
                add_range(sums, data, kind)
        if now:
            yield told()

    partial = rows.mapInArrow(trimmed(count), "row int, range int, counts binary").repartition("row", "range").sortWithinPartitions("row", "range")
    found = partial.mapInArrow(trimmed(add), "row int, range int, bits binary").collect()  # at most MOST_COUNTERS / 8 bytes a row, whatever the input
    for row in range(ROWS):
        bits = np.zeros((width + 7) // 8, dtype=np.uint8)
        for r in found:
            if r.row == row:
                bits[r.range * span // 8 : r.range * span // 8 + len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        sketch.bits[level, row] = bits


def candidates(rows: DataFrame, sketch: Sketch, rules: Rules) -> DataFrame:
    """(lang, phrase) that may come often enough, of one word and more, once each; and (lang, null, n), the number of all words."""
    held, buckets = rows.sparkSession.sparkContext.broadcast(sketch), max(16, sketch.width >> 19)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, waiting = held.value, np.zeros(0, dtype=np.uint64), 0
        words: Counter = Counter()
        fresh: dict[tuple[str, int], list[bytes]] = defaultdict(list)

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, bucket), some in fresh.items():
                data = zstandard.compress(b"\n".join(sorted(some)), 1)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([bucket], pa.int32()), pa.array([data], pa.binary()), pa.array([0], pa.int64())], names=["lang", "bucket", "phrases", "n"])
            fresh.clear()

        for names, pieces, salts in sliced(batches):
            for name, n in zip(names, pieces.words.counts.tolist(), strict=True):
                words[name] += n
            for size, places, hashes in known.open_runs(pieces, salts, 3, rules.words):
                first, at = np.unique(hashes, return_index=True)
                spot = np.searchsorted(seen, first)
                new = seen.take(spot, mode="clip") != first if len(seen) else np.ones(len(first), dtype=bool)
                seen = np.insert(seen, spot[new], first[new])  # only spares copies
                chosen = places[at[new]]
                waiting += len(chosen)
                for h, owner, phrase in zip((first[new] >> np.uint64(20)).tolist(), pieces.owner[chosen].tolist(), pieces.texts(chosen, size), strict=True):
                    fresh[names[owner], h % buckets].append(phrase)
            if waiting > REMEMBERED:
                yield from told()
                waiting = 0
            if len(seen) > MORE_HASHES * REMEMBERED:
                seen = seen[:0]
        yield from told()
        if words:
            yield pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array([-1] * len(words), pa.int32()), pa.array([None] * len(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "bucket", "phrases", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, total = None, set(), 0

        def told() -> pa.RecordBatch:
            some = [None] if now[1] < 0 else list(phrases)
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(some)), pa.array(some, pa.binary()), pa.array([total] * len(some), pa.int64())], names=["lang", "phrase", "n"])

        for batch in batches:
            for lang, bucket, data, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now != (lang, bucket):
                    if now:
                        yield told()
                    now, phrases, total = (lang, bucket), set(), 0
                total += n
                if data is not None:
                    phrases.update(zstandard.decompress(data).split(b"\n"))
        if now:
            yield told()

    picked = rows.mapInArrow(trimmed(pick), "lang string, bucket int, phrases binary, n long")
    return picked.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(trimmed(merge), "lang string, phrase binary, n long")


def guarded(text: bytes) -> str:
    """A text's words with a space on both sides each, and a line feed between pieces."""
    pieces = (b" ".join(p.split()) for p in text.translate(_PLAIN).split(b"\n"))
    return " " + b" \n ".join(p for p in pieces if p).decode("utf-8", "surrogateescape") + " "


def compiled(phrases: DataFrame, folder: str) -> DataFrame:
    """(lang, parts, part, file, n) of the automata written: a language's phrases are dealt by their first two words to as many parts as it needs."""
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)

    def build(group: pa.Table) -> pa.Table:
        import ahocorasick
        from pyspark import TaskContext

        some = sorted(p.decode("utf-8", "surrogateescape") for p in group["phrase"].to_pylist())
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, phrase in enumerate(some):
            automaton.add_word(f" {phrase} ", i)
        automaton.make_automaton()
        files, base = file_system(folder)
        # an attempt has its own file; the table names those that count
        name = f"{uuid.uuid4().hex}-{TaskContext.get().taskAttemptId()}.automaton"
        for suffix, held in (("", (len(some), automaton)), (".phrases", some)):
            with files.open_output_stream(f"{base}/{name}{suffix}", compression=None) as sink:
                sink.write(pickle.dumps(held, protocol=5))
        return pa.table({"lang": group["lang"][:1], "parts": group["parts"][:1], "part": group["part"][:1], "file": [name], "n": pa.array([len(some)], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(2).to_numpy()
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                first = words.first[:-1]
                keys, longer = words.hashes[first], np.flatnonzero(words.counts > 1)
                keys[longer] = run_hashes(words.hashes, 2)[first[longer]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(3)), pa.array(part_of(keys, parts[a:b]))], names=["lang", "phrase", "parts", "part"])

    parts = phrases.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / PHRASES).alias("parts"))
    dealt = phrases.join(parts, "lang").select("lang", "phrase", "parts").mapInArrow(trimmed(deal), "lang string, phrase binary, parts long, part long")
    return written(dealt.groupBy("lang", "part").applyInArrow(build, "lang string, parts long, part long, file string, n long"), "automata")


def stretches(rows: DataFrame, sketch: Sketch, dealt: dict[str, dict[int, str]], parts: dict[str, int], size: int, rules: Rules) -> DataFrame:
    """(file, share, text): for each automaton the stretches of text in which the sketch leaves phrases that are dealt to it, each place once."""
    held, words = rows.sparkSession.sparkContext.broadcast(sketch), rules.words
    number, files = {}, []  # a language's first part, and the parts' files
    for lang, some in dealt.items():
        number[lang] = len(files)
        files += [some.get(k) for k in range(parts[lang])]
    shares = max(1, 2 * size // (SHARE * max(1, len(files))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, waiting, sizes = held.value, defaultdict(list), Counter()
        sent = TaskContext.get().partitionId()

        def told(some: list[int]) -> pa.RecordBatch:
            nonlocal sent
            data = [zstandard.compress(b"".join(waiting.pop(k)), 1) for k in some]
            share = (sent + np.arange(len(some))) % shares
            sent += len(some)
            for k in some:
                del sizes[k]
            return pa.RecordBatch.from_arrays([pa.array([files[k] for k in some], pa.string()), pa.array(share.astype(np.int32)), pa.array(data, pa.binary())], names=["file", "share", "text"])

        for names, pieces, salts in sliced(batches):
            longest = np.zeros(len(salts), dtype=np.int64)
            for length, places, _ in known.open_runs(pieces, salts, 3, words):
                longest[places] = length
            one, two = np.flatnonzero(longest), np.flatnonzero(longest > 1)
            if not len(one):
                continue
            keys = np.concatenate([pieces.words.hashes[one], run_hashes(pieces.words.hashes, 2)[two]])
            start, end = np.concatenate([one, two]), np.concatenate([one + 1, two + longest[two]])
            owner = pieces.owner[start]
            part = np.array([number[x] for x in names])[owner] + part_of(keys, np.array([parts[x] for x in names])[owner])
            # stretches of a part that overlap are one
            width = len(salts) + 1
            order = np.argsort(part * width + start, kind="stable")
            part, start = part[order], start[order]
            reach = np.maximum.accumulate(part * width + end[order])
            fresh = np.flatnonzero(np.append(True, (part * width + start)[1:] > reach[:-1]))
            part, start, end = part[fresh], start[fresh], reach[np.append(fresh[1:], len(reach)) - 1] % width
            whole, begin, over = pieces.guarded()
            length = over[end - 1] - begin[start] + 2
            data, after = gathered(whole, begin[start], length), np.cumsum(length)
            data[after - 2], data[after - 1] = 32, 10
            edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part))
            ends = np.append(0, after)[edges]
            for k, a, b in zip(part[edges[:-1]].tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
                if files[k]:
                    waiting[k].append(data[a:b].tobytes())
                    sizes[k] += b - a
            if full := [k for k, n in sizes.items() if n >= STRETCHES]:
                yield told(full)
            if sizes.total() > HELD_BYTES:
                yield told(list(sizes))
        yield told(list(sizes))

    return rows.mapInArrow(trimmed(run), "file string, share int, text binary")


def scanned(rows: DataFrame, sketch: Sketch, dealt: dict[str, dict[int, str]], parts: dict[str, int], folder: str, size: int, rules: Rules) -> DataFrame:
    """(lang, phrase, a) of all phrases that come ``least`` times or more, from the sums of all tasks' counts; ``dealt`` are the languages' automata by part."""
    languages, least = {name: lang for lang, some in dealt.items() for name in some.values()}, rules.least
    many = {lang: some for lang, some in dealt.items() if parts[lang] > 1}
    automata = {lang: list(some.values()) for lang, some in dealt.items() if lang not in many}

    def read(name: str):
        files, base = file_system(folder)
        with files.open_input_file(f"{base}/{name}") as source:
            return pickle.loads(source.read())

    def matches(automaton, text: str, n: int) -> np.ndarray:
        return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), dtype=np.int64), minlength=n)

    def sums_told(name: str, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(total), SLICE):
            part = total[a : a + SLICE]
            if part.any():
                data = packed(part.astype(np.uint16) if part.max() < 1 << 16 else part)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a], pa.int64()), pa.array([data], pa.binary())], names=["file", "first", "counts"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, automaton, total = None, None, np.zeros(0, dtype=np.int64)
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if name != now:
                    yield from sums_told(now, total)
                    automaton = None  # one at a time
                    now, (n, automaton) = name, read(name)
                    total = np.zeros(n, dtype=np.int64)
                total += matches(automaton, zstandard.decompress(data.as_py()).decode("utf-8", "surrogateescape"), len(total))
        yield from sums_told(now, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        counts: dict[str, np.ndarray] = {}
        size, held = 0, {}

        def scan() -> None:
            for lang, some in texts.items():
                plain = [guarded(t) for t in some]
                for name in automata.get(lang, ()):
                    if name not in held:
                        held.clear()  # one automaton at a time
                        held[name] = read(name)
                    n, automaton = held[name]
                    total = counts.setdefault(name, np.zeros(n, dtype=np.int64))
                    for a in range(0, len(plain), 64):  # several texts at once: all begin and end with a guard
                        total += matches(automaton, "\n".join(plain[a : a + 64]), n)
            texts.clear()

        def told() -> Iterator[pa.RecordBatch]:
            for name, total in counts.items():
                yield from sums_told(name, total)
            counts.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if text:
                    texts.setdefault(lang.as_py(), []).append(text)
                    size += len(text)
                    if size >= HELD_BYTES:
                        scan()
                        size = 0
                        if sum(map(len, counts.values())) > HELD_COUNTS:
                            yield from told()
        scan()
        yield from told()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def told() -> pa.RecordBatch:
            phrases, kept = read(f"{now[0]}.phrases"), np.flatnonzero(sums >= least)
            some = [phrases[now[1] + i].encode("utf-8", "surrogateescape") for i in kept.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([languages[now[0]]] * len(some), pa.string()), pa.array(some, pa.binary()), pa.array(sums[kept])], names=["lang", "phrase", "a"])

        for batch in batches:
            for name, first, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if now != (name, first):
                    if now:
                        yield told()
                    now, sums, n = (name, first), None, 0
                raw = zstandard.decompress(data)
                n = n or min(SLICE, len(read(f"{name}.phrases")) - first)
                part = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.int64)
                sums = part.astype(np.int64) if sums is None else sums + part
        if now:
            yield told()

    sums = "file string, first long, counts binary"
    partial = rows.filter(~F.col("lang").isin(list(many))).mapInArrow(trimmed(run), sums)
    if many:
        sent = stretches(rows.filter(F.col("lang").isin(list(many))), sketch, many, parts, size, rules)
        found = sent.repartition("file", "share").sortWithinPartitions("file").mapInArrow(trimmed(search), sums)
        partial = partial.unionByName(found) if automata else found
    partial = partial.repartition("file", "first").sortWithinPartitions("file", "first")
    return partial.mapInArrow(trimmed(add), "lang string, phrase binary, a long")


def collocations(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    Null texts are empty, a null language is ``und``; repeated rows count each time they come; equal scores
    are ranked by a and then by the phrase's bytes. Whole texts are read, however long. An empty table
    gives an empty result. Other columns don't matter.
    """
    spark, rows = docs.sparkSession, languages(docs, text, lang)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = 1 << max(0, min(MOST_COUNTERS, max(LEAST_COUNTERS, size // BYTES_A_COUNTER)) - 1).bit_length()
    sketch = Sketch(width)
    for level in (1, 2, 3):
        with_level(rows, sketch, level, rules)
    open_phrases = written(candidates(rows, sketch, rules), "candidates")
    folder = new_folder(spark, "automata")
    automata: dict[str, dict[int, str]] = {}
    parts: dict[str, int] = {}
    for r in compiled(open_phrases.filter("phrase is not null").select("lang", "phrase"), folder).orderBy("lang", "part").collect():  # a row for each automaton
        parts[r.lang] = r.parts
        automata.setdefault(r.lang, {})[r.part] = r.file
    known = written(scanned(rows, sketch, automata, parts, folder, size, rules).select("lang", F.col("phrase").cast("string").alias("phrase"), "a"), "phrases")
    return ranked(known, open_phrases.filter("phrase is null").select("lang", "n"), rules)


def ranked(known: DataFrame, words: DataFrame, rules: Rules) -> DataFrame:
    """The result from exact counts: (lang, phrase, a) of phrases of one word and more, and (lang, n)."""
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    split = known.withColumn("words", F.split("phrase", " ")).withColumn("size", F.size("words")).filter("size > 1")
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"])
    cuts = cuts.select("lang", "phrase", "a", "k", "l", "r", F.expr("cast(cast(2000000 as decimal(18,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)").alias("score"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    inner = split.filter("size > 2").withColumn("of", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("of") + 1)))
    longer = inner.groupBy("lang", part(F.col("start"), F.col("of")).alias("phrase")).agg(F.max("a").alias("longer"))
    stay = scored.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * rules.displaced))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = stay.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rules.kept)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
