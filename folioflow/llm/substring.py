"""Substring deduplication with suffix automata of reference shards.

A window is ``length`` consecutive words. A word goes if a window that covers it also starts in a
document with a smaller doc_id, judged on the input.

1. Every document's runs of half a window are hashed and winnowed: of each window's runs the one with
   the least hash is a fingerprint, so equal windows have equal fingerprints. Fingerprints of two or
   more documents are kept, with the least doc_id.
2. Stretches of documents around such fingerprints are written in segments; only they can hold repeated
   windows. Segments overlap, so that each window lies in one.
3. The hashes of the windows in them give, for each window, the least document that has it, and so the
   segments that serve as references. Exact copies need only the first of them.
4. Reference segments are packed into shards of bounded size. A shard's suffix automaton, by words, knows
   for each state the least document that it occurs in; it is a file in the shared folder, which every
   task that serves the shard loads. (Sent by the driver, all of them would outgrow its memory.)
5. Segments stream through the automata of the shards that they share windows with; the matching
   statistics, followed up to ``length`` words, give the windows that an earlier document has.

Hashes only choose what is compared; what is removed has been matched word by word.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import file_system, free_name, new_folder, read_pairs, runs_of, trimmed, write_pairs, written
from folioflow.llm.hashing import Words, run_hashes, text_hashes, text_slices

#: Workers hold the repeated fingerprints if there are at most so many (16 bytes each); else they are joined.
MOST_HELD = 6_000_000
#: Removed spans go to all executors if they have at most so many bytes; else they are joined.
MOST_SENT = 32 << 20
#: Words of a segment that windows start at, segments of a shard, and segments that a task streams through a shard's automaton.
SEGMENT, SHARD, SERVED = 2048, 64, 1024


class SuffixAutomaton:
    """All runs of words of some documents, with the states' links and lengths and the least document of each."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first: list[int] = [NOWHERE]
        self.last = 0

    def extend(self, word, doc: int) -> None:
        nexts, link, length = self.next, self.link, self.length
        new = len(nexts)
        nexts.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        self.first.append(doc)
        p = self.last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nexts)
                nexts.append(nexts[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                self.first.append(NOWHERE)
                while p >= 0 and nexts[p].get(word) == q:
                    nexts[p][word] = clone
                    p = link[p]
                link[q] = link[new] = clone
        self.last = new

    def add(self, words: list, doc: int) -> None:
        """A document's run of words; a word that no document has ends it."""
        for word in words:
            self.extend(word, doc)
        self.extend((len(self.next),), NOWHERE)

    def parts(self) -> tuple:
        return self.next, self.link, self.length, self.first

    @classmethod
    def of(cls, parts: tuple) -> SuffixAutomaton:
        new = cls()
        new.next, new.link, new.length, new.first = parts
        return new

    def finish(self) -> SuffixAutomaton:
        """A state occurs wherever those occur that link to it."""
        link, first = self.link, self.first
        for state in np.argsort(-np.array(self.length), kind="stable").tolist():
            if link[state] >= 0 and first[state] < first[link[state]]:
                first[link[state]] = first[state]
        return self

    def spans(self, words: list, least: int, doc: int) -> list[tuple[int, int]]:
        """The maximal stretches of ``words`` covered by runs of ``least`` words that a document before ``doc`` has."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        state = size = 0
        found: list[tuple[int, int]] = []
        for i, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                size = length[state]
            state = nexts[state].get(word, 0)
            size = min(size + 1, least) if state else 0
            if size == least:
                while length[link[state]] >= least:
                    state = link[state]
                if first[state] < doc:
                    start = i + 1 - least
                    if found and found[-1][1] >= start:
                        start = found.pop()[0]
                    found.append((start, i + 1))
        return found


def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` over each ``width`` values in a row, by doubling."""
    held, have = values, 1
    while have < width:
        step = min(have, width - have)
        held = op(held[: len(held) - step], held[step:])
        have += step
    return held


def fingerprints(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the winnowed runs of half a window, in texts that have a window."""
    gram = length // 2
    width = length - gram + 1
    hashes = run_hashes(words.hashes, gram)
    if len(hashes) < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    left = words.left()[: len(hashes)]
    hashes = np.where(left >= gram, hashes, np.uint64(2**64 - 1))
    least = sliding(np.minimum, hashes, width)
    # only windows that lie in one text choose
    least = np.where(left[: len(least)] >= length, least, np.uint64(0))
    edge = np.zeros(width - 1, dtype=np.uint64)
    best = sliding(np.maximum, np.concatenate([edge, least, edge]), width)
    chosen = np.flatnonzero((best == hashes) & (left >= gram))
    return chosen, hashes[chosen]


def owners(words: Words, places: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, places, side="right") - 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


#: Larger than any document.
NOWHERE = 1 << 63


@lru_cache(maxsize=1)
def held_fingerprints(folder: str) -> tuple[np.ndarray, np.ndarray]:
    """All repeated fingerprints, ascending as signed numbers, with the least doc_id of each."""
    return read_pairs(folder, "int64")


def stretches(hit: np.ndarray, n: int, length: int) -> list[tuple[int, int]]:
    """The stretches of a text of ``n`` words that windows with a fingerprint at one of ``hit`` cover."""
    gram = length // 2
    low = np.maximum(hit - (length - gram), 0)
    high = np.minimum(hit + length, n)
    keep = high - low >= length
    low, high = low[keep], high[keep]
    if not len(low):
        return []
    fresh = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    return list(zip(low[fresh].tolist(), high[np.append(fresh[1:] - 1, len(high) - 1)].tolist(), strict=True))


def row_key(text: str) -> Column:
    """Tells unlike texts of one doc_id apart."""
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def repeated_spans(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, spans) of the rows of which words go; spans are pairs of word places, as little-endian 32-bit integers in binaries."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"), row_key(text).alias("key")).filter("doc_id is not null")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                places, hashes = fingerprints(words, length)
                long = np.flatnonzero(words.counts >= length)
                whole = text_hashes(words.hashes, words.first)[long]
                own = a + np.concatenate([owners(words, places), long])
                at = np.concatenate([places - words.first[owners(words, places)], np.full(len(long), -1)])
                yield pa.RecordBatch.from_arrays([signed(np.concatenate([hashes, whole])), pa.array(names[own]), pa.array(keys[own]), pa.array(at.astype(np.int32))], names=["fp", "doc", "key", "place"])

    marks = rows.mapInArrow(trimmed(mark), "fp long, doc long, key long, place int")
    repeated = written(marks.groupBy("fp").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("fp", "first"), "fingerprints")
    if repeated.count() <= MOST_HELD:
        folder = write_pairs(repeated.select("fp", "first"), "fingerprints-held", "int64")
        hits = rows.withColumn("hits", F.lit(None).cast("binary")).withColumn("copy_of", F.lit(None).cast("long"))
    else:
        folder = None
        met = marks.join(repeated, "fp").groupBy("doc", "key").agg(F.collect_list(F.when(F.col("place") >= 0, F.col("place"))).alias("places"), F.min(F.when(F.col("place") < 0, F.col("first"))).alias("copy_of"))
        hits = rows.join(met.withColumnRenamed("doc", "doc_id"), ["doc_id", "key"]).select("doc_id", "text", "key", F.array_join(F.col("places").cast("array<string>"), " ").cast("binary").alias("hits"), "copy_of")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, firsts = held_fingerprints(folder) if folder else (None, None)

        def look(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            hashes = hashes.view(np.int64)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            found = known[at] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
            return found, at

        for batch in batches:
            names, keys = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for a, b, data, offsets in text_slices(batch.column(1)):
                words = Words(data, offsets)
                if folder:
                    places, hashes = fingerprints(words, length)
                    places = places[look(hashes)[0]]
                    copied, at = look(text_hashes(words.hashes, words.first))
                    bounds = np.searchsorted(places, words.first)
                for i in np.flatnonzero(words.counts >= length).tolist():
                    first, n = int(words.first[i]), int(words.counts[i])
                    if folder:
                        hit = places[bounds[i] : bounds[i + 1]] - first
                        origin = int(firsts[at[i]]) if copied[i] else None
                    else:
                        hit = np.unique(np.array(batch.column(3)[a + i].as_py().split(), dtype=np.int64))
                        origin = batch.column(4)[a + i].as_py()
                    origin = origin if origin is not None and origin < names[a + i] else None
                    for x, y in stretches(hit, n, length):
                        for low in range(x, y - length + 1, SEGMENT):
                            high = min(low + SEGMENT + length - 1, y)
                            run = b" ".join(data[s:e].tobytes() for s, e in zip(words.starts[first + low : first + high], words.ends[first + low : first + high], strict=True))
                            out.append((names[a + i], keys[a + i], low, run, origin))
            if out:
                types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc", "key", "at", "run", "copy_of"])
        held_fingerprints.cache_clear()

    picked = hits.mapInArrow(trimmed(pick), "doc long, key long, at int, run binary, copy_of long")
    segment = lambda doc: F.xxhash64(doc, F.col("key"), F.col("at"))
    parts = written(picked.withColumn("seg", segment(F.col("doc"))), "stretches")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, segs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, data, offsets in text_slices(batch.column(2)):
                words = Words(data, offsets)
                hashes = run_hashes(words.hashes, length)
                whole = np.flatnonzero(words.left()[: len(hashes)] >= length)
                own = a + owners(words, whole)
                yield pa.RecordBatch.from_arrays([signed(hashes[whole]), pa.array(docs[own]), pa.array(segs[own])], names=["window", "doc", "seg"])

    seen = parts.filter("copy_of is null").select("doc", "seg", "run").mapInArrow(trimmed(windows), "window long, doc long, seg long")
    # a table of its own: then both sides of the join are dealt out for it alone, and a window that very many have can be split
    least = seen.groupBy("window").agg(F.min(F.struct("doc", "seg")).alias("ref"), F.max("doc").alias("last")).filter("ref.doc < last")
    firsts = written(least.select("window", F.col("ref.doc").alias("ref"), F.col("ref.seg").alias("ref_seg")), "windows")
    needs = seen.join(firsts, "window").filter("doc > ref").select("seg", "ref_seg")
    copies = parts.filter("copy_of is not null").select("seg", segment(F.col("copy_of")).alias("ref_seg"))
    pairs = written(needs.unionByName(copies).distinct(), "links")
    serving = pairs.select(F.col("ref_seg").alias("seg")).distinct()
    shards = max(1, -(-serving.count() // SHARD))
    shard = lambda seg: F.pmod(F.xxhash64(F.lit(1), seg), F.lit(shards))
    folder = new_folder(docs.sparkSession, "automata")
    files, base = file_system(folder)
    files.create_dir(base, recursive=True)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, base = file_system(folder)
        for unit in runs_of(batches, 1):
            automaton, known = SuffixAutomaton(), set()
            for seg, doc, run in zip(unit["seg"].to_pylist(), unit["doc"].to_pylist(), unit["run"].to_pylist(), strict=True):
                if (seg, doc) not in known:  # rows may repeat
                    known.add((seg, doc))
                    automaton.add(run.split(), doc)
            name = f"{base}/{unit['shard'][0].as_py()}"
            with files.open_output_stream(draft := f"{name}.{TaskContext.get().taskAttemptId()}.draft", compression=None) as sink:
                sink.write(pickle.dumps(automaton.finish().parts(), protocol=5))
            files.move(draft, f"{name}.automaton")
            yield pa.RecordBatch.from_arrays([pa.array([len(known)], pa.int64())], names=["segments"])

    once = parts.join(serving, "seg").groupBy("seg", "doc").agg(F.first("run").alias("run"))
    laid = once.select(shard(F.col("seg")).alias("shard"), "seg", "doc", "run").repartition("shard").sortWithinPartitions("shard", "seg")
    laid.mapInArrow(trimmed(build), "segments long").agg(F.sum("segments")).collect()
    asked = pairs.select("seg", shard(F.col("ref_seg")).alias("shard")).distinct()
    salts = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SERVED).alias("salts"))
    asked = asked.join(salts, "shard").select("seg", "shard", F.pmod(F.xxhash64("seg"), F.col("salts")).alias("salt"))
    streams = parts.select("seg", "doc", "key", "at", "run").join(asked, "seg").repartition("shard", "salt").sortWithinPartitions("shard", "salt")

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = file_system(folder)
        held, automaton = None, None
        for batch in batches:
            out = []
            for shard, doc, key, at, run in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if shard != held:
                    automaton = None  # before the next one comes
                    with files.open_input_file(f"{base}/{shard}.automaton") as source:
                        automaton = SuffixAutomaton.of(pickle.loads(source.read()))
                    held = shard
                found = [(at + x, at + y) for x, y in automaton.spans(run.split(), length, doc)]
                if found:
                    out.append((doc, key, np.array(found, dtype="<i4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "key", "spans"])

    matched = streams.select("shard", "doc", "key", "at", "run").mapInArrow(trimmed(match), "doc_id long, key long, spans binary")
    return written(matched.groupBy("doc_id", "key").agg(F.collect_set("spans").alias("spans")), "spans")


def merged(spans: list[bytes]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for low, high in sorted(tuple(x) for part in spans for x in np.frombuffer(part, "<i4").reshape(-1, 2).tolist()):
        if found and low <= found[-1][1]:
            found[-1] = (found[-1][0], max(high, found[-1][1]))
        else:
            found.append((low, high))
    return found


def substring_dedup(docs: DataFrame, length: int = 50, text: str = "text", doc_id: str = "doc_id", columns: list[str] | None = None) -> DataFrame:
    """The rows with the kept words in ``text``, and n_words and n_removed added.

    Texts of which nothing goes come unchanged; others have their kept words joined by one space. Null
    texts stay null and have no words. Rows without a doc_id are kept whole and remove nothing from
    others; rows with equal doc ids remove nothing from one another, and each is judged by its own text; an empty
    table gives an empty result. ``columns`` names the columns to return (all, if None); n_words and n_removed replace
    columns of these names.
    """
    spans = repeated_spans(docs, length, text, doc_id)
    size = spans.agg(F.sum(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16))).first()[0] or 0
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in ("n_words", "n_removed")]
    key, content, places, body = (free_name(docs, f"substring_{x}") for x in ("key", "content", "places", "body"))
    side = spans.select(F.col("doc_id").alias(key), F.col("key").alias(content), F.col("spans").alias(places))
    others = [c for c in kept if c != text]
    rows = docs.join(F.broadcast(side) if size <= MOST_SENT else side, (F.col(f"`{doc_id}`").cast("long") == F.col(key)) & (row_key(text) == F.col(content)), "left")
    rows = rows.select(*(F.col(f"`{c}`") for c in others), F.col(f"`{text}`").cast("string").cast("binary").alias(body), places)
    schema = docs.select(*(F.col(f"`{c}`") for c in others), F.lit("").cast("string").alias(text), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed")).schema
    schema[text].nullable = True

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for value, found in zip(batch.column(len(others)), batch.column(len(others) + 1), strict=True):
                whole = value.as_py()
                words = whole.split() if whole is not None else []
                sizes.append(len(words))
                if found.is_valid and words:
                    spans = merged(found.as_py())
                    gone.append(sum(y - x for x, y in spans))
                    edges = [0, *(e for s in spans for e in s), len(words)]
                    whole = b" ".join([w for x, y in zip(edges[::2], edges[1::2], strict=True) for w in words[x:y]])
                else:
                    gone.append(0)
                texts.append(whole)
            new = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), *new], names=[*others, text, "n_words", "n_removed"])

    found = rows.mapInArrow(trimmed(cut), schema)
    order = [*kept, "n_words", "n_removed"] if text in kept else [*kept, text, "n_words", "n_removed"]
    return found.select(*(F.col(f"`{c}`") for c in order))
