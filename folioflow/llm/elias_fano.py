"""Token-ID files with Elias-Fano encoded document boundaries.

A file holds a run of documents in ascending order of doc_id:

    magic "FFTOKEN1"
    ids            all documents' ids one after another, 2 or 4 bytes each, little-endian
    boundaries     Elias-Fano: where each document ends, in ids
    doc ids        Elias-Fano: each non-null doc_id less the first of them
    tail           JSON (counts, first doc_id, places of the parts), its length in 4 bytes, the magic again

Elias-Fano keeps n ascending numbers up to u in about n (2 + log2(u / n)) bits: the low bits of each
in an array, the high parts in unary. The place of every 512th unary mark is kept in 4 bytes, so that
``select`` finds any number by reading a few bytes, and no table of 64-bit offsets is needed.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.bpe import SLICE_BYTES, encoder_of
from folioflow.llm.common import file_system, new_folder, trimmed
from folioflow.llm.hashing import text_slices

MAGIC = b"FFTOKEN1"
SAMPLE = 512
#: Numbers are packed so many at a time, and ids are read for so many documents at a time.
BLOCK = 1 << 14
READ_DOCS = 256
#: A file holds the ids of about so many bytes of text.
FILE_BYTES = 64 << 20


class EliasFano:
    """Ascending non-negative integers, packed."""

    def __init__(self, data: bytes):
        self.n, self.width, marks, samples = struct.unpack_from("<QBQI", data)
        at = struct.calcsize("<QBQI")
        self.low = np.frombuffer(data, np.uint8, (self.n * self.width + 7) // 8, at)
        at += len(self.low)
        self.high = np.frombuffer(data, np.uint8, (marks + 7) // 8, at)
        at += len(self.high)
        self.samples = np.frombuffer(data, "<u4", samples, at)

    @staticmethod
    def pack(numbers: np.ndarray) -> bytes:
        numbers = np.asarray(numbers, dtype=np.uint64)
        n = len(numbers)
        top = int(numbers[-1]) if n else 0
        width = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        low = bytearray()
        for i in range(0, n, BLOCK):
            bits = (numbers[i : i + BLOCK, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
            low += np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
        places = (numbers >> np.uint64(width)).astype(np.int64) + np.arange(n)
        length = int(places[-1]) + 1 if n else 0
        unary = np.zeros(length, dtype=np.uint8)
        unary[places] = 1
        samples = places[::SAMPLE].astype("<u4")
        return struct.pack("<QBQI", n, width, length, len(samples)) + bytes(low) + np.packbits(unary, bitorder="little").tobytes() + samples.tobytes()

    def select(self, first: int, last: int) -> np.ndarray:
        """The numbers at the places from ``first`` up to, not including, ``last``."""
        first, last = max(0, first), min(self.n, last)
        if first >= last:
            return np.zeros(0, dtype=np.int64)
        start = int(self.samples[first // SAMPLE])
        end = int(self.samples[-(-last // SAMPLE)]) if -(-last // SAMPLE) < len(self.samples) else 8 * len(self.high)
        byte = start // 8
        marks = np.flatnonzero(np.unpackbits(self.high[byte : end // 8 + 1], bitorder="little")) + 8 * byte
        marks = marks[np.searchsorted(marks, start) :][first % SAMPLE :][: last - first]
        high = marks - np.arange(first, last)
        a, b = first * self.width, last * self.width
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
        low = bits.reshape(last - first, self.width).astype(np.int64) @ (np.int64(1) << np.arange(self.width, dtype=np.int64))
        return (high.astype(np.int64) << self.width) | low


MANIFEST = T.StructType(
    [T.StructField("file", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("docs", T.LongType()), T.StructField("ids", T.LongType()), T.StructField("bytes", T.LongType())]
)


def encoded(rows: DataFrame, vocabulary: str, end_id: int, edges: list[int]) -> DataFrame:
    """part (how many of ``edges`` a doc_id exceeds), doc_id and ids (2 or 4 bytes each, ``end_id`` last) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, inner = encoder_of(vocabulary), np.array(edges, dtype=np.int64)
        kind = "<u4" if len(encoder.tokens) > 1 << 16 or end_id >= 1 << 16 else "<u2"
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1), SLICE_BYTES):
                ids, bounds = encoder.flat_ids(data, offsets)
                ids = np.insert(ids.astype(kind), bounds[1:], end_id)
                ends = ((bounds + np.arange(b - a + 1)) * ids.itemsize).astype(np.int32)
                found = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                names = batch.column(0).slice(a, b - a)
                known = names.is_valid().to_numpy(zero_copy_only=False)
                part = np.where(known, np.searchsorted(inner, names.fill_null(0).to_numpy()), 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(part), names, found, pa.array(np.full(b - a, kind == "<u4"))], names=["part", "doc_id", "ids", "wide"])

    return rows.mapInArrow(trimmed(run), "part int, doc_id long, ids binary, wide boolean")


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", file_bytes: int = FILE_BYTES) -> list[dict]:
    """Encode every whole text, add ``end_id``, and write files in ascending order of doc_id; the files' manifest is returned.

    Texts are encoded where they lie; only their ids move, to ranges of doc_id with about equally many
    documents, a range for about ``file_bytes`` of text. A range's file is written under another name
    until it is whole, so a task that runs again only replaces the file by its like. Null texts count as
    empty (the end id alone), null doc ids come first, equal doc ids stay neighbours in the order of
    their ids, a doc_id that is no whole number raises, other columns don't matter, and an empty table
    gives no file. The manifest has a row a file; documents and ids stay on the executors.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // file_bytes))
    edges = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] or [])) if parts > 1 else []
    laid = encoded(rows, vocabulary, end_id, edges).repartitionById(len(edges) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder_of.cache_clear()  # a worker that has encoded before needs its vocabulary no more
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        held: PartFile | None = None
        for batch in batches:
            parts = batch.column(0).to_numpy()
            bounds = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else [0]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if held is None or held.part != parts[a]:
                    if held is not None:
                        yield held.whole()
                    held = PartFile(folder, int(parts[a]), TaskContext.get().taskAttemptId(), batch.column(3)[a].as_py())
                held.add(batch.column(1).slice(a, b - a).to_pylist(), batch.column(2).slice(a, b - a))
        if held is not None:
            yield held.whole()

    return [r.asDict() for r in laid.mapInArrow(trimmed(run), MANIFEST).collect()]


class PartFile:
    """A file as it is written."""

    def __init__(self, folder: str, part: int, attempt: int, wide: bool):
        self.files, base = file_system(folder)
        self.folder, self.part, self.wide, self.name = folder, part, wide, f"tokens-{part:07d}.ids"
        self.target, self.draft = f"{base}/{self.name}", f"{base}/{self.name}.{attempt}.draft"
        self.sink = self.files.open_output_stream(self.draft, compression=None)
        self.sink.write(MAGIC)
        self.ends, self.names, self.total = [], [], 0

    def add(self, names: list[int | None], ids: pa.Array) -> None:
        for each in ids:
            flat = each.as_py()
            self.sink.write(flat)
            self.total += len(flat) // (4 if self.wide else 2)
            self.ends.append(self.total)
        self.names += names

    def whole(self) -> pa.RecordBatch:
        """Ends the file and tells its row of the manifest."""
        nulls = sum(x is None for x in self.names)
        known = np.array(self.names[nulls:], dtype=np.int64)
        first = int(known[0]) if len(known) else 0
        bounds = EliasFano.pack(np.array(self.ends, dtype=np.uint64))
        keys = EliasFano.pack((known - first).astype(np.uint64))
        tail = json.dumps({"docs": len(self.ends), "nulls": nulls, "first": first, "ids": self.total, "wide": self.wide, "bounds": len(bounds), "keys": len(keys)}).encode()
        self.sink.write(bounds + keys + tail + struct.pack("<I", len(tail)) + MAGIC)
        self.sink.close()
        self.files.move(self.draft, self.target)
        size = len(MAGIC) * 2 + self.total * (4 if self.wide else 2) + len(bounds) + len(keys) + len(tail) + 4
        return pa.RecordBatch.from_pydict({"file": [f"{self.folder}/{self.name}"], "part": pa.array([self.part], pa.int32()), "docs": [len(self.ends)], "ids": [self.total], "bytes": [size]})


class TokenFile:
    """Random access to one file."""

    def __init__(self, uri: str):
        files, path = file_system(uri)
        self.source = files.open_input_file(path)
        size = self.source.size()
        end = self.source.read_at(len(MAGIC) + 4, size - len(MAGIC) - 4)
        if end[4:] != MAGIC or self.source.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        (length,) = struct.unpack("<I", end[:4])
        at = size - len(MAGIC) - 4 - length
        self.about = json.loads(self.source.read_at(length, at))
        self.width = 4 if self.about["wide"] else 2
        at -= self.about["keys"]
        self.keys = EliasFano(self.source.read_at(self.about["keys"], at))
        at -= self.about["bounds"]
        self.bounds = EliasFano(self.source.read_at(self.about["bounds"], at))

    def documents(self, first: int, last: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start and ids of the documents at the places from ``first`` up to ``last``."""
        ends = self.bounds.select(first, last)
        start = int(self.bounds.select(first - 1, first)[0]) if first else 0
        nulls = self.about["nulls"]
        known = self.keys.select(max(0, first - nulls), max(0, last - nulls)) + self.about["first"]
        names = [*[None] * (len(ends) - len(known)), *known.tolist()]
        whole = self.source.read_at((int(ends[-1]) - start) * self.width, len(MAGIC) + start * self.width) if len(ends) else b""
        ids = np.frombuffer(whole, "<u4" if self.width == 4 else "<u2")
        at = start
        for name, end in zip(names, ends.tolist(), strict=True):
            yield name, at, ids[at - start : end - start]
            at = end


def read_token_files(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start (ids of all documents before), and ids (little-endian unsigned 32-bit integers) of every document in the files."""
    base, rows = 0, []
    for entry in sorted(manifest, key=lambda m: m["part"]):
        rows.append((entry["file"], base))
        base += entry["ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_of.cache_clear()
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = TokenFile(uri)
                for i in range(0, held.about["docs"], READ_DOCS):
                    found = list(held.documents(i, i + READ_DOCS))
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array([f[0] for f in found], pa.int64()), "start": pa.array([before + f[1] for f in found], pa.int64()), "ids": pa.array([f[2].astype("<u4").tobytes() for f in found], pa.binary())}
                    )

    files = spark.createDataFrame(rows, "file string, before long")
    return files.repartition(max(1, len(rows)), "file").mapInArrow(trimmed(run), "doc_id long, start long, ids binary")
