"""Dictionary-compressed WARC archives.

A Zstandard dictionary is built from a bounded sample of the records. Each archive starts with a
skippable frame that holds the dictionary; then every record is a frame of its own, so it can be read
alone. Records whose payload equals that of another are written as revisits without their payload.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import file_system, new_folder, trimmed, written

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
#: The dictionary is built from at most so many records, of at most so many bytes in all, and has at most so many bytes.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 4 << 20, 64 << 10
LEVEL = 3
#: Archives are read so many bytes at a time.
READ_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the payload's size and digest in its headers, and no block."""
    block = b"" if revisit else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """The headers (names in lower case) and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return headers, rest[:size]


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the samples themselves serve as one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def sampled(pages: DataFrame, html: str) -> list[bytes]:
    """Payloads of at most SAMPLE_RECORDS records, as they come first, cut so that all have SAMPLE_BYTES at most."""
    rows = pages.select(F.substring(F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), 1, SAMPLE_BYTES // SAMPLE_RECORDS // 4).alias("html")).limit(SAMPLE_RECORDS).collect()
    return [r.html.encode() for r in rows if r.html]


def revisits(pages: DataFrame, page_id: str, html: str, least: int) -> DataFrame:
    """Digest and largest page_id of the payloads of at least ``least`` bytes that more than one record has."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit(""))
    digests = pages.select(F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("size"), F.col(f"`{page_id}`").cast("long").alias("page_id"))
    found = digests.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return found.filter("copies > 1 and first is not null").select("digest", "first")


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> list[dict]:
    """Write a record for every row, an archive for each task, and return the archives' manifest (file, records, bytes).

    Of records with equal payloads of at least ``least`` bytes, that with the largest page_id is the
    response and the others revisit it; smaller ones are all responses. Null payloads are empty; a
    row without a page_id never serves as another's response, and without any other it is one itself;
    of repeated rows with the largest page_id all are responses; other columns don't matter; an empty table gives no archive. A task
    writes under another name until its archive is whole, so running it again does no harm.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "warc")
    trained = dictionary(sampled(pages, html))
    known = written(revisits(pages, page_id, html, least), "warc-revisits")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    rows = rows.join(known, "digest", "left").select("page_id", "url", "payload", "digest", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = file_system(folder)
        name = f"{base}/pages-{context.partitionId():06d}"
        draft, sink, count, size = f"{name}.{context.taskAttemptId()}.draft", None, 0, 0
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None, write_checksum=True, write_content_size=True)
        for batch in batches:
            if batch.num_rows and sink is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(draft, compression=None)
                frame = struct.pack("<II", DICTIONARY_FRAME, len(trained)) + trained
                sink.write(frame)
                size = len(frame)
            for i in range(batch.num_rows):
                page, address, payload, digest, first = (batch.column(k)[i].as_py() for k in range(5))
                packed = packer.compress(record(page, address, payload, digest, first, first is not None and first != page))
                sink.write(struct.pack("<III", 0x184D2A5E, 4, len(packed)) + packed)
                count, size = count + 1, size + len(packed) + 12
        if sink is not None:
            sink.close()
            files.move(draft, f"{name}.warc.zst")
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name[len(base) + 1:]}.warc.zst"], "records": [count], "bytes": [size]})

    return [r.asDict() for r in rows.mapInArrow(trimmed(run), "file string, records long, bytes long").collect()]


def records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an archive, one at a time. Each follows a skippable frame with its packed length."""
    import zstandard

    files, path = file_system(uri)
    with files.open_input_stream(path, compression=None, buffer_size=READ_BYTES) as source:
        magic, length = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} has no dictionary frame")
        held = source.read(length)
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
        while head := source.read(12):
            yield parsed(unpacker.decompress(source.read(struct.unpack("<III", head)[2])))


def read_archives(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null for revisits) of every record; sizes and digests of responses come from what was read."""
    def number(value: str) -> int | None:
        digits = value.removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(fields))

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                rows, size = [], 0
                for headers, block in records(uri):
                    revisit = headers["warc-type"] == "revisit"
                    digest = headers["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(block).hexdigest()
                    length = int(headers["warc-payload-length"]) if revisit else len(block)
                    refers = number(headers["warc-refers-to"]) if revisit else None
                    rows.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), headers["warc-type"], refers, length, digest, None if revisit else block))
                    size += len(block)
                    if size > READ_BYTES or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.createDataFrame([(m["file"],) for m in manifest], "file string")
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    return files.repartition(max(1, len(manifest)), "file").mapInArrow(trimmed(run), schema)
