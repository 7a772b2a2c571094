"""A data source for bundles: folders of row files that are read, streamed and written by ``format("bundles")``.

A folder holds Arrow files in ``data`` and a file for each commit in ``commits``, which lists the files that
it adds, with their bytes and the least and greatest value of each plain column. Only files that a commit
lists are read. Register it with ``spark.dataSource.register(Bundles)``; options: ``path``, ``split`` (bytes
of a partition), and ``min.NAME`` and ``max.NAME`` for whole-number, fraction and text columns: files that
can't hold such rows are not opened. (Filters are not pushed: the engine keeps a reader that has taken
filters for later scans of the same table that push none, which would then lose rows.) Reading takes the
schema of the last commit unless one is given.

Writers put rows in drafts of their own; the commit moves them and lists them at once; drafts of a job
that ends without a commit are deleted, whichever tasks were lost.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import FractionalType, IntegralType, StringType, StructField, StructType

#: Bytes of a partition, of a record batch in a file, and of a file.
SPLIT, BATCH, FILE = 64 << 20, 1 << 20, 256 << 20
def _files(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def _commits(path: str) -> list[tuple[int, dict]]:
    """Commit numbers and contents, from the last that replaces all on."""
    from pyarrow import fs

    files, base = _files(path)
    found = sorted(f.path for f in files.get_file_info(fs.FileSelector(f"{base}/commits", allow_not_found=True)) if f.path.endswith(".json"))
    out: list[tuple[int, dict]] = []
    for name in found:
        with files.open_input_file(name) as source:
            told = json.loads(source.read())
        out = [*([] if told["replaces"] else out), (int(name.rsplit("/", 1)[1].removesuffix(".json")), told)]
    return out


@dataclass
class Split(InputPartition):
    """The record batches of a file that begin in a stretch of its bytes."""

    file: str
    size: int
    start: int
    end: int

    def __init__(self, file: str, size: int, start: int, end: int):
        super().__init__(0)
        self.file, self.size, self.start, self.end = file, size, start, end


class _Reading:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.split = schema.names, options["path"], int(options.get("split", SPLIT))
        self.low, self.high = ({f.name: self.value(f, options[f"{side}.{f.name}".lower()]) for f in schema if f"{side}.{f.name}".lower() in options} for side in ("min", "max"))

    @staticmethod
    def value(field: StructField, text: str):
        if isinstance(field.dataType, IntegralType):
            return int(text)
        if isinstance(field.dataType, FractionalType):
            return float(text)
        if isinstance(field.dataType, StringType):
            return text
        raise ValueError(f"{field.name} has no bounds")

    def possible(self, bounds: dict) -> bool:
        known = lambda name: bounds.get(name) is not None
        return all(not known(c) or bounds[c][1] >= v for c, v in self.low.items()) and all(not known(c) or bounds[c][0] <= v for c, v in self.high.items())

    def splits(self, commits: Iterable[dict]) -> list[Split]:
        found = [f for told in commits for f in told["files"] if self.possible(f["bounds"])]
        return [Split(f["name"], f["bytes"], at, min(at + self.split, f["bytes"])) for f in found for at in range(0, f["bytes"], self.split)]

    def rows(self, part: Split) -> Iterator[pa.RecordBatch]:
        files, base = _files(self.path)
        with files.open_input_file(f"{base}/data/{part.file}") as source, pa.ipc.open_file(source) as held:
            n = held.num_record_batches
            for i in range(n):
                if part.start <= i * part.size // n < part.end:
                    batch = held.get_batch(i).select(self.names)
                    for sides, test in ((self.low, pc.greater_equal), (self.high, pc.less_equal)):
                        for name, v in sides.items():
                            batch = batch.filter(pc.fill_null(test(batch.column(name), pa.scalar(v, batch.schema.field(name).type)), False))
                    if batch.num_rows:
                        yield batch


class BundleReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.splits(told for _, told in _commits(self.path)) or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.file else iter(())


class BundleStream(_Reading, DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max((n for n, _ in _commits(self.path)), default=-1)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.splits(told for n, told in _commits(self.path) if start["commit"] < n <= end["commit"]) or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        return self.rows(partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Made(WriterCommitMessage):
    """The drafts of a task."""

    files: list


class BundleWriter(DataSourceArrowWriter):
    def __init__(self, schema: StructType, options: dict, overwrite: bool):
        self.schema, self.path, self.overwrite, self.job = schema.json(), options["path"], overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Made:
        files, base = _files(self.path)
        folder, made = f"{base}/drafts/{self.job}", []
        files.create_dir(folder, recursive=True)
        sink = writer = None

        def close() -> None:
            writer.close()
            sink.close()
            made[-1]["bytes"] = files.get_file_info(f"{folder}/{made[-1]['name']}").size

        for batch in iterator:
            each = max(1, batch.num_rows * BATCH // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, each):
                if writer is None:
                    made.append({"name": f"{uuid.uuid4().hex}.arrow", "bounds": {}})
                    sink = files.open_output_stream(f"{folder}/{made[-1]['name']}", compression=None)
                    writer = pa.ipc.new_file(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
                part = batch.slice(at, each)
                writer.write_batch(part)
                self.bound(made[-1]["bounds"], part)
                if sink.tell() >= FILE:
                    close()
                    sink = writer = None
        if writer is not None:
            close()
        return Made(made)

    def bound(self, bounds: dict, batch: pa.RecordBatch) -> None:
        """Widens a file's bounds; a column with values that aren't plain and short, or with NaN, has none."""
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            if not (pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_string(column.type)):
                continue
            low, high = pc.min_max(column).values() if column.null_count < len(column) else (None, None)
            low, high = (v.as_py() if v is not None else None for v in (low, high))
            if low is None:
                continue
            if bounds.get(name, 0) is None or low != low or high != high or (isinstance(low, str) and len(low) + len(high) > 200) or (pa.types.is_floating(column.type) and pc.any(pc.is_nan(column)).as_py()):
                bounds[name] = None
            else:
                old = bounds.get(name) or (low, high)
                bounds[name] = (min(old[0], low), max(old[1], high))

    def commit(self, messages: list[Made | None]) -> None:
        files, base = _files(self.path)
        for folder in ("data", "commits"):
            files.create_dir(f"{base}/{folder}", recursive=True)
        made = [f for m in messages if m is not None for f in m.files]
        for f in made:
            f["bounds"] = {k: v for k, v in f["bounds"].items() if v is not None}
            files.move(f"{base}/drafts/{self.job}/{f['name']}", f"{base}/data/{f['name']}")
        number = max((n for n, _ in _commits(self.path)), default=-1) + 1
        told = {"schema": self.schema, "replaces": self.overwrite, "files": made, "at": dt.datetime.now(dt.UTC).isoformat()}
        draft = f"{base}/drafts/{self.job}/commit"
        files.create_dir(f"{base}/drafts/{self.job}", recursive=True)
        with files.open_output_stream(draft, compression=None) as sink:
            sink.write(json.dumps(told).encode())
        files.move(draft, f"{base}/commits/{number:09d}.json")
        files.delete_dir(f"{base}/drafts/{self.job}")

    def abort(self, messages: list[Made | None]) -> None:
        from pyarrow import fs

        files, base = _files(self.path)
        if files.get_file_info(f"{base}/drafts/{self.job}").type == fs.FileType.Directory:
            files.delete_dir(f"{base}/drafts/{self.job}")


class Bundles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bundles"

    def schema(self) -> StructType:
        told = _commits(self.options["path"])
        if not told:
            raise ValueError("an empty bundle has no schema; give one")
        return StructType.fromJson(json.loads(told[-1][1]["schema"]))

    def reader(self, schema: StructType) -> BundleReader:
        return BundleReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> BundleStream:
        return BundleStream(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(schema, dict(self.options), overwrite)
