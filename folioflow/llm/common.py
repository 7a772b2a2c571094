"""Shared folders, written intermediates and file access for the corpus operators."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
#: The folders made so far, in order.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset in a session on one machine,
    as in tests, a temporary folder becomes the checkpoint folder; on a cluster it has to be set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver's Python ends normally."""
    path = f"{shared_dir(spark)}/folioflow/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(path)
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer; a stopped session is left alone."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder goes with the cluster's own clean-up
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make, name: str) -> tuple[DataFrame, str]:
    """What ``make`` gives as a table, and its folder; the folders made on the way to it go as soon as it is whole."""
    before = len(_MADE)
    df = make()
    path = new_folder(spark, name)
    df.write.parquet(path)
    for other in _MADE[before:-1]:
        remove(spark, other)
    return spark.read.schema(df.schema).parquet(path), path


def file_system(uri: str):
    """An Arrow file system and the path in it, for reading and writing whole files from executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def trimmed(run):
    """A function over Arrow batches that gives free memory back to the system when a task ends.

    Workers live on between tasks and stages; what their allocators keep would count against the
    executor's memory for as long.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal (nulls too) in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        names = list(zip(*(batch.column(i).to_pylist() for i in range(keys)), strict=True))
        at = 0
        for key, group in itertools.groupby(names):
            n = sum(1 for _ in group)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(at, n))
            last, at = key, at + n
    if held:
        yield pa.Table.from_batches(held)


def give_back() -> None:
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def write_pairs(pairs: DataFrame, name: str, value_type: str) -> str:
    """Write a table of two whole numbers as files of arrays, in ranges of the first; the folder is returned.

    Executors write and read the files; a task's file gets its name when it is whole. Values have to fit
    the type.
    """
    spark = pairs.sparkSession
    folder = new_folder(spark, name)
    key, value = pairs.columns
    ordered = pairs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = file_system(folder)
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            target = f"{base}/part-{context.partitionId():06d}"
            draft = f"{target}.{context.taskAttemptId()}.draft"
            with files.open_output_stream(draft, compression=None) as sink:
                sink.write(np.concatenate([h[0] for h in held]).astype(np.int64).tobytes())
                sink.write(np.concatenate([h[1] for h in held]).astype(value_type).tobytes())
            files.move(draft, f"{target}.pairs")
        yield pa.RecordBatch.from_pydict({"parts": pa.array([len(held)], pa.int64())})

    files, base = file_system(folder)
    files.create_dir(base, recursive=True)
    ordered.mapInArrow(trimmed(run), "parts long").agg(F.sum("parts")).collect()
    return folder


def read_pairs(folder: str, value_type: str) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays of a folder, ascending by the first."""
    from pyarrow import fs

    files, base = file_system(folder)
    each = 8 + np.dtype(value_type).itemsize
    found = sorted((f for f in files.get_file_info(fs.FileSelector(base)) if f.path.endswith(".pairs")), key=lambda f: f.path)
    total, at = sum(f.size for f in found) // each, 0
    keys, values = np.empty(total, dtype=np.int64), np.empty(total, dtype=value_type)
    for f in found:
        n = f.size // each
        with files.open_input_file(f.path) as source:
            keys[at : at + n] = np.frombuffer(source.read_at(8 * n, 0), np.int64)
            values[at : at + n] = np.frombuffer(source.read_at((each - 8) * n, 8 * n), value_type)
        at += n
    return keys, values


def word_array(text: Column) -> Column:
    """The maximal runs without ASCII white space, in order; an empty array for null and blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[ \\t-\\r]+"))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a name made from it that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def free_prefix(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a prefix made from it that no column's name starts with."""
    while any(c.lower().startswith(wanted.lower()) for c in df.columns):
        wanted = f"_{wanted}"
    return wanted
