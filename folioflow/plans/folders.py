"""Folders that the driver and all executors share, and files in them, through Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only in a session on one machine where that is unset, as in tests, a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            where = held.get()
        elif spark.sparkContext.master.startswith("local"):
            where = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


class Folder:
    """The files of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark.sparkContext._jvm, path
        self.files = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._at(name)
        return sorted(f.getPath().getName() for f in self.files.listStatus(at)) if self.files.exists(at) else []

    def size(self, name: str) -> int:
        at = self._at(name)
        return self.files.getContentSummary(at).getLength() if self.files.exists(at) else 0

    def read(self, name: str) -> str:
        source = self.files.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def put(self, name: str, text: str) -> bool:
        """Writes a file as a whole under a name that must be free; false where another has taken it."""
        draft = self._at(f".draft-{uuid.uuid4().hex}")
        sink = self.files.create(draft)
        try:
            sink.write(bytearray(text.encode()))
        finally:
            sink.close()
        done = not self.files.exists(self._at(name)) and self.files.rename(draft, self._at(name))
        if not done:
            self.files.delete(draft, False)
        return done

    def remove(self, name: str = "") -> None:
        self.files.delete(self._at(name), True)
