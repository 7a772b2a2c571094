"""The state of a change feed as a log-structured table: hash buckets of base and delta files, merged when read.

A micro-batch adds a delta to the buckets of its keys and touches no other. A bucket whose deltas have
grown to a share of its base is merged into a new base. What counts is told by a manifest for each
batch, a file that is there as a whole or not at all: a batch that runs again finds its manifest
and changes nothing, and files of a batch that failed are never read. Files that the last two manifests
don't name are dropped after a commit.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from folioflow.plans.folders import Folder


@dataclass(frozen=True)
class Buckets:
    """``keys`` tell items apart, ``seq`` orders their changes, ``kind`` is ``removed`` for those that end an item.

    ``share``: a bucket is merged when its deltas reach this share of its base's bytes, or ``most`` deltas.
    ``keep``: removals are remembered for so many batches, so that older changes that come late don't bring items back.
    """

    path: str
    schema: StructType
    keys: tuple[str, ...]
    seq: str = "seq"
    kind: str = "kind"
    number: int = 64
    share: float = 0.5
    most: int = 8
    keep: int = 1000

    def manifest(self, spark: SparkSession, batch: int | None = None) -> dict:
        """The manifest of a batch, or the last: for each bucket its layers, oldest first, as (folder, bytes)."""
        folder = Folder(spark, self.path)
        done = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in folder.names() if n.startswith("manifest-")]
        if batch is not None and batch not in done:
            raise ValueError(f"there is no batch {batch}")
        return json.loads(folder.read(f"manifest-{max(done) if batch is None else batch}.json")) if done else {"batch": -1, "layers": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.number)).cast("int")

    def newest(self, rows: DataFrame) -> DataFrame:
        """The last change of each item; aggregation combines before it shuffles, so a busy item is no hot task."""
        others = [c for c in rows.columns if c not in self.keys]
        best = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.struct(self.seq, "_batch")).alias("_row"))
        return best.select(*self.keys, *(F.col("_row")[c].alias(c) for c in others))

    def layers(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        inner = StructType([*self.schema.fields]).add("_batch", LongType()).add("_bucket", IntegerType())
        return spark.read.schema(inner).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else spark.createDataFrame([], inner)

    def written(self, rows: DataFrame, name: str) -> dict[str, int]:
        """Writes rows by bucket; the folders made and their bytes."""
        folder = Folder(rows.sparkSession, self.path)
        rows.withColumn("_in", F.col("_bucket")).repartition("_bucket").write.partitionBy("_in").parquet(f"{self.path}/{name}")
        return {n.removeprefix("_in="): folder.size(f"{name}/{n}") for n in folder.names(name) if n.startswith("_in=")}

    def merge(self, batch: DataFrame, number: int) -> None:
        """Takes a micro-batch into the state; for ``foreachBatch``."""
        spark = batch.sparkSession
        before = self.manifest(spark)
        if before["batch"] >= number:
            return
        layers = {k: [tuple(x) for x in v] for k, v in before["layers"].items()}
        rows = batch.select(*self.schema.names, F.lit(number).cast("long").alias("_batch"))
        delta = f"delta-{number}-{uuid.uuid4().hex[:8]}"
        touched = self.written(self.newest(rows).withColumn("_bucket", self.bucket()).select(*self.schema.names, "_batch", "_bucket"), delta)
        for k, size in touched.items():
            layers.setdefault(k, []).append((f"{delta}/_in={k}", size))
        full = [k for k in touched if len(layers[k]) > self.most or (len(layers[k]) > 1 and sum(s for _, s in layers[k][1:]) > self.share * layers[k][0][1])]
        if full:
            held = self.newest(self.layers(spark, [p for k in full for p, _ in layers[k]]))
            left = held.filter((F.col(self.kind) != "removed") | (F.col("_batch") > number - self.keep)).withColumn("_bucket", self.bucket())
            base = f"base-{number}-{uuid.uuid4().hex[:8]}"
            made = self.written(left.select(*self.schema.names, "_batch", "_bucket"), base)
            for k in full:
                layers[k] = [(f"{base}/_in={k}", made[k])] if k in made else []
        now = {"batch": number, "touched": sorted(map(int, touched)), "merged": sorted(map(int, full)), "layers": {k: v for k, v in layers.items() if v}}
        folder = Folder(spark, self.path)
        if folder.put(f"manifest-{number}.json", json.dumps(now)):
            self.tidy(folder, number, now, before)

    def tidy(self, folder: Folder, number: int, *kept: dict) -> None:
        """Drops what neither of the last two manifests names."""
        named = {p for m in kept for v in m["layers"].values() for p, _ in v}
        whole = {p.split("/")[0] for p in named}
        for name in folder.names():
            if name.startswith("manifest-"):
                if int(name.removeprefix("manifest-").removesuffix(".json")) < number - 1:
                    folder.remove(name)
            elif name.startswith((f"delta-{number + 1}-", f"base-{number + 1}-")):
                continue  # the next batch may be under way
            elif name not in whole:
                folder.remove(name)
            else:
                for part in folder.names(name):
                    if part.startswith("_in=") and f"{name}/{part}" not in named:
                        folder.remove(f"{name}/{part}")

    def state(self, spark: SparkSession, batch: int | None = None, items: DataFrame | None = None) -> DataFrame:
        """The items that are there after a batch (the last, or the one before it); with ``items``, only those with these keys, from their buckets alone."""
        layers = self.manifest(spark, batch)["layers"]
        wanted = list(layers)
        if items is not None:
            some = {str(r[0]) for r in items.select(self.bucket()).distinct().collect()}  # at most as many as there are buckets
            wanted = [k for k in layers if k in some]
        rows = self.layers(spark, [p for k in wanted for p, _ in layers[k]])
        if items is not None:
            rows = rows.join(items.select(*self.keys).distinct(), list(self.keys), "left_semi")
        return self.newest(rows).filter(F.col(self.kind) != "removed").select(*self.schema.names)


def bucketed(changes: DataFrame, state: Buckets, checkpoint: str):
    """A stream writer that keeps ``state`` up to date with a stream of changes."""
    return changes.writeStream.foreachBatch(state.merge).option("checkpointLocation", checkpoint)
