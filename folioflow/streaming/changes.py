"""Change feeds and sessions on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """Events of a key with no longer pause than ``gap`` as one session; with ``late`` on a stream, state is dropped behind the watermark."""
    rows = events.withWatermark(time, late) if late else events
    told = rows.groupBy(*keys, F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))
    return told.select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def applied_stream(changes: DataFrame, origin: str) -> DataFrame:
    """A stream of what a replica does for changes (doc_id, name, kind, origin, seq, snapshot): its own are not echoed, older ones are dropped, removals of unknown names do nothing."""
    others = changes.filter((F.col("origin") != origin) & F.col("name").isNotNull() & F.col("doc_id").isNotNull())

    def step(key: tuple, pages: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, there = state.get if state.exists else (-1, False)
        out = []
        for row in pd.concat(list(pages)).sort_values("seq").itertuples():
            if row.seq <= seq:
                continue
            seq = int(row.seq)
            if row.kind == "removed":
                if there:
                    out.append((*key, "delete", seq, None))
                there = False
            else:
                out.append((*key, "update" if there else "insert", seq, row.snapshot))
                there = True
        state.update((seq, there))
        yield pd.DataFrame(out, columns=["doc_id", "name", "action", "seq", "snapshot"])

    return others.groupBy("doc_id", "name").applyInPandasWithState(step, "doc_id long, name string, action string, seq long, snapshot string", "seq long, there boolean", "append", GroupStateTimeout.NoTimeout)


def mirror(changes: DataFrame, path: str, keys: list[str], seq: str, checkpoint: str):
    """Start a query that keeps the state of a feed as a table: each micro-batch is merged with what is there, in a folder of its own.

    A batch that runs again writes the same folder again.
    """
    from folioflow.operators.annotations import applied

    spark = changes.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        before = f"{path}/state-{number - 1}"
        rows = batch
        if number:
            rows = spark.read.parquet(before).unionByName(batch)
        # removals stay as rows, so that late older changes can't bring an item back
        last = rows.withColumn("_nth", F.row_number().over(_last(keys, seq))).filter("_nth = 1").drop("_nth")
        last.write.mode("overwrite").parquet(f"{path}/state-{number}")

    def state(number: int) -> DataFrame:
        return applied(spark.read.parquet(f"{path}/state-{number}"), keys, seq)

    query = changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return query, state


def _last(keys: list[str], seq: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.desc(seq))
