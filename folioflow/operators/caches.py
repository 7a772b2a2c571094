"""Caches and queues as queries: what a cache holds, recent items, priorities, render stamps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lru_snapshot(accesses: DataFrame, scope: list[str], key: str, size: str, budget: int, *recent: Column) -> DataFrame:
    """What is kept of each scope when the least recently used go until all fit: each key's last access, newest first, while the sum fits."""
    last = accesses.withColumn("_nth", F.row_number().over(Window.partitionBy(*scope, key).orderBy(*recent))).filter(F.col("_nth") == 1)
    total = F.sum(size).over(Window.partitionBy(*scope).orderBy(*recent).rowsBetween(Window.unboundedPreceding, 0))
    return last.withColumn("held_bytes", total).filter(F.col("held_bytes") <= budget).drop("_nth")


def lru_replay(trace: DataFrame, scope: str, budget: int) -> DataFrame:
    """The exact state after a trace (seq, op, key, bytes) of reads, writes and purges: a write beyond the budget is ignored, the key just written stays."""
    kind = trace.schema[scope].dataType.simpleString()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, int] = {}
        total = 0
        for op, name, size in rows.sort_values("seq")[["op", "key", "bytes"]].itertuples(index=False):
            if op == "purge":
                held.clear()
                total = 0
            elif op == "read" and name in held:
                held[name] = held.pop(name)
            elif op == "write" and size <= budget:
                total += int(size) - held.pop(name, 0)
                held[name] = int(size)
                while total > budget and len(held) > 1:
                    total -= held.pop(next(iter(held)))  # the one just written is the last
        return pd.DataFrame([[*key, i, k, v] for i, (k, v) in enumerate(held.items())], columns=[scope, "age_rank", "key", "bytes"])

    return trace.groupBy(scope).applyInPandas(run, f"{scope} {kind}, age_rank int, key string, bytes long")


def recents(df: DataFrame, scope: list[str], key: str, most: int, *newest: Column) -> DataFrame:
    """Each key once, newest first, at most so many."""
    once = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*scope, key).orderBy(*newest))).filter("_nth = 1").drop("_nth")
    return once.withColumn("recent_rank", F.row_number().over(Window.partitionBy(*scope).orderBy(*newest))).filter(F.col("recent_rank") <= most)


def nearest_to_focus(requests: DataFrame, scope: list[str], page: str, focus: Column, seq: str) -> DataFrame:
    """Of each scope's waiting requests the one nearest to the focus, the earliest of equals."""
    return requests.groupBy(*scope).agg(F.min_by(F.struct(*requests.columns), F.struct(F.abs(F.col(page) - focus), F.col(seq))).alias("r")).select("r.*")


def coalesced(requests: DataFrame, token: str, seq: str, priority: str) -> DataFrame:
    """Requests of one token run once, at the place of the first and with the last priority."""
    return requests.groupBy(token).agg(F.min(seq).alias(seq), F.max_by(priority, seq).alias(priority), F.count(F.lit(1)).alias("asked"))


def page_stamps(edits: DataFrame, scope: str, page: str) -> DataFrame:
    """How often each page was changed: its own edits and those of all pages (null)."""
    every = edits.groupBy(scope).agg(F.count_if(F.col(page).isNull()).alias("epoch"))
    own = edits.filter(F.col(page).isNotNull()).groupBy(scope, page).agg(F.count(F.lit(1)).alias("edits"))
    return own.join(every, scope).select(scope, page, (F.col("edits") + F.col("epoch")).alias("stamp"))


def common_totals(results: DataFrame, tools: list[str]) -> DataFrame:
    """Per tool, pages and milliseconds over the pages that every tool has rendered of a file; files where a tool failed or is missing don't count."""
    fine = results.filter("error is null").groupBy("file").agg(F.countDistinct("tool").alias("tools"), F.min("pages_rendered").alias("common"))
    failed = results.filter("error is not null").select("file").distinct()
    files = fine.filter((F.col("tools") == len(tools)) & (F.col("common") > 0)).join(failed, "file", "left_anti")
    per_page = F.col("render_ms") / F.col("pages_rendered")
    return results.join(files, "file").groupBy("tool").agg(F.sum("common").alias("pages"), F.sum(per_page * F.col("common")).alias("ms"))
