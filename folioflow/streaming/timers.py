"""Streams with state of their own that ends: debounced events, searches that supersede one another, replicas of change feeds.

State is kept by key in value and map state, and event-time timers end it, so what a stream holds is
bounded by the keys that are active within the stated time, not by all keys ever seen. Needs the state
store of ``prepare``; rows behind the watermark are late and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def prepare(spark: SparkSession) -> None:
    """Selects the state store that timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def milliseconds(wait: str) -> int:
    return int(pd.Timedelta(wait).total_seconds() * 1000)


def _clock(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


class _Timers(StatefulProcessor):
    """Keeps one timer a key. Input columns have no leading underscores: rows reach Python as named tuples."""

    def set_timer(self, at: int) -> None:
        for other in list(self.handle.listTimers()):
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class _Debounce(_Timers):
    def __init__(self, keys: list[str], wait: int):
        self.keys, self.wait = keys, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, value string")

    def told(self, key: tuple, found: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        if found:
            rows = [(*key, value, pd.Timestamp(at + self.wait, unit="ms")) for value, at in found]
            yield pd.DataFrame(rows, columns=[*self.keys, "value", "fires"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        batch, found = pd.concat(list(rows)), []
        order = pd.DataFrame({"at": _clock(batch["own_at"]), "value": batch["own_value"]}).sort_values(["at", "value"])
        for at, value in order.itertuples(index=False):
            if held is not None and at - held[0] >= self.wait:
                found.append((held[1], held[0]))  # the pause had passed before this one came
            if held is None or (at, value) >= (held[0], held[1]):
                held = (int(at), value)
        self.last.update(held)
        self.set_timer(held[0] + self.wait)
        yield from self.told(key, found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        self.last.clear()
        yield from self.told(key, [(held[1], held[0])] if held else [])


def debounced_stream(events: DataFrame, keys: list[str], time: str, wait: str, value: str, late: str = "0 seconds") -> DataFrame:
    """keys, value and fires: the last event before each pause of ``wait`` or more, told when the watermark passes its end; then the key's state goes.

    Of events at one time the one with the greatest value (as text) counts. Times count to milliseconds;
    events without a time or key are left out. Over all events of a table, the result is that of
    ``editing.debounced``, save the last pause of each key that the watermark hasn't passed yet.
    """
    fine = F.col(time).isNotNull()
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    rows = events.filter(fine).withWatermark(time, late).select(*keys, F.col(time), F.col(time).cast("timestamp_ntz").alias("own_at"), F.col(value).cast("string").alias("own_value"))
    kinds = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(_Debounce(keys, milliseconds(wait)), f"{kinds}, value string, fires timestamp_ntz", "append", "eventtime")


class _Searches(_Timers):
    def __init__(self, keys: list[str], wait: int):
        self.keys, self.wait = keys, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "seq long, at long")
        self.asked = handle.getMapState("asked", "seq long", "query string")

    def ended(self, key: tuple, why: str) -> list[tuple]:
        """All open searches of a key, with how they ended."""
        out = [(*key, int(seq), query, why) for (seq,), (query,) in list(self.asked.iterator())]
        self.asked.clear()
        return out

    def told(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[*self.keys, "seq", "query", "state"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, last = self.newest.get() if self.newest.exists() else (-1, 0)
        batch, out = pd.concat(list(rows)), []
        order = pd.DataFrame({"at": _clock(batch["own_at"]), "kind": batch["own_kind"], "seq": batch["own_seq"], "query": batch["own_query"]}).sort_values(["at", "kind", "seq"])
        for at, kind, seq, query in order.itertuples(index=False):
            last = max(last, int(at))
            if kind == "asked" and seq > newest:
                out += self.ended(key, "superseded")
                newest = int(seq)
                self.asked.updateValue((newest,), (query,))
            elif kind == "asked":
                out.append((*key, int(seq), query, "superseded"))
            elif self.asked.containsKey((int(seq),)):
                out.append((*key, int(seq), self.asked.getValue((int(seq),))[0], "shown"))
                self.asked.removeKey((int(seq),))
        self.newest.update((newest, last))
        self.set_timer(last + self.wait)
        yield from self.told(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.ended(key, "given up")
        self.newest.clear()
        yield from self.told(out)


def searches_stream(requests: DataFrame, keys: list[str], time: str, seq: str, kind: str, query: str, wait: str, late: str = "0 seconds") -> DataFrame:
    """keys, seq, query and state of each search when it ends: shown, superseded by a later one, or given up.

    Rows are requests (``kind`` asked) and answers (found). An answer to a search that isn't open any
    more tells nothing. A key without rows for ``wait`` gives up what is open, and its state goes.
    """
    fine = F.col(time).isNotNull() & F.col(seq).isNotNull()
    for k in keys:
        fine = fine & F.col(k).isNotNull()
    rows = requests.filter(fine).withWatermark(time, late)
    rows = rows.select(*keys, F.col(time), F.col(time).cast("timestamp_ntz").alias("own_at"), F.col(seq).cast("long").alias("own_seq"), F.col(kind).alias("own_kind"), F.col(query).cast("string").alias("own_query"))
    kinds = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).transformWithStateInPandas(_Searches(keys, milliseconds(wait)), f"{kinds}, seq long, query string, state string", "append", "eventtime")


class _Replica(_Timers):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "seq long, there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, there = self.item.get() if self.item.exists() else (-1, False)
        batch, out, last = pd.concat(list(rows)), [], 0
        order = pd.DataFrame({"seq": batch["seq"], "kind": batch["kind"], "snapshot": batch["snapshot"], "at": _clock(batch["own_at"])}).sort_values("seq")
        for new, kind, snapshot, at in order.itertuples(index=False):
            last = max(last, int(at))
            if new <= seq:
                continue
            seq = int(new)
            if kind != "removed":
                out.append((*key, "update" if there else "insert", seq, snapshot))
            elif there:
                out.append((*key, "delete", seq, None))
            there = kind != "removed"
        self.item.update((seq, there))
        if there:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        else:
            self.set_timer(last + self.keep)
        if out:
            yield pd.DataFrame(out, columns=["doc_id", "name", "action", "seq", "snapshot"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.item.clear()
        yield from ()


def replica_stream(changes: DataFrame, origin: str, time: str, keep: str, late: str = "0 seconds") -> DataFrame:
    """As ``changes.applied_stream``, with state for the items that are there only: that of a removed item goes ``keep`` after its removal.

    Until then an older change that comes late can't bring it back; later than that it could, so ``keep`` is how
    long changes may be under way.
    """
    others = changes.filter((F.col("origin") != origin) & F.col("name").isNotNull() & F.col("doc_id").isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = others.select("doc_id", "name", F.col(time), "kind", F.col("seq").cast("long").alias("seq"), "snapshot", F.col(time).cast("timestamp_ntz").alias("own_at"))
    return rows.groupBy("doc_id", "name").transformWithStateInPandas(_Replica(milliseconds(keep)), "doc_id long, name string, action string, seq long, snapshot string", "append", "eventtime")
