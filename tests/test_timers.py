"""State with timers on streams of files: debounce, superseded searches and replicas, held against the batch operators; state goes."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import editing
from folioflow.streaming import timers

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def stores(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    timers.prepare(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def streamed(spark, batches, schema, folder, build):
    """The rows that a stream of files tells, a micro-batch for each file, and the rows of state that it holds in the end."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{i:03d}")
    rows = []
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in/*")
    query = build(source).writeStream.foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return rows, held[-1]


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def test_debounce_fires_and_its_state_goes(spark, stores, tmp_path):
    rng = random.Random(1)
    schema = "user_id long, ts timestamp, event_id long"
    times = sorted(rng.randrange(600) for _ in range(120))
    rows = [(rng.randrange(5), at(t), i) for i, t in enumerate(times)]
    batches = [rows[i : i + 40] for i in range(0, 120, 40)] + [[(99, at(2000), 1000)], [(99, at(4000), 1001)], [(99, at(4001), 1002)]]
    found, held = streamed(spark, batches, schema, tmp_path, lambda s: timers.debounced_stream(s, ["user_id"], "ts", "30 minutes", "event_id"))
    flat = [r for b in batches for r in b]
    want = editing.debounced(spark.createDataFrame(flat, schema), ["user_id"], "ts", "30 minutes", "event_id").filter("user_id < 99")
    assert sorted((r.user_id, int(r.value), r.fires) for r in found if r.user_id < 99) == sorted((r.user_id, r.event_id, r.fires) for r in want.collect())
    assert held <= 3  # the last key's state and timers; all others' have gone


def test_searches_are_shown_superseded_or_given_up(spark, stores, tmp_path):
    schema = "session long, ts timestamp, seq long, kind string, query string"
    batches = [
        [(1, at(0), 1, "asked", "a"), (1, at(1), 2, "asked", "ab"), (2, at(0), 1, "asked", "x"), (None, at(0), 1, "asked", "n")],
        [(1, at(2), 1, "found", None), (1, at(3), 2, "found", None), (2, at(5), 3, "asked", "xyz"), (2, at(6), 2, "asked", "late")],
        [(9, at(500), 1, "asked", "q")],
        [(9, at(900), 1, "found", None)],
    ]
    found, held = streamed(spark, batches, schema, tmp_path, lambda s: timers.searches_stream(s, ["session"], "ts", "seq", "kind", "query", "60 minutes"))
    told = sorted((r.session, r.seq, r.query, r.state) for r in found if r.session < 9)
    assert told == [(1, 1, "a", "superseded"), (1, 2, "ab", "shown"), (2, 1, "x", "superseded"), (2, 2, "late", "superseded"), (2, 3, "xyz", "given up")]
    assert held <= 3


def test_replica_forgets_removed_items(spark, stores, tmp_path):
    schema = "doc_id long, name string, kind string, origin string, seq long, snapshot string, ts timestamp"
    batches = [
        [(1, "a", "created", "x", 1, "s1", at(0)), (1, "b", "created", "us", 2, "s", at(0)), (1, "c", "removed", "x", 3, None, at(0)), (None, "a", "created", "x", 1, "", at(0))],
        [(1, "a", "removed", "x", 5, None, at(10)), (1, "d", "created", "x", 6, "d1", at(10))],
        [(1, "a", "modified", "x", 4, "old", at(11)), (1, "d", "modified", "x", 7, "d2", at(12))],
        [(2, "z", "created", "x", 1, "z", at(1000))],
        [(2, "z", "modified", "x", 2, "z2", at(1100))],
    ]
    found, held = streamed(spark, batches, schema, tmp_path, lambda s: timers.replica_stream(s, "us", "ts", "60 minutes"))
    assert sorted((r.doc_id, r.name, r.action, r.seq, r.snapshot) for r in found) == sorted(
        [(1, "a", "insert", 1, "s1"), (1, "a", "delete", 5, None), (1, "d", "insert", 6, "d1"), (1, "d", "update", 7, "d2"), (2, "z", "insert", 1, "z"), (2, "z", "update", 2, "z2")]
    )
    assert held == 2  # d and z; what was removed has gone


def test_empty_stream(spark, stores, tmp_path):
    schema = "user_id long, ts timestamp, event_id long"
    found, _ = streamed(spark, [[(None, at(0), 1), (1, None, 1)]], schema, tmp_path, lambda s: timers.debounced_stream(s.filter(F.lit(True)), ["user_id"], "ts", "1 minute", "event_id"))
    assert found == []
