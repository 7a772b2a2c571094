"""Bucketed state: batches against a replay, batches that run again, merged buckets, dropped files, lookups, streams."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioflow.plans.folders import Folder
from folioflow.streaming.buckets import Buckets, bucketed

SCHEMA = "name string, doc long, kind string, seq long, snapshot string"


def replay(rows):
    last = {}
    for name, doc, kind, seq, snapshot in rows:
        if (name, doc) not in last or seq >= last[name, doc][1]:
            last[name, doc] = (kind, seq, snapshot)
    return sorted((*k, *v) for k, v in last.items() if v[0] != "removed")


def test_batches_agree_with_a_replay(spark, tmp_path):
    rng, fed = random.Random(1), []
    state = Buckets(f"file://{tmp_path}/state", StructType.fromDDL(SCHEMA), ("name", "doc"), number=8, most=3)
    folder = Folder(spark, state.path)
    assert state.state(spark).count() == 0
    for batch in range(8):
        rows = [(f"n{rng.randrange(12)}", rng.randrange(2), rng.choice(["created", "modified", "removed"]), batch * 100 + i - rng.choice([0, 0, 150]), f"s{batch}-{i}") for i in range(1 if batch % 3 == 2 else 20)]
        fed += rows
        state.merge(spark.createDataFrame(rows, SCHEMA), batch)
        manifest = state.manifest(spark)
        assert manifest["batch"] == batch and len(manifest["touched"]) <= len({r[:2] for r in rows}) and set(manifest["merged"]) <= set(manifest["touched"])
        assert sorted(tuple(r) for r in state.state(spark).collect()) == replay(fed)
        held = folder.names()
        state.merge(spark.createDataFrame([("x", 1, "created", 10**6, "again")], SCHEMA), batch)  # a batch that runs again
        assert folder.names() == held and state.manifest(spark) == manifest
    assert sum(n.startswith("manifest-") for n in folder.names()) == 2
    named = {p for b in (6, 7) for v in state.manifest(spark, b)["layers"].values() for p, _ in v}
    assert {f"{d}/{p}" for d in folder.names() if not d.startswith("manifest") for p in folder.names(d) if p.startswith("_in=")} == named
    items = spark.createDataFrame([("n3", 0), ("n4", 1)], "name string, doc long")
    assert sorted(tuple(r) for r in state.state(spark, items=items).collect()) == [r for r in replay(fed) if r[:2] in {("n3", 0), ("n4", 1)}]


def test_removals_are_forgotten_and_failed_batches_leave_nothing(spark, tmp_path):
    state = Buckets(f"file://{tmp_path}/state", StructType.fromDDL(SCHEMA), ("name", "doc"), number=1, most=1, keep=2)
    feed = lambda *rows: spark.createDataFrame(list(rows), SCHEMA)
    state.merge(feed(("a", 1, "created", 1, "s"), ("b", 1, "created", 1, "s")), 0)
    state.merge(feed(("a", 1, "removed", 5, None)), 1)
    state.merge(feed(("a", 1, "modified", 4, "late"), (None, None, "created", 1, "nulls")), 2)
    assert [r.name for r in state.state(spark).orderBy("name").collect()] == [None, "b"]
    bad = feed(("c", 1, "created", 1, "s")).withColumn("kind", F.raise_error(F.lit("lost")).cast("string"))
    try:
        state.merge(bad, 3)
        raise AssertionError
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert state.manifest(spark)["batch"] == 2 and state.state(spark).count() == 2
    for n in range(3, 6):
        state.merge(feed((f"d{n}", 1, "created", n, "s")), n)
    rows = state.layers(spark, [p for v in state.manifest(spark)["layers"].values() for p, _ in v])
    assert rows.filter("kind = 'removed'").count() == 0 and state.state(spark).count() == 5
    state.merge(feed(), 6)
    assert state.state(spark).count() == 5 and state.manifest(spark)["touched"] == []


def test_stream_of_changes(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(f"n{k}", 1, "created" if k % 2 else "removed", i * 10 + k, f"{i}") for k in range(i, 5)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/feed")
    feed = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/feed")
    state = Buckets(f"file://{tmp_path}/state", StructType.fromDDL(SCHEMA), ("name", "doc"), number=4)
    query = bucketed(feed, state, f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    assert sorted((r.name, r.seq, r.snapshot) for r in state.state(spark).collect()) == [("n1", 11, "1"), ("n3", 23, "2")]
