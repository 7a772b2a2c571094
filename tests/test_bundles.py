"""The data source of bundles: round trips, splits by bytes, bounds, replacing, streams, aborted jobs."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources.bundles import Bundles


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(Bundles)
    return spark


def files_below(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def test_round_trip_and_filters(source, tmp_path):
    path = f"{tmp_path}/b"
    rows = source.range(5000).selectExpr("id AS doc", "concat('name', id % 7) AS name", "CASE WHEN id % 3 = 0 THEN NULL ELSE id / 2 END AS half", "CAST(repeat('x', CAST(id % 50 AS INT)) AS BINARY) AS content", "array(id) AS more")
    rows.repartition(4).write.format("bundles").option("path", path).mode("append").save()
    back = source.read.format("bundles").option("path", path).load()
    assert back.schema.simpleString() == rows.schema.simpleString()
    assert back.exceptAll(rows).count() == 0 and back.count() == 5000
    small = source.read.format("bundles").option("path", path).option("split", 2_000).load()
    assert small.rdd.getNumPartitions() > 4 and small.select(F.sum("doc")).first()[0] == sum(range(5000))
    for bounds, where in (({"min.doc": 4990}, "doc >= 4990"), ({"min.doc": 17, "max.doc": 17}, "doc = 17"), ({"min.name": "name3", "max.half": 1000.0}, "name >= 'name3' AND half <= 1000"), ({"max.doc": -1}, "doc < 0")):
        some = source.read.format("bundles").option("path", path).options(**bounds).load()
        assert some.exceptAll(rows.filter(where)).count() == 0 and some.count() == rows.filter(where).count()
    with pytest.raises(Exception, match="has no bounds"):
        source.read.format("bundles").option("path", path).option("min.more", "1").load().count()


def test_files_that_can_not_match_are_left_out(source, tmp_path):
    path = f"{tmp_path}/b"
    for i in range(3):
        source.range(i * 100, i * 100 + 100).coalesce(1).write.format("bundles").option("path", path).mode("append").save()
    assert len(Bundles({"path": path}).reader(source.range(0).schema).partitions()) == 3
    assert len(Bundles({"path": path, "min.id": "150", "max.id": "150"}).reader(source.range(0).schema).partitions()) == 1
    assert source.read.format("bundles").option("path", path).option("min.id", 150).option("max.id", 151).load().count() == 2
    source.range(5).write.format("bundles").option("path", path).mode("overwrite").save()
    assert source.read.format("bundles").option("path", path).load().count() == 5


def test_streams_go_from_commit_to_commit(source, tmp_path):
    path = f"{tmp_path}/b"
    write = lambda a, b: source.range(a, b).write.format("bundles").option("path", path).mode("append").save()
    seen = []

    def run():
        stream = source.readStream.format("bundles").option("path", path).schema("id long").load()
        query = stream.writeStream.foreachBatch(lambda df, n: seen.append((n, sorted(r.id for r in df.collect())))).option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
        query.awaitTermination(120)
        assert query.exception() is None

    write(0, 3)
    run()
    write(3, 5)
    write(5, 6)
    run()
    assert seen == [(0, [0, 1, 2]), (1, [3, 4, 5])]


def test_a_lost_job_leaves_no_file(source, tmp_path):
    path = f"{tmp_path}/b"
    source.range(10).write.format("bundles").option("path", path).mode("append").save()
    before = files_below(path)
    bad = source.range(0, 4000, 1, 4).select(F.when(F.col("id") == 3500, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format("bundles").option("path", path).mode("append").save()
    assert files_below(path) == before
    assert source.read.format("bundles").option("path", path).load().count() == 10
    empty = source.read.format("bundles").option("path", f"{tmp_path}/none").schema("id long").load()
    assert empty.count() == 0
