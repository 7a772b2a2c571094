"""Sharding by extendible hashing.

A document's key has 60 hash bits. The directory starts with one bucket; a bucket that holds more
bytes than a shard may and more than one key splits on the next bit, and no other does. A bucket is
known by its depth and prefix.

Bytes are first added up by cells (prefixes a little longer than the shards' will be), so the
directory comes from the cells in one pass: a leaf is the shortest prefix that fits. Only cells that
are still too large go on to further bits. Rows that can't be split by bits, copies of one key, are
chained in pages.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import written

BITS = 60
#: Cells are so many times smaller than a shard, as a power of two.
FINER = 5
MOST_CELL_BITS = 24


def key_bits(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the key's decimal or other text; a document without an id has the MD5 of its text as its key."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(text.cast("binary"))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def leaves(cells: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(cell, depth, fits) from cells of ``base`` + ``bits`` bits with bytes, least and most key: the first prefix beyond ``base`` that fits."""
    length = base + bits
    each = cells.select("cell", "bytes", "low", "high", F.explode(F.sequence(F.lit(base), F.lit(length))).alias("depth"))
    each = each.withColumn("prefix", F.expr(f"shiftright(cell, {length} - depth)"))
    sums = each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
    sums = written(sums.withColumn("fits", (F.col("bytes") <= limit) | (F.col("low") == F.col("high"))), "shard-sums")
    split = sums.filter(~F.col("fits") & (F.col("depth") < length)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
    root = sums.filter(F.col("depth") == base).select("depth", "prefix")
    reached = sums.join(split.unionByName(root), ["depth", "prefix"]).filter(F.col("fits") | (F.col("depth") == length))
    span = F.expr(f"shiftleft(prefix, {length} - depth)")
    return reached.select(F.explode(F.sequence(span, span + F.expr(f"shiftleft(1L, {length} - depth)") - 1)).alias("cell"), "depth", "fits")


def extendible_shards(docs: DataFrame, limit: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The shard of every row: doc_id, n_bytes, depth, prefix, page, shard (bits of the prefix, and the page where there are more), shard_bytes.

    No shard is larger than ``limit`` unless one document is. Null texts have no bytes; rows without
    a doc_id are dealt by their text; copies of one key that are too many for a shard are chained in
    pages of at most ``limit`` bytes, in order of their texts' hash; an empty table gives an empty
    result; other columns don't matter.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), key_bits(F.col(f"`{doc_id}`"), body).alias("bits"), F.xxhash64(body).alias("rank"))
    rows = written(rows, "shard-rows")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, more = 0, min(MOST_CELL_BITS, max(1, math.ceil(math.log2(max(1, total / limit)))) + FINER)
    found, left = [], rows
    while True:
        length = base + more
        celled = left.withColumn("cell", F.expr(f"shiftright(bits, {BITS - length})"))
        cells = celled.groupBy("cell").agg(F.sum("n_bytes").alias("bytes"), F.min("bits").alias("low"), F.max("bits").alias("high"))
        placed = celled.join(leaves(cells, base, more, limit), "cell")
        placed = written(placed.withColumn("prefix", F.expr(f"shiftright(cell, {length} - depth)")).drop("cell"), "shard-placed")
        found.append(placed.filter("fits"))
        left = placed.filter("not fits").select("doc_id", "n_bytes", "bits", "rank")
        if length >= BITS or not left.take(1):
            break
        base, more = length, min(8, BITS - length)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    sizes = every.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("bucket_bytes"), F.count(F.lit(1)).alias("bucket_rows"))
    known = every.join(sizes, ["depth", "prefix"])
    whole = known.filter(f"bucket_bytes <= {limit} or bucket_rows = 1").withColumn("page", F.lit(0).cast("long")).withColumn("shard_bytes", F.col("bucket_bytes"))
    chained = known.filter(f"bucket_bytes > {limit} and bucket_rows > 1")
    # copies of one key: as many a page as surely fit, by the largest of them
    w = Window.partitionBy("depth", "prefix")
    page = F.floor((F.row_number().over(w.orderBy("rank")) - 1) / F.greatest(F.floor(F.lit(limit) / F.max("n_bytes").over(w)), F.lit(1)))
    chained = chained.withColumn("page", page)
    chained = chained.withColumn("shard_bytes", F.sum("n_bytes").over(Window.partitionBy("depth", "prefix", "page")))
    bits = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    name = F.when(F.col("page") > 0, F.concat(bits, F.lit("+"), F.col("page").cast("string"))).otherwise(bits)
    return whole.unionByName(chained).select("doc_id", "n_bytes", "depth", "prefix", "page", name.alias("shard"), "shard_bytes")
