"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each document's distinct runs of five words are hashed; documents with equal sets are one node.
2. Bands of MinHash values give buckets of nodes. Pairs are compared a few MinHash values at a time, and
   dropped as soon as the posterior probability that they reach the threshold (after a uniform prior) is
   below the tolerance. First every member meets its bucket's least node; what survives gives labels.
   Then, in buckets that still hold several labels, members meet those of other labels.
3. Labels are clusters. In a cluster of at most BLOCK nodes, pairs are pruned in the same way, and the
   rest are verified exactly on the sets, which gives each node's links.
4. A larger cluster first gets a set of reference: the runs that most of a few members have. With D the
   symmetric difference of a member and the reference and S the member's size, two members link for
   certain if their gaps (1 + t) D - (1 - t) S add up to at most zero, as the symmetric difference obeys
   the triangle inequality. Such links are counted from sums over gaps, without any pair; only members
   for whom that is not settled meet in pairs, which are pruned and verified as above.

So a group of n alike nodes costs about n rows in each step. Where members are not alike, blocks of at
most BLOCK nodes meet, and pairs are counted where they are compared and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioflow.llm.common import free_name, trimmed, written
from folioflow.llm.hashing import Words, mixed, run_hashes, text_hashes, text_slices

#: 24 bands of 4 values miss a pair of similarity 0.8 with probability 3e-6.
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
#: Values compared at a time.
STEP = 16
BLOCK = 256
#: Members of a large cluster whose common runs are its reference, and gaps to a unit (they are rounded up, which only asks for more comparisons).
VOTERS, GRID = 33, 16
#: The gap of members that nothing settles.
UNSETTLED = 1 << 40
#: Bytes of references that go to all executors at most; beyond, they are joined.
MOST_BYTES = 32 << 20
#: Rows that go to all executors at most (16 bytes each); more are joined.
MOST_SENT = 2_000_000
_SEEDS = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_TIMES, _PLUS = _SEEDS[:VALUES] | np.uint64(1), _SEEDS[VALUES:]


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of values compared (STEP, 2 STEP, ...), the fewest matches with which a pair is kept.

    With m of k values equal, the posterior probability of a similarity of at least t is the
    probability of at most m successes in k + 1 trials with chance t.
    """
    found = []
    for k in range(STEP, VALUES + 1, STEP):
        below, m = 0.0, -1
        while below < tolerance and m < k:
            m += 1
            below += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        found.append(m)
    return found


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text's runs of ``size`` words, in order, and where each text's begin. A shorter text has one run, itself."""
    counts = words.counts
    hashes = run_hashes(words.hashes, size)
    whole = np.flatnonzero(words.left()[: len(hashes)] >= size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    owner = np.concatenate([np.searchsorted(words.first, whole, side="right") - 1, short])
    values = np.concatenate([hashes[whole], text_hashes(words.hashes, words.first)[short]])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    fresh = np.append(True, (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])) if len(owner) else np.zeros(0, dtype=bool)
    owner, values = owner[fresh], values[fresh]
    return values, np.searchsorted(owner, np.arange(len(counts) + 1))


def set_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of each text's set, whatever the order; 0 for an empty set."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mixed(values ^ np.uint64(0xA24BAED4963EE407)), out=sums[1:])
    sizes = np.diff(first).astype(np.uint64)
    return np.where(sizes > 0, mixed(sums[first[1:]] - sums[first[:-1]] + sizes), np.uint64(0))


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The MinHash values of the non-empty sets, a row each."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), VALUES), dtype=np.uint32)
    if len(starts):
        for k in range(VALUES):
            out[:, k] = np.minimum.reduceat((values * _TIMES[k] + _PLUS[k]) >> np.uint64(32), starts)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    parts = values.astype(np.uint64).reshape(len(values), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


def survivors(a: np.ndarray, b: np.ndarray, asked: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows of two blocks of MinHash values that are asked for and not dropped."""
    matches = (a[:, None, :STEP] == b[None, :, :STEP]).sum(axis=2)
    left, right = np.nonzero(asked & (matches >= least[0]))
    matches = matches[left, right]
    for i, need in enumerate(least[1:], 1):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[left, part] == b[right, part]).sum(axis=1)
        keep = matches >= need
        left, right, matches = left[keep], right[keep], matches[keep]
    return left, right


def paired(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """The rows at which two equally long blocks of MinHash values are not dropped."""
    rows, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for i, need in enumerate(least):
        part = slice(i * STEP, (i + 1) * STEP)
        matches = matches + (a[rows, part] == b[rows, part]).sum(axis=1)
        keep = matches >= need
        rows, matches = rows[keep], matches[keep]
    return rows


def values_of(signatures: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(signatures.to_pylist()), "<u2").reshape(-1, VALUES)


def low_labels(n: int, left: np.ndarray, right: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the least key of those that pairs connect it with."""
    labels = keys.copy()
    while True:
        before = labels.copy()
        np.minimum.at(labels, left, labels[right])
        np.minimum.at(labels, right, labels[left])
        if (labels == before).all():
            return labels


def dealt(members: DataFrame, group: str, key: str) -> DataFrame:
    """Blocks of groups that meet: adds low and high (the blocks) and side (1: of the high one), a row for each block that a member's own meets.

    Members have ``kind`` 0 or 1, ``alike`` and ``unlike``: how many of either kind their group has.
    Blocks of kind 0 meet those of kind 1 only; blocks of kind 1 meet all.
    """
    zero, one = F.ceil(F.col("alike") / BLOCK).cast("int"), F.ceil(F.col("unlike") / BLOCK).cast("int")
    each = members.filter("unlike > 0").withColumn("zero", zero).withColumn("one", one)
    own = F.when(F.col("kind") == 0, F.pmod(F.xxhash64(key), F.greatest("zero", F.lit(1)))).otherwise(F.col("zero") + F.pmod(F.xxhash64(key), F.col("one")))
    first = F.when(F.col("kind") == 0, F.col("zero")).otherwise(F.lit(0))
    each = each.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(first, F.col("zero") + F.col("one") - 1)))
    each = each.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).withColumn("side", (F.col("own") > F.col("low")).cast("int"))
    return each.drop("zero", "one", "own", "other").repartition(group, "low", "high").sortWithinPartitions(group, "low", "high", "side", key)


def meeting(unit: pa.Table) -> tuple[slice, slice, np.ndarray]:
    """Of two blocks that meet: the rows of the left and of the right, and which pairs there are (a block with itself: each once)."""
    n = unit.num_rows
    if unit["low"][0].as_py() == unit["high"][0].as_py():  # not by the sides: a block may have no member
        return slice(0, n), slice(0, n), np.triu(np.ones((n, n), dtype=bool), 1)
    cut = int((unit["side"].to_numpy() == 0).sum())
    return slice(0, cut), slice(cut, n), np.ones((cut, n - cut), dtype=bool)


def units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that are equal in the first ``keys`` columns; they are bounded by the size of two blocks."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((parts[1:] != parts[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            if last is not None and tuple(parts[a]) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(parts[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each is connected with, from (node, label) pairs that are connected.

    A node that meets several labels keeps the least, which the others then meet instead: so a group
    has few edges beside one for each node. Labels spread along edges and are then followed once,
    until none changes; each round is a table in the shared folder.
    """
    met = edges.filter("node <> label").groupBy("node").agg(F.min("label").alias("best"), F.collect_set("label").alias("labels"))
    met = written(met, "met")
    beside = met.select(F.explode(F.filter("labels", lambda x: x != F.col("best"))).alias("node"), F.col("best").alias("label")).distinct()
    edges = written(met.select("node", F.col("best").alias("label")).unionByName(beside).distinct(), "edges")
    both = written(edges.union(edges.select("label", "node")).toDF("node", "near"), "edges-both")
    now = written(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("label")), "labels")
    while True:
        around = both.join(now.select(F.col("node").alias("near"), "label"), "near").groupBy("node").agg(F.min("label").alias("best"))
        spread = now.join(around, "node").select("node", F.least("label", "best").alias("label"), F.col("label").alias("old"))
        jumped = spread.join(now.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.least("label", "far").alias("label"), "old")
        after = written(jumped, "labels")
        if not after.filter("label <> old").limit(1).count():
            return after.select("node", "label")
        now = after.select("node", "label")


def labels_of_buckets(nodes: DataFrame, least: list[int]) -> DataFrame:
    """(node, label) of all nodes that share a bucket with another; pairs that share a bucket and are not dropped have one label."""
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("leader")).filter("size > 1")
    members = written(banded.join(full.select("bucket", "leader"), "bucket"), "buckets")
    signs = nodes.select("node", "signature")

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = pa.array(paired(values_of(batch.column(2)), values_of(batch.column(3)), least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some)], names=["node", "label"])

    stars = written(members.filter("node <> leader").select("node", "leader").distinct(), "stars")
    stars = stars.join(signs, "node").join(signs.toDF("leader", "other"), "leader").select("node", "leader", "signature", "other")
    first = connected(stars.mapInArrow(trimmed(led), "node long, label long"))
    labelled = written(members.select("bucket", "node").join(first, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label")), "labelled")

    by = labelled.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    several = by.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("alike"), F.sum("n").alias("n")).filter("n > alike")
    several = several.select("bucket", "main", "alike", (F.col("n") - F.col("alike")).alias("unlike"))
    unlike = labelled.join(several, "bucket").join(signs, "node").withColumn("kind", (F.col("label") != F.col("main")).cast("int"))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            a, b, asked = meeting(unit)
            signs, labels = values_of(unit["signature"]), unit["label"].to_numpy()
            left, right = survivors(signs[a], signs[b], asked & (labels[a, None] != labels[None, b]), least)
            names, at = np.unique(labels, return_inverse=True)
            low = low_labels(len(names), at[left], at[right + b.start], names)
            moved = low != names
            yield pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(low[moved])], names=["node", "label"])

    met = dealt(unlike, "bucket", "node").select("bucket", "low", "high", "side", "node", "label", "signature")
    second = connected(met.mapInArrow(trimmed(candidates), "node long, label long")).toDF("label", "least")
    return labelled.select("node", "label").distinct().join(second, "label", "left").select("node", F.coalesce("least", "label").alias("label"))


def gaps_of(sets: DataFrame, threshold: float) -> DataFrame:
    """(label, node, copies, gap) of the members of large clusters: gaps that add up to at most zero tell a link."""

    def vote(cluster: pa.Table) -> pa.Table:
        runs, n = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in cluster["shingles"].to_pylist()]), return_counts=True)
        return pa.table({"label": cluster["label"][:1], "reference": pa.array([runs[2 * n > cluster.num_rows].tobytes()], pa.binary())})

    order = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("node"), "node"))
    voters = sets.select("label", "node").withColumn("place", order).filter(F.col("place") <= VOTERS).select("label", "node")
    votes = sets.select("label", "node", "shingles").join(voters, ["label", "node"])
    references = written(votes.groupBy("label").applyInArrow(vote, "label long, reference binary"), "references")
    size = references.agg(F.coalesce(F.sum(F.octet_length("reference") + 64), F.lit(0))).first()[0]
    beside = sets.select("label", "node", "copies", "shingles").join(F.broadcast(references) if size <= MOST_BYTES else references, "label")

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gaps = []
            for own, common in zip(batch.column(3), batch.column(4), strict=True):
                a, b = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(common.as_py(), np.uint64)
                both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(b) else 0
                gaps.append(math.ceil(GRID * ((1 + threshold) * (len(a) + len(b) - 2 * both) - (1 - threshold) * len(a)) - 1e-6))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(gaps, pa.int64())], names=["label", "node", "copies", "gap"])

    columns = beside.select("label", "node", "copies", "shingles", "reference")
    return written(columns.mapInArrow(trimmed(measured), "label long, node long, copies long, gap long"), "gaps")


def settled(gaps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What gaps tell: (node, label, links) for certain, and (label, node, gap, kind, alike, unlike) of members that still have to meet others."""
    about = gaps.groupBy("label").agg(F.max("gap").alias("widest"), F.min(F.struct("gap", "node")).alias("best"))
    by = gaps.groupBy("label", "gap").agg(F.sum("copies").alias("copies"))
    # how many have a gap of at most minus one's own: a running sum over the gaps that occur, asked between them
    points = by.select("label", F.col("gap").alias("at"), F.lit(0).alias("asks"), "copies", F.lit(None).cast("long").alias("gap"))
    points = points.unionByName(by.select("label", (-F.col("gap")).alias("at"), F.lit(1).alias("asks"), F.lit(0).cast("long").alias("copies"), "gap"))
    running = F.sum("copies").over(Window.partitionBy("label").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0))
    told = points.withColumn("upto", running).filter("asks = 1").select("label", "gap", "upto")
    each = written(gaps.join(about, "label").join(told, ["label", "gap"]), "settled")
    own = F.when(F.col("gap") <= 0, F.col("copies")).otherwise(F.lit(0))
    certain = each.select("node", F.when(F.col("gap") + F.col("best.gap") <= 0, F.col("best.node")).otherwise(F.col("node")).alias("label"), (F.col("upto") - own).alias("links"))
    left = each.filter("gap + widest > 0").select("label", "node", "gap", (F.col("gap") > 0).cast("int").alias("kind"))
    counts = left.groupBy("label").agg(F.count_if(F.col("kind") == 0).alias("alike"), F.count_if(F.col("kind") == 1).alias("unlike"))
    return certain.filter("links > 0"), left.join(counts, "label")


def classes(docs: DataFrame, threshold: float, size: int, tolerance: float, text: str, doc_id: str) -> DataFrame:
    """doc_id, text_key (of the text's bytes), class_node, class_id, n_links and n_shingles of every row; see ``similar_documents``."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    least = least_matches(threshold, tolerance)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(2)):
                values, first = shingle_sets(Words(data, offsets), size)
                sizes = np.diff(first)
                full = sizes > 0
                signs = signatures(values, first)
                places = np.append(0, np.cumsum(full))
                bands = pa.ListArray.from_arrays(pa.array((places * BANDS).astype(np.int32)), pa.array(band_keys(signs).view(np.int64).ravel()))
                cut = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * VALUES), len(signs), [None, pa.py_buffer(np.ascontiguousarray(signs.astype("<u2")))]).cast(pa.binary())
                signed = cut.take(pa.array(np.where(full, places[:-1], 0), mask=~full)) if len(signs) else pa.nulls(b - a, pa.binary())
                told = [*(batch.column(i).slice(a, b - a) for i in range(2)), pa.array(set_keys(values, first).view(np.int64)), pa.array(sizes.astype(np.int64)), bands, signed]
                yield pa.RecordBatch.from_arrays(told, names=["doc_id", "text_key", "node", "n_shingles", "bands", "signature"])

    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    told = written(keyed.mapInArrow(trimmed(describe), "doc_id long, text_key long, node long, n_shingles long, bands array<long>, signature binary"), "shingles")
    part = told.filter("n_shingles > 0 and doc_id is not null")
    nodes = written(part.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "nodes")
    clusters = written(labels_of_buckets(nodes, least), "labels")
    sizes = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    chosen = written(clusters.join(sizes, "label").join(nodes.select("node", "first", "copies", "signature"), "node"), "clusters")
    sent = chosen.select(F.col("first").alias("chosen_id"), F.col("node").alias("chosen_node"))
    texts = rows.join(F.broadcast(sent) if chosen.count() <= MOST_SENT else sent, F.col("doc_id") == F.col("chosen_id")).select("chosen_node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                values, first = shingle_sets(Words(data, offsets), size)
                keys = set_keys(values, first).view(np.int64)
                own = batch.column(0).slice(a, b - a).to_numpy()
                kept = np.flatnonzero(keys == own)  # equal doc ids may have other texts
                yield pa.RecordBatch.from_arrays([pa.array(own[kept]), pa.array([values[first[i] : first[i + 1]].tobytes() for i in kept], pa.binary())], names=["node", "shingles"])

    found = texts.mapInArrow(trimmed(sets), "node long, shingles binary").dropDuplicates(["node"])
    joined = written(found.join(chosen, "node"), "cluster-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in units(batches, 3):
            a, b, asked = meeting(unit)
            nodes, copies, gaps, signs = unit["node"].to_numpy(), unit["copies"].to_numpy(), unit["gap"].to_numpy(), values_of(unit["signature"])
            left, right = survivors(signs[a], signs[b], asked & (gaps[a, None] + gaps[None, b] > 0), least)
            right = right + b.start
            held = [np.frombuffer(x, np.uint64) for x in unit["shingles"].to_pylist()]
            lengths = np.array([len(x) for x in held])
            _, flat = np.unique(np.concatenate(held), return_inverse=True)
            bounds = np.append(0, np.cumsum(lengths))
            marks = np.zeros(int(flat.max(initial=-1)) + 1, dtype=np.int64)
            linked = np.zeros(len(left), dtype=bool)
            edges = np.append(np.flatnonzero(np.append(True, left[1:] != left[:-1])), len(left)) if len(left) else np.zeros(1, int)
            for s, e in zip(edges, edges[1:], strict=False):
                me, others = left[s], right[s:e]
                marks[flat[bounds[me] : bounds[me + 1]]] = 1
                common = np.array([marks[flat[bounds[o] : bounds[o + 1]]].sum() for o in others])
                marks[flat[bounds[me] : bounds[me + 1]]] = 0
                linked[s:e] = common >= threshold * (lengths[me] + lengths[others] - common) - 1e-9
            left, right = left[linked], right[linked]
            links = np.zeros(len(nodes), dtype=np.int64)
            np.add.at(links, left, copies[right])
            np.add.at(links, right, copies[left])
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(low_labels(len(nodes), left, right, nodes)[some]), pa.array(links[some])], names=["node", "label", "links"])

    few = joined.filter(F.col("size") <= BLOCK).select("label", "node", F.lit(UNSETTLED).cast("long").alias("gap"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("alike"), F.col("size").alias("unlike"))
    certain, left = settled(gaps_of(joined.filter(F.col("size") > BLOCK), threshold))
    open_members = few.unionByName(left).join(joined.select("node", "copies", "signature", "shingles"), "node")
    met = dealt(open_members, "label", "node").select("label", "low", "high", "side", "node", "copies", "gap", "signature", "shingles")
    verified = written(met.mapInArrow(trimmed(verify), "node long, label long, links long").unionByName(certain), "verified")
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    joins = connected(verified.select("node", "label"))
    firsts = joins.join(nodes.select("node", "first"), "node").groupBy("label").agg(F.min("first").alias("class_first"))
    known = joins.join(firsts, "label").join(links, "node").select("node", "label", "class_first", "links")
    each = written(nodes.select("node", "first", "copies").join(known, "node", "left"), "node-classes")
    linked = each.select("node", F.coalesce("label", "node").alias("class_node"), F.coalesce("class_first", "first").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    every = told.select("doc_id", "text_key", "node", "n_shingles").join(linked, "node", "left")
    alone = F.col("n_shingles") == 0
    return every.select(
        "doc_id",
        "text_key",
        "class_node",
        F.when(F.col("doc_id").isNotNull(), F.when(alone, F.col("doc_id")).otherwise(F.col("class"))).alias("class_id"),
        F.when(alone | F.col("doc_id").isNull(), F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        "n_shingles",
    )


def similar_documents(docs: DataFrame, threshold: float = 0.8, size: int = 5, tolerance: float = 1e-6, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, class_id, n_links and n_shingles of every row.

    Two documents link if the Jaccard similarity of their sets of runs of ``size`` words is at least
    ``threshold``; ``n_links`` counts the other rows that one links with, ``class_id`` is the least
    doc_id of all that links connect it with. A text with fewer words than ``size`` has itself as its
    only run; null and blank texts link with nothing. Rows without a doc_id take no part and have a
    null class; a doc_id that is no whole number raises; repeated rows link with each other; an empty
    table gives an empty result; other columns don't matter.
    """
    return classes(docs, threshold, size, tolerance, text, doc_id).select("doc_id", "class_id", "n_links", "n_shingles")


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each class with its columns unchanged: that with the least doc_id (of several, one text by a fixed order).

    Rows without a doc_id, and null and blank texts, which link with nothing, stay. Unlike texts stay
    also where they share a doc_id. Of rows that are equal in doc_id and text, one stays. Other cases
    are as in ``similar_documents``. What goes is sent to all executors where it is small enough, so
    that texts need not move.
    """
    rows = classes(docs, threshold, 5, 1e-6, text, doc_id).filter("doc_id is not null and n_shingles > 0").select("class_node", "class_id", "doc_id", "text_key")
    found = written(rows, "similar")
    name_id, name_text = free_name(docs, "similar_id"), free_name(docs, "similar_text")
    names = [F.col("doc_id").alias(name_id), F.col("text_key").alias(name_text)]
    # rows of the least doc_id with several texts in one class are few, and no class meets in one task
    first = found.filter("doc_id = class_id")
    several = first.groupBy("class_node", "doc_id").agg(F.min("text_key").alias("best"), F.max("text_key").alias("worst")).filter("best <> worst")
    other = first.join(several.select("class_node", "doc_id", "best"), ["class_node", "doc_id"]).filter("text_key <> best")
    gone = written(found.filter("doc_id <> class_id").select(*names).unionByName(other.select(*names)).distinct(), "similar-gone")
    again = written(found.groupBy("doc_id", "text_key").count().filter("count > 1").select(*names), "similar-again")
    same = (F.col(f"`{doc_id}`").cast("long") == F.col(name_id)) & (F.xxhash64(F.col(f"`{text}`").cast("string").cast("binary")) == F.col(name_text))
    left = docs.join(F.broadcast(gone) if gone.count() <= MOST_SENT else gone, same, "left_anti")
    if not again.limit(1).count():
        return left
    key = free_name(docs, "similar_key")
    twice = left.join(again, same, "left_semi").withColumn(key, F.xxhash64(F.col(f"`{text}`").cast("string").cast("binary")))
    return left.join(again, same, "left_anti").unionByName(twice.dropDuplicates([doc_id, key]).drop(key))
