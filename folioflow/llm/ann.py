"""Nearest neighbours by inner product, with a vantage-point tree for each shard of the vectors.

With a further component that brings every vector to the same length, the largest inner product is the
least Euclidean distance, so the triangle inequality holds. A branch, or a whole shard, is left out when
its least possible distance exceeds ``factor`` times the distance of the worst neighbour held; at factor
one no neighbour can be missed.

The upper levels of the tree are fitted on a bounded sample and deal all vectors to shards, so that
a shard holds vectors that are near one another; each shard's own tree is a file in the shared folder.
A query first searches the shard that it falls into, and then goes, with the distance that it has
reached, to those shards alone whose bounds don't exclude them.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import file_system, new_folder, trimmed, written
from folioflow.llm.ngram_join import units

LEAF = 64
#: Bytes of a shard's vectors; where more fall together, as copies do, the shard has several trees with the same bounds.
SHARD_BYTES = 8 << 20
#: The upper levels are fitted on at most so many vectors of one length, and so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: Queries that meet a tree in one task, about, and in one step.
BLOCK_QUERIES, STEP_QUERIES = 4096, 1024
#: Visits that are put together at a time.
STEP_VISITS = 16_384


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Euclidean distances of all rows of ``a`` to all rows of ``b``."""
    squares = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * np.einsum("ij,kj->ik", a, b)
    return np.sqrt(np.maximum(squares, 0.0))


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """The vectors with the component that brings their squared length to ``most``."""
    return np.hstack([vectors, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", vectors, vectors), 0.0))[:, None]])


class TopTree:
    """The levels above the shards: a vantage point and a median distance for each inner node of a full binary tree."""

    def __init__(self, sample: np.ndarray, depth: int, width: int):
        self.depth = depth
        self.points, self.cuts = np.zeros((1 << depth, width)), np.full(1 << depth, np.inf)
        held = {1: np.arange(len(sample))}
        for node in range(1, 1 << depth):
            rows = held.pop(node)
            if not len(rows):
                held[2 * node] = held[2 * node + 1] = rows
                continue
            gaps = sample[rows] - sample[rows].mean(axis=0)
            self.points[node] = sample[rows[np.argmax(np.einsum("ij,ij->i", gaps, gaps))]]
            d = np.sqrt(((sample[rows] - self.points[node]) ** 2).sum(axis=1))
            self.cuts[node] = np.median(d)
            held[2 * node], held[2 * node + 1] = rows[d <= self.cuts[node]], rows[d > self.cuts[node]]

    def route(self, rows: np.ndarray) -> np.ndarray:
        """The shard that each row falls into."""
        node = np.ones(len(rows), dtype=np.int64)
        for _ in range(self.depth):
            d = np.sqrt(((rows - self.points[node]) ** 2).sum(axis=1))
            node = 2 * node + (d > self.cuts[node])
        return node - (1 << self.depth)

    def path(self, shard: int) -> np.ndarray:
        """The vantage points above a shard."""
        return self.points[[(shard + (1 << self.depth)) >> (self.depth - level) for level in range(self.depth)]]

    def bounds(self, rows: np.ndarray, shards: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least possible distance of each row to the vectors of each shard, given the shards' ranges of distance by level."""
        out = np.zeros((len(rows), len(shards)))
        if self.depth:
            to_points = distances(rows, self.points)
            for level in range(self.depth):
                d = to_points[:, (shards + (1 << self.depth)) >> (self.depth - level)]
                np.maximum(out, np.maximum(low[:, level] - d, d - high[:, level]), out=out)
        return out


class VantageTree:
    """Rows of a matrix in the order of the leaves, and the nodes: vantage point, ranges of distance, children or leaf."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: float, points: np.ndarray, spans: np.ndarray, nodes: np.ndarray):
        self.rows, self.ids, self.vectors, self.most, self.points, self.spans, self.nodes = rows, ids, vectors, float(most), points, spans, nodes
        self.lifted = lifted(vectors, self.most)
        self.seen = 0

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: float | None = None) -> VantageTree:
        if most is None:
            most = float(np.einsum("ij,ij->i", vectors, vectors).max(initial=0.0))
        order = np.lexsort((rows, ids))
        flat = cls(rows[order], ids[order], vectors[order], most, np.zeros(0, int), np.zeros((0, 4)), np.zeros((0, 4), int))
        whole, arranged, points, spans, nodes = flat.lifted, [], [], [], []
        count = 0

        def grow(some: np.ndarray) -> int:
            nonlocal count
            me = len(nodes)
            nodes.append([count, count + len(some), -1, -1])
            points.append(0)
            spans.append((0.0, 0.0, 0.0, 0.0))
            if len(some) > LEAF:
                gaps = whole[some] - whole[some].mean(axis=0)
                far = some[np.argmax(np.einsum("ij,ij->i", gaps, gaps))]
                d = np.sqrt(((whole[some] - whole[far]) ** 2).sum(axis=1))
                middle = np.median(d)
                near = d <= middle if (d > middle).any() else d < middle
                if near.any() and not near.all():
                    points[me] = far
                    spans[me] = (d[near].min(), d[near].max(), d[~near].min(), d[~near].max())
                    nodes[me][2] = grow(some[near])
                    nodes[me][3] = grow(some[~near])
                    return me
            arranged.append(some)
            count += len(some)
            return me

        grow(np.arange(len(ids)))
        laid = np.concatenate(arranged)
        places = np.empty_like(laid)
        places[laid] = np.arange(len(laid))
        return cls(flat.rows[laid], flat.ids[laid], flat.vectors[laid], most, places[np.array(points)], np.array(spans), np.array(nodes))

    def to_bytes(self) -> bytes:
        sink = io.BytesIO()
        np.savez(sink, rows=self.rows, ids=self.ids, vectors=self.vectors, most=self.most, points=self.points, spans=self.spans, nodes=self.nodes)
        return sink.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> VantageTree:
        held = np.load(io.BytesIO(data))
        return cls(*(held[k] for k in ("rows", "ids", "vectors", "most", "points", "spans", "nodes")))

    def search(self, own: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the k best ids and scores, best first, ties to the smaller id; id -1 where there are fewer.

        ``own`` are the queries' own rows, which are no neighbours; nothing below the scores of ``floor`` is asked for.
        """
        n = len(queries)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        floor = np.full(n, -np.inf) if floor is None else floor
        squares = np.einsum("ij,ij->i", queries, queries)
        slack = 1e-6 * np.sqrt(squares + self.most)
        raised = np.hstack([queries, np.zeros((n, 1))])

        def reach(some: np.ndarray) -> np.ndarray:
            worst = np.maximum(scores[some, -1], floor[some])
            return factor * np.sqrt(np.maximum(squares[some] + self.most - 2 * worst, 0.0)) + slack[some]

        def visit(node: int, some: np.ndarray) -> None:
            start, end, inside, outside = self.nodes[node]
            if inside < 0:
                self.seen += len(some) * (end - start)
                found = np.einsum("ij,kj->ik", queries[some], self.vectors[start:end])
                names = self.ids[start:end]
                found[own[some][:, None] == self.rows[start:end]] = -np.inf
                better = found.max(axis=1) >= np.maximum(scores[some, -1], floor[some])
                some, found = some[better], found[better]
                if len(some):
                    first = np.argsort(-found, axis=1, kind="stable")[:, :k]  # a leaf's rows are in order of their ids
                    found, names = np.take_along_axis(found, first, 1), names[first]
                    all_scores = np.hstack([scores[some], found])
                    all_ids = np.hstack([ids[some], names])
                    all_ids[np.isneginf(all_scores)] = -1
                    by_id = np.argsort(all_ids, axis=1, kind="stable")
                    all_scores, all_ids = np.take_along_axis(all_scores, by_id, 1), np.take_along_axis(all_ids, by_id, 1)
                    best = np.argsort(-all_scores, axis=1, kind="stable")[:, :k]
                    scores[some], ids[some] = np.take_along_axis(all_scores, best, 1), np.take_along_axis(all_ids, best, 1)
                return
            d = np.sqrt(((raised[some] - self.lifted[self.points[node]]) ** 2).sum(axis=1))
            low_in, high_in, low_out, high_out = self.spans[node]
            to_in = np.maximum(np.maximum(low_in - d, d - high_in), 0.0)
            to_out = np.maximum(np.maximum(low_out - d, d - high_out), 0.0)
            sides = [(inside, to_in), (outside, to_out)]
            # the side that is nearer for most goes first
            for child, far in sides if (to_in <= to_out).mean() >= 0.5 else sides[::-1]:
                go = some[far <= reach(some)]
                if len(go):
                    visit(child, go)

        if len(self.ids) and n:
            visit(0, np.arange(n))
        return ids, scores


def matrix(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False)
    return rows.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def usable(vectors: DataFrame, asked: Column | None, vec_id: str, embedding: str) -> DataFrame:
    """row (a number of its own), vec_id, embedding as doubles, dims and asked of the rows that take part, as a table."""
    e = F.col("embedding")
    query = F.lit(True) if asked is None else F.coalesce(asked, F.lit(False))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"), query.alias("asked"))
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(e, lambda x: x != 0.0))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", F.size("embedding").alias("dims"), "asked"), "vectors")


class Index:
    """Trees in the shared folder, with the upper levels and the shards' bounds by number of dimensions."""

    def __init__(self, rows: DataFrame):
        square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
        about = rows.groupBy("dims").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("most")).collect()
        self.most = {r.dims: r.most for r in about}
        self.tops = {r.dims: self.fitted(rows, r.dims, r.n) for r in about}
        self.folder = new_folder(rows.sparkSession, "vantage-trees")
        self.rows = self.routed(rows)
        self.shards = self.built()

    def fitted(self, rows: DataFrame, dims: int, n: int) -> TopTree:
        most = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * dims)))
        depth = min(max(0, (-(-8 * dims * n // SHARD_BYTES) - 1).bit_length()), max(0, (most // 32).bit_length() - 1))
        sample = rows.filter(F.col("dims") == dims).orderBy(F.xxhash64("row")).limit(most).select("embedding").collect() if depth else []
        vectors = np.array([r[0] for r in sample]).reshape(len(sample), dims)
        return TopTree(lifted(vectors, self.most[dims]), depth, dims + 1)

    def routed(self, rows: DataFrame) -> DataFrame:
        """The rows with the shard and the tree of it that each belongs to."""
        tops, most = self.tops, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, shards = batch.column(3).to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
                for width in np.unique(dims):
                    some = np.flatnonzero(dims == width)
                    shards[some] = tops[width].route(lifted(matrix(batch.column(2).take(pa.array(some))), most[width]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards)], names=[*batch.schema.names, "shard"])

        dealt = written(rows.mapInArrow(trimmed(run), f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, shard int"), "routed")
        sizes = dealt.groupBy("dims", "shard").agg(F.ceil(F.count(F.lit(1)) * F.col("dims") * 8 / SHARD_BYTES).alias("pieces"))
        return dealt.join(sizes, ["dims", "shard"]).withColumn("piece", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int")).drop("pieces")

    def built(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Writes the trees; shards, pieces and ranges of distance to the vantage points above, by dims: a row a tree."""
        folder, tops, most = self.folder, self.tops, self.most
        files, base = file_system(folder)
        files.create_dir(base, recursive=True)

        def build(group: pa.Table) -> pa.Table:
            from pyspark import TaskContext

            dims, shard, piece = (group[c][0].as_py() for c in ("dims", "shard", "piece"))
            vectors = matrix(group["embedding"].combine_chunks())
            tree = VantageTree.build(group["row"].to_numpy(), group["vec_id"].to_numpy(), vectors, most[dims])
            files, base = file_system(folder)
            name = f"{base}/{dims}-{shard}-{piece}"
            with files.open_output_stream(draft := f"{name}.{TaskContext.get().taskAttemptId()}.draft", compression=None) as sink:
                sink.write(tree.to_bytes())
            files.move(draft, f"{name}.tree")
            d = distances(tree.lifted, tops[dims].path(shard)) if tops[dims].depth else np.zeros((len(vectors), 0))
            return pa.table({"dims": group["dims"][:1], "shard": group["shard"][:1], "piece": group["piece"][:1], "low": pa.array([d.min(axis=0)], pa.list_(pa.float64())), "high": pa.array([d.max(axis=0)], pa.list_(pa.float64()))})

        told = self.rows.groupBy("dims", "shard", "piece").applyInArrow(build, "dims int, shard int, piece int, low array<double>, high array<double>").collect()
        out = {}
        for dims in {r.dims for r in told}:
            some = sorted((r.shard, r.piece, r.low, r.high) for r in told if r.dims == dims)
            out[dims] = tuple(np.array(x) for x in zip(*some, strict=True))
        return out

    def search(self, visits: DataFrame, k: int, factor: float, queries: int) -> DataFrame:
        """(row, vec_id, score) of the neighbours found by (dims, shard, piece, row, floor, embedding) visits."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = file_system(folder)
            for unit in units(batches, 3):
                name = "-".join(str(unit[i][0].as_py()) for i in range(3))
                with files.open_input_file(f"{base}/{name}.tree") as source:
                    tree = VantageTree.from_bytes(source.read())
                for at in range(0, unit.num_rows, STEP_QUERIES):
                    part = unit.slice(at, STEP_QUERIES)
                    own = part["row"].to_numpy()
                    ids, scores = tree.search(own, matrix(part["embedding"].combine_chunks()), k, factor, part["floor"].to_numpy())
                    real = np.flatnonzero(~np.isneginf(scores.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)[real]), pa.array(ids.ravel()[real]), pa.array(scores.ravel()[real])], names=["row", "vec_id", "score"])

        blocks = max(1, -(-queries // BLOCK_QUERIES))
        laid = visits.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks))).repartition("dims", "shard", "piece", "block").sortWithinPartitions("dims", "shard", "piece", "row")
        return laid.select("dims", "shard", "piece", "row", "floor", "embedding").mapInArrow(trimmed(run), "row long, vec_id long, score double")

    def near(self, queries: DataFrame, factor: float, home: bool) -> DataFrame:
        """The visits of (row, dims, embedding, floor) queries: to their own shards, or to the others that bounds don't exclude."""
        tops, most, shards = self.tops, self.most, self.shards

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column(1).to_numpy()
                for width in np.unique(dims):
                    some = np.flatnonzero(dims == width)
                    shard, piece, low, high = shards[width]
                    step = max(1, STEP_VISITS // len(shard))
                    for at in range(0, len(some), step):
                        part = batch.take(pa.array(some[at : at + step]))
                        vectors = matrix(part.column(2))
                        raised = np.hstack([vectors, np.zeros((len(vectors), 1))])
                        go = tops[width].route(raised)[:, None] == shard[None, :]
                        if not home:
                            square, floor = np.einsum("ij,ij->i", vectors, vectors), part.column(3).to_numpy()
                            reach = factor * np.sqrt(np.maximum(square + most[width] - 2 * floor, 0.0)) + 1e-6 * np.sqrt(square + most[width])
                            go = ~go & (tops[width].bounds(raised, shard, low, high) <= reach[:, None])
                        who, where = np.nonzero(go)
                        asked = part.take(pa.array(who))
                        told = [asked.column(1), pa.array(shard[where].astype(np.int32)), pa.array(piece[where].astype(np.int32)), asked.column(0), asked.column(3), asked.column(2)]
                        yield pa.RecordBatch.from_arrays(told, names=["dims", "shard", "piece", "row", "floor", "embedding"])

        return queries.select("row", "dims", "embedding", "floor").mapInArrow(trimmed(run), "dims int, shard int, piece int, row long, floor double, embedding array<double>")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, asked: Column | None = None, k: int = 20, factor: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of each query row by inner product, the row itself left out.

    The rows for which the condition ``asked`` holds are the queries (all, if it is None). Vectors that are null or zero, or hold
    null or non-finite components, and rows without an id take no part; vectors of different lengths
    never meet. Rows are told apart by themselves: another row with the query's id is a neighbour like
    any other, and a query id that comes twice has its neighbours twice. Ties go to the smaller id, an
    empty table gives an empty result, an id that is no whole number raises, and other columns don't matter.
    """
    rows = usable(vectors, asked, vec_id, embedding)
    index = Index(rows)
    queries = rows.filter("asked")
    n = queries.count()
    floor = F.lit(float("-inf"))
    home = written(best_of(index.search(index.near(queries.withColumn("floor", floor), factor, True), k, factor, n), k), "found-at-home")
    worst = home.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    reached = queries.join(worst, "row", "left").withColumn("floor", F.when(F.col("n") >= k, F.col("least")).otherwise(floor))
    away = index.search(index.near(reached, factor, False), k, factor, n)
    best = best_of(home.select("row", "vec_id", "score").unionByName(away), k)
    told = best.join(queries.select("row", F.col("vec_id").alias("query_id")), "row")
    return told.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
