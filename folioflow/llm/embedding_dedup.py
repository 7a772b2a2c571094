"""Near-duplicate vectors of equal labels by cosine, found with an inverted multi-index.

Unit vectors of cosine c lie at the squared distance 2 - 2 c, which is the sum of those of their halves.

1. Rows whose vectors are equal under one label become one node with their number; their links among
   one another are counted, not made.
2. A codebook for each half, fitted on a bounded sample, spans a grid of cells. Every node belongs to
   a cell of its label; a cell's nodes are stored in blocks of bounded size.
3. From each block, cells are visited in order of the sum of both halves' least squared distances (a
   multi-sequence traversal) until that sum passes the squared distance of the threshold: no link can
   lie beyond, so the recall is 1.0. A smaller target recall stops earlier, where that share of the links
   in the sample has been met.
4. Blocks that a traversal joins are compared in double precision. Only counts of links by node, and
   of each comparison a spanning forest of its links, leave a task: rows grow with the nodes, not with the pairs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.llm.ann import matrix
from folioflow.llm.common import file_system, new_folder, runs_of, trimmed, written
from folioflow.llm.ngram_join import connected, low_labels

#: Codebooks are fitted on at most so many nodes of one length, and so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
#: A cell has about so many nodes, while a codebook has at most so many entries; a block has at most about twice BLOCK.
CELL, MOST_ENTRIES, BLOCK = 256, 1024, 1024
#: Tasks among which the comparisons of a block are dealt.
SPLITS = 16
#: Sums of rounding, of squared distances of unit vectors.
SLACK = 1e-9
#: Cosines nearer to the threshold than this are computed anew, pair by pair.
CLOSE = 1e-12


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Rows brought to length one; components of any size neither overflow nor vanish."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Computed from the vectors as they are, unless their squares leave the range of doubles."""
    sizes = np.array([a @ a, b @ b])
    if not (np.isfinite(sizes) & (sizes > 1e-280)).all():
        a, b = unit_rows(np.array([a, b]))
        return float(a @ b)
    return float(a @ b / (np.sqrt(sizes[0]) * np.sqrt(sizes[1])))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The squared distances of all rows of ``a`` to all rows of ``b``."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0.0)


def fitted(sample: np.ndarray, entries: int, rounds: int = 8) -> np.ndarray:
    """A codebook by Lloyd's rounds, from entries spread evenly over the sample."""
    book = sample[np.linspace(0, len(sample) - 1, entries).astype(int)].copy()
    for _ in range(rounds):
        near = squares(sample, book).argmin(axis=1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=entries)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return book


def multi_sequence(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs of entries in order of the sum of their values, until it exceeds ``limit``."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, reached = [(first[a[0]] + second[b[0]], 0, 0)], np.zeros(len(a), dtype=int)
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(a[i]), int(b[j])
        # the pair to the right, and the pair below where nothing nearer stands before it
        if j + 1 < len(b):
            heapq.heappush(heap, (first[a[i]] + second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a) and not reached[i + 1]:
            reached[i + 1] = 1
            heapq.heappush(heap, (first[a[i + 1]] + second[b[0]], i + 1, 0))


class Grid:
    """The codebooks of both halves, and the squared distance at which a traversal stops."""

    def __init__(self, sample: np.ndarray, groups: list, entries: int, threshold: float, recall: float):
        self.cut, self.limit = sample.shape[1] - sample.shape[1] // 2, max(0.0, 2 - 2 * threshold) + SLACK
        halves = self.halves(sample)
        self.books = [fitted(h, min(entries, len(sample)) if h.shape[1] else 1) for h in halves]
        if recall < 1.0:
            needed = self.needed(sample, np.unique(np.array(groups, dtype=object).astype(str), return_inverse=True)[1], threshold)
            self.limit = min(self.limit, float(np.quantile(needed, recall)) + SLACK) if len(needed) else self.limit

    def halves(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return units[:, : self.cut], units[:, self.cut :]

    def cells(self, units: np.ndarray) -> np.ndarray:
        first, second = (squares(h, book).argmin(axis=1) for h, book in zip(self.halves(units), self.books, strict=True))
        return first * len(self.books[1]) + second

    def bounds(self, units: np.ndarray) -> list[np.ndarray]:
        """For either half, a row's least squared distance to what is nearest to each entry: to the plane between that and its own entry."""
        out = []
        for half, book in zip(self.halves(units), self.books, strict=True):
            d = squares(half, book)
            own = d.argmin(axis=1)
            apart = np.sqrt(squares(book, book))[own]
            gap = np.divide(d - d[np.arange(len(d)), own][:, None], 2 * apart, out=np.zeros_like(d), where=apart > 1e-6)
            out.append(np.maximum(gap - 1e-7, 0.0) ** 2)
        return out

    def visits(self, units: np.ndarray) -> list[int]:
        """The cells that the rows of a block visit, nearest first."""
        first, second = (b.min(axis=0) for b in self.bounds(units))
        return [i * len(self.books[1]) + j for i, j in multi_sequence(first, second, self.limit)]

    def needed(self, sample: np.ndarray, groups: np.ndarray, threshold: float) -> np.ndarray:
        """Of the links of up to 2,000 rows of the sample: the sum that a traversal has to reach."""
        found = []
        first, second = self.bounds(sample)
        near = [squares(h, book).argmin(axis=1) for h, book in zip(self.halves(sample), self.books, strict=True)]
        for i in range(min(len(sample), 2000)):
            other = np.flatnonzero((sample @ sample[i] >= threshold) & (groups == groups[i]))
            other = other[other != i]
            found.append(first[i, near[0][other]] + second[i, near[1][other]])
        return np.concatenate(found) if found else np.zeros(0)


def usable(embedding: Column) -> Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0.0), F.lit(False))


def grids(nodes: DataFrame, threshold: float, recall: float) -> dict[int, Grid]:
    """A grid for each length of vectors."""
    sizes = nodes.groupBy("dims", "grp").agg(F.count(F.lit(1)).alias("n")).groupBy("dims").agg(F.max("n").alias("n")).collect()
    out = {}
    for dims, n in sizes:
        most = min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // (8 * dims)))
        sample = nodes.filter(F.col("dims") == dims).orderBy("h1", "h2", "grp").limit(most).select("embedding", "grp").collect()
        vectors = unit_rows(np.array([r[0] for r in sample]).reshape(len(sample), dims))
        entries = max(1, min(MOST_ENTRIES, len(sample) // 16, round((n / CELL) ** 0.5)))
        out[dims] = Grid(vectors, [r[1] for r in sample], entries, threshold, recall)
    return out


class Blocks:
    """The nodes' vectors in files of the shared folder, a block for each cell or part of it."""

    def __init__(self, nodes: DataFrame, known: dict[int, Grid]):
        self.folder = new_folder(nodes.sparkSession, "blocks")
        files, base = file_system(self.folder)
        files.create_dir(base, recursive=True)
        fields = "grp string, dims int, cell int, node long, h1 long, m long, embedding array<double>"

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims, cells = batch.column(1).to_numpy(), np.zeros(batch.num_rows, dtype=np.int32)
                for width in np.unique(dims):
                    some = np.flatnonzero(dims == width)
                    cells[some] = known[width].cells(unit_rows(matrix(batch.column(5).take(pa.array(some)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells), *(batch.column(i) for i in range(2, 6))], names=[f.split()[0] for f in fields.split(", ")])

        placed = written(nodes.select("grp", "dims", "node", "h1", "m", "embedding").mapInArrow(trimmed(place), fields), "cells")
        sizes = placed.groupBy("grp", "dims", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        keys = ["grp", "dims", "cell", "part"]
        dealt = placed.join(sizes, ["grp", "dims", "cell"]).withColumn("part", F.pmod(F.xxhash64("h1"), F.col("parts")).cast("int"))
        dealt = dealt.select(*keys, "node", "m", "embedding").repartition(*keys).sortWithinPartitions(*keys, "node")
        folder = self.folder

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            context = TaskContext.get()
            name = f"{context.partitionId():06d}-{context.taskAttemptId()}.blocks"  # an attempt has its own file; only those that the table names are read
            files, base = file_system(folder)
            sink, at = None, 0
            for unit in runs_of(batches, 4):
                vectors = matrix(unit["embedding"].combine_chunks())
                data = unit["node"].to_numpy().astype("<i8").tobytes() + unit["m"].to_numpy().astype("<i8").tobytes() + np.ascontiguousarray(vectors).tobytes()
                sink = sink or files.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(data)
                visits = known[vectors.shape[1]].visits(unit_rows(vectors))
                columns = [unit[c][:1].combine_chunks() for c in keys[:3]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([name]), pa.array([at], pa.int64()), pa.array([len(vectors)], pa.int32()), pa.array([visits], pa.list_(pa.int32()))], names=[*keys[:3], "file", "at", "n", "visits"])
                at += len(data)
            if sink:
                sink.close()

        self.table = written(dealt.mapInArrow(trimmed(store), "grp string, dims int, cell int, file string, at long, n int, visits array<int>"), "block-table")

    def meetings(self, exact: bool) -> DataFrame:
        """Pairs of blocks to compare, from either side."""
        block = F.struct("file", "at", "n")
        asked = self.table.select("grp", "dims", block.alias("a"), F.explode("visits").alias("cell"))
        met = asked.join(self.table.select("grp", "dims", "cell", block.alias("b")), ["grp", "dims", "cell"]).select("dims", "a", "b")
        if not exact:  # then one side may visit the other alone
            met = met.unionByName(met.select("dims", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        return met

    def compared(self, met: DataFrame, threshold: float) -> DataFrame:
        """(node, links, label): for each node with links in a comparison their number, and of the links' components the least node."""
        folder = self.folder

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = file_system(folder)
            sources: dict[str, object] = {}

            def block(dims: int, file: str, at: int, n: int) -> tuple:
                if file not in sources:
                    if len(sources) > 64:
                        sources.clear()
                    sources[file] = files.open_input_file(f"{base}/{file}")
                data = sources[file].read_at(n * (16 + 8 * dims), at)
                vectors = np.frombuffer(data, np.float64, n * dims, 16 * n).reshape(n, dims)
                return np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i8", n, 8 * n), vectors, unit_rows(vectors)

            for unit in runs_of(batches, 4):
                dims, own = unit["dims"][0].as_py(), tuple(unit[c][0].as_py() for c in ("file_a", "at_a", "n_a"))
                nodes, _, vectors, units = block(dims, *own)
                links, low = np.zeros(len(nodes), dtype=np.int64), nodes.copy()
                labels: list[tuple[np.ndarray, np.ndarray]] = []
                for other in zip(*(unit[c].to_pylist() for c in ("file_b", "at_b", "n_b")), strict=True):
                    others, weights, theirs, there = block(dims, *other)
                    cosines = units @ there.T
                    linked = cosines >= threshold
                    for i, j in zip(*np.nonzero(np.abs(cosines - threshold) <= CLOSE), strict=True):
                        linked[i, j] = cosine(vectors[i], theirs[j]) >= threshold
                    if own == other:
                        np.fill_diagonal(linked, False)
                    if linked.any():
                        links += linked.astype(np.int64) @ weights
                        a, b = np.nonzero(linked)
                        both = low_labels(len(nodes) + len(others), a, b + len(nodes), np.concatenate([low, others]))
                        low, far = both[: len(nodes)], both[len(nodes) :]
                        moved = np.flatnonzero(far != others)
                        labels.append((others[moved], far[moved]))
                some = np.flatnonzero(links)
                names = np.concatenate([nodes[some], *(x for x, _ in labels)])
                if len(names):
                    least = np.concatenate([low[some], *(y for _, y in labels)])
                    counts = np.concatenate([links[some], np.zeros(len(names) - len(some), dtype=np.int64)])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts), pa.array(least)], names=["node", "links", "label"])

        flat = met.select("dims", *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("file", "at", "n")))
        split = F.pmod(F.xxhash64("file_b", "at_b"), F.lit(SPLITS))
        laid = flat.withColumn("split", split).repartition("file_a", "at_a", "split").sortWithinPartitions("dims", "file_a", "at_a", "n_a", "split")
        return laid.drop("split").mapInArrow(trimmed(run), "node long, links long, label long")


def linked_vectors(vectors: DataFrame, threshold: float = 0.93, recall: float = 1.0, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for each row: its links of at least ``threshold`` to other rows of its label.

    A vector that is null or zero or holds null or non-finite components, and a row without a label or an id,
    links with nothing: it has no links, is its own component and is kept. Vectors of different lengths
    don't link. Rows with equal vectors and labels link with one another, repeated rows and rows with equal
    ids too; ``kept`` holds for each row that has its component's least id. ``threshold`` has to be positive.
    An empty table gives an empty result; other columns don't matter.
    """
    if threshold <= 0:
        raise ValueError("threshold has to be positive")
    e = F.col("embedding")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"), F.col(f"`{label}`").cast("string").alias("grp"))
    takes = F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & usable(e)
    keyed = rows.filter(takes).select("vec_id", "grp", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2"))
    grouped = keyed.groupBy("grp", "h1", "h2").agg(F.count(F.lit(1)).alias("m"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    nodes = written(grouped.select(F.monotonically_increasing_id().alias("node"), "*", F.size("embedding").alias("dims")), "nodes")
    blocks = Blocks(nodes, grids(nodes, threshold, recall))
    found = written(blocks.compared(blocks.meetings(recall >= 1.0), threshold), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = connected(found.select("node", "label"))
    least = labels.join(nodes.select("node", "least"), "node").groupBy("label").agg(F.min("least").alias("component"))
    known = nodes.select("node", "grp", "h1", "h2", "m", "least").join(counts, "node", "left").join(labels.join(least, "label").select("node", "component"), "node", "left")
    known = known.select("grp", "h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "least").alias("component_id"))
    told = keyed.select("vec_id", "grp", "h1", "h2").join(known, ["grp", "h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.coalesce(takes, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
