"""The graphics state of page content as scans over a table of operations.

Operations have keys (a document and page), an index that orders them, an operator and its numbers. A page whose
indices lie in one block is one row, folded from operation to operation; on larger pages no step does so. Running
sums, least and greatest values are taken by blocks of indices and from block to block, so a page of
millions of operations is work for many tasks. Products of matrices are associative and taken by
blocks of blocks; scopes, which q opens and Q ends, hand their matrix down by doubling steps over parents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.geometry import matrix_product

#: Indices of a block of a running value, and matrices that are multiplied in one row.
BLOCK, FOLD = 4096, 64
_IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def identity() -> Column:
    return F.struct(*(F.lit(v).alias(n) for v, n in zip(_IDENTITY, "abcdef", strict=True)))


def matrix_of(numbers: Column) -> Column:
    """Six numbers as a matrix; the identity where they aren't six."""
    return F.when(F.size(numbers) == 6, F.struct(*(F.get(numbers, F.lit(i)).cast("double").alias(n) for i, n in enumerate("abcdef")))).otherwise(identity())


def running(rows: DataFrame, keys: list[str], index: str, values: dict[str, tuple[str, Column]], block: int = BLOCK) -> DataFrame:
    """Adds running values up to each row, itself included: ``values`` has a kind (sum, max or min) and a column by name."""
    cut = F.floor(F.col(index) / block)
    held = rows.withColumn("_block", cut).withColumns({f"_v_{n}": v for n, (_, v) in values.items()})
    inner = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    totals = held.groupBy(*keys, "_block").agg(*(_KINDS[kind][0](f"_v_{n}").alias(f"_t_{n}") for n, (kind, _) in values.items()))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", *(_KINDS[kind][0](f"_t_{n}").over(before).alias(f"_p_{n}") for n, (kind, _) in values.items()))
    both = held.withColumns({f"_i_{n}": _KINDS[kind][0](f"_v_{n}").over(inner) for n, (kind, _) in values.items()}).join(totals, [*keys, "_block"])
    told = both.withColumns({n: _KINDS[kind][1](F.col(f"_p_{n}"), F.col(f"_i_{n}")) for n, (kind, _) in values.items()})
    return told.select(*rows.columns, *values)


def products_before(rows: DataFrame, keys: list[str], index: str, matrix: str, most: int = 1 << 40) -> DataFrame:
    """keys, index and ``before``: the product of the matrices of smaller indices under the same keys, the latest applied first."""
    cut = F.floor(F.col(index) / FOLD).cast("long")
    sorted_rows = F.sort_array(F.collect_list(F.struct(F.col(index).cast("long").alias("i"), F.col(matrix).alias("m"))))
    groups = rows.groupBy(*keys, cut.alias("_block")).agg(sorted_rows.alias("_rows"))
    product = F.aggregate("_rows", identity(), lambda done, r: matrix_product(r["m"], done))
    if most > FOLD:
        totals = groups.select(*keys, F.col("_block").alias("_index"), product.alias("_total"))
        outer = products_before(totals, keys, "_index", "_total", most // FOLD).select(*keys, F.col("_index").alias("_block"), F.col("before").alias("_outer"))
        groups = groups.join(outer, [*keys, "_block"])
    else:
        groups = groups.withColumn("_outer", identity())
    # each row's product is that of the rows before it in its block, after what comes before the block
    first = F.struct(F.col("_outer").alias("done"), F.array().cast("array<struct<i: bigint, before: struct<a: double, b: double, c: double, d: double, e: double, f: double>>>").alias("told"))
    walked = F.aggregate("_rows", first, lambda s, r: F.struct(matrix_product(r["m"], s["done"]).alias("done"), F.concat(s["told"], F.array(F.struct(r["i"].alias("i"), s["done"].alias("before")))).alias("told")), lambda s: s["told"])
    return groups.select(*keys, F.explode(walked).alias("_told")).select(*keys, F.col("_told.i").alias(index), F.col("_told.before").alias("before"))


def scoped(ops: DataFrame, keys: list[str], index: str = "op_index", operator: str = "operator") -> DataFrame:
    """Adds ``depth``, after each operation, and ``scope``, the index of the q that is open there (-1 outside all); a Q too many does nothing."""
    step = F.when(F.col(operator) == "q", 1).when(F.col(operator) == "Q", -1).otherwise(0)
    sums = running(ops, keys, index, {"_sum": ("sum", step)})
    deep = running(sums, keys, index, {"_least": ("min", F.least(F.col("_sum"), F.lit(0)))}).withColumn("depth", (F.col("_sum") - F.col("_least")).cast("int")).drop("_sum", "_least")
    opened = running(deep, [*keys, "depth"], index, {"_scope": ("max", F.when(F.col(operator) == "q", F.col(index)))})
    return opened.withColumn("scope", F.when(F.col("depth") == 0, F.lit(-1)).otherwise(F.col("_scope")).cast("long")).drop("_scope")


def page_blocks(ops: DataFrame, keys: list[str], index: str, operator: str, numbers: str, shows: tuple[str, ...]) -> DataFrame:
    """keys, _block and ``_ops``: the operations of a block of indices in order, each with its index, its kind and its matrix or move."""
    op, n = F.col(operator), F.col(numbers)
    kind = F.when(op.isin(*shows), "s").when(op.isin("q", "Q", "cm", "Td"), op).when(op.isin("BT", "Tm"), "line")
    move = lambda i: F.coalesce(F.get(n, F.lit(i)).cast("double"), F.lit(0.0))
    moved = F.struct(*(F.lit(v).alias(c) for v, c in zip(_IDENTITY[:4], "abcd", strict=True)), move(0).alias("e"), move(1).alias("f"))
    matrix = F.when(op.isin("cm", "Tm"), matrix_of(n)).when(op == "Td", moved).when(op == "BT", identity())
    rows = ops.dropna(subset=[*keys, index]).select(*keys, F.floor(F.col(index) / BLOCK).cast("long").alias("_block"), F.struct(F.col(index).alias("i"), kind.alias("kind"), matrix.alias("m")).alias("_op"))
    return rows.filter("_op.kind IS NOT NULL").groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_op")).alias("_ops"))


def folded(blocks: DataFrame, keys: list[str], index: str) -> DataFrame:
    """keys, index, depth, line and ctm of what is shown on pages that are one block."""
    kind = blocks.schema["_ops"].dataType.elementType["i"].dataType.simpleString()
    matrix = "struct<a: double, b: double, c: double, d: double, e: double, f: double>"
    none = lambda each: F.array().cast(f"array<{each}>")
    first = F.struct(identity().alias("ctm"), none(matrix).alias("held"), identity().alias("line"), none(f"struct<i: {kind}, depth: int, line: {matrix}, ctm: {matrix}>").alias("told"))

    def step(s: Column, r: Column) -> Column:
        op, ctm, held, line, m = r["kind"], s["ctm"], s["held"], s["line"], r["m"]
        deep = F.size(held)
        moved = F.struct(*(line[c].alias(c) for c in "abcd"), (m["e"] * line["a"] + m["f"] * line["c"] + line["e"]).alias("e"), (m["e"] * line["b"] + m["f"] * line["d"] + line["f"]).alias("f"))
        shown = F.struct(r["i"].alias("i"), deep.alias("depth"), line.alias("line"), ctm.alias("ctm"))
        return F.struct(
            F.when(op == "cm", matrix_product(m, ctm)).when((op == "Q") & (deep > 0), F.get(held, deep - 1)).otherwise(ctm).alias("ctm"),
            F.when(op == "q", F.concat(held, F.array(ctm))).when((op == "Q") & (deep > 0), F.slice(held, F.lit(1), deep - 1)).otherwise(held).alias("held"),
            F.when(op == "line", m).when(op == "Td", moved).otherwise(line).alias("line"),
            F.when(op == "s", F.concat(s["told"], F.array(shown))).otherwise(s["told"]).alias("told"),
        )

    told = blocks.select(*keys, F.explode(F.aggregate("_ops", first, step, lambda s: s["told"])).alias("_told"))
    return told.select(*keys, F.col("_told.i").alias(index), "_told.depth", "_told.line", "_told.ctm")


def text_matrices(ops: DataFrame, keys: list[str], index: str = "op_index", operator: str = "operator", numbers: str = "numbers", shows: tuple[str, ...] = ("Tj", "TJ"), most: int = 64) -> DataFrame:
    """keys, index, depth, ``line`` (the text line matrix) and ``ctm`` of each operation that shows text.

    cm multiplies the matrix of its scope, BT and Tm begin a line matrix, Td moves it. Numbers that are missing
    count as the identity or no move. Scopes nested over ``2 ** most`` deep can't be.
    """
    blocks = page_blocks(ops, keys, index, operator, numbers, shows).checkpoint()
    large = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_blocks")).filter("_blocks > 1").select(*keys)
    if large.isEmpty():
        return folded(blocks, keys, index)
    small = folded(blocks.join(large, keys, "left_anti"), keys, index)
    return small.unionByName(scanned(ops.join(large, keys, "left_semi"), keys, index, operator, numbers, shows, most))


def scanned(ops: DataFrame, keys: list[str], index: str, operator: str, numbers: str, shows: tuple[str, ...], most: int) -> DataFrame:
    """``text_matrices`` of pages of any size, whose blocks are work for many tasks."""
    held = scoped(ops.select(*keys, index, operator, numbers), keys, index, operator).checkpoint()
    op, n = F.col(operator), F.col(numbers)
    changes = held.filter((op == "cm") | (op == "q") | op.isin(*shows))
    opens = held.filter(op == "q")
    # the scope around a q is opened by the last q one level up
    ups = held.filter(op == "q").select(*keys, index, F.col("depth").alias("_level"), F.col(index).alias("_up"))
    asks = opens.select(*keys, index, (F.col("depth") - 1).alias("_level"), F.lit(None).cast("long").alias("_up"), F.lit(True).alias("_asks"))
    found = running(ups.withColumn("_asks", F.lit(False)).unionByName(asks), [*keys, "_level"], index, {"_parent": ("max", F.col("_up"))}).filter("_asks")
    parents = found.select(*keys, F.col(index).alias("own"), F.when(F.col("_level") == 0, F.lit(-1)).otherwise(F.col("_parent")).cast("long").alias("scope"))
    local = changes.filter(op != "q").select(*keys, "scope", index, F.when(op == "cm", matrix_of(n)).otherwise(identity()).alias("_m"))
    local = local.unionByName(parents.select(*keys, "scope", F.col("own").alias(index), identity().alias("_m")))
    last = held.agg(F.max(index)).first()[0] or 0  # tells how many levels of blocks there are
    products = products_before(local, [*keys, "scope"], index, "_m", last + 1).checkpoint()
    # what a scope begins with: its own product in the scope around it, then that of the one around, and so on
    reach = parents.join(products.select(*keys, "scope", F.col(index).alias("own"), "before"), [*keys, "scope", "own"]).select(*keys, "own", F.col("scope").alias("up"), F.col("before").alias("m")).checkpoint()
    for _ in range(most):
        if reach.filter("up >= 0").isEmpty():
            break
        further = reach.select(*keys, F.col("own").alias("up"), F.col("up").alias("_up"), F.col("m").alias("_m"))
        reach = reach.join(further, [*keys, "up"], "left").select(*keys, "own", F.coalesce("_up", F.lit(-1)).alias("up"), F.when(F.col("_m").isNull(), F.col("m")).otherwise(matrix_product(F.col("m"), F.col("_m"))).alias("m")).checkpoint()
    shown = held.filter(op.isin(*shows)).select(*keys, index, "depth", "scope")
    placed = shown.join(products, [*keys, "scope", index]).join(reach.select(*keys, F.col("own").alias("scope"), F.col("m").alias("_base")), [*keys, "scope"], "left")
    placed = placed.withColumn("ctm", F.when(F.col("_base").isNull(), F.col("before")).otherwise(matrix_product(F.col("before"), F.col("_base"))))
    begun = running(held, keys, index, {"_line": ("max", F.when(op.isin("BT", "Tm"), F.col(index)))}).withColumn("_line", F.coalesce("_line", F.lit(-1)))
    move = lambda i: F.when(op == "Td", F.coalesce(F.get(n, F.lit(i)).cast("double"), F.lit(0.0))).otherwise(0.0)
    moved = running(begun, [*keys, "_line"], index, {"_x": ("sum", move(0)), "_y": ("sum", move(1))}).filter(op.isin(*shows)).select(*keys, index, "_line", "_x", "_y")
    starts = held.filter(op == "Tm").select(*keys, F.col(index).alias("_line"), matrix_of(n).alias("_tm"))
    lines = moved.join(starts, [*keys, "_line"], "left").withColumn("_tm", F.coalesce("_tm", identity()))
    shift = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("d"), F.col("_x").alias("e"), F.col("_y").alias("f"))
    lines = lines.select(*keys, index, matrix_product(shift, F.col("_tm")).alias("line"))
    return placed.select(*keys, index, "depth", "ctm").join(lines, [*keys, index]).select(*keys, index, "depth", "line", "ctm")
