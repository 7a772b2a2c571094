"""Page lists: reorder, remove, append, extract, insert, rotate, select; slots, runs and pick lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renumbered(df: DataFrame, keys: list[str], page: str, *order: Column) -> DataFrame:
    return df.withColumn(page, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("int"))


def reorder_pages(df: DataFrame, keys: list[str], page: str, place: Column) -> DataFrame:
    """Pages in the order of ``place``, ties in their old order."""
    return renumbered(df.withColumn("_place", place), keys, page, F.col("_place"), F.col(page)).drop("_place")


def remove_pages(df: DataFrame, keys: list[str], page: str, gone: Column) -> DataFrame:
    """Without the pages of ``gone``, numbered anew; a document of which all pages would go keeps them."""
    w = Window.partitionBy(*keys)
    told = df.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    left = told.withColumn("_all", F.min(F.col("_gone").cast("int")).over(w)).filter((F.col("_all") == 1) | ~F.col("_gone"))
    return renumbered(left, keys, page, F.col(page)).drop("_gone", "_all")


def append_pages(df: DataFrame, other: DataFrame, keys: list[str], page: str) -> DataFrame:
    """The other list's pages after those of the first."""
    both = df.withColumn("_side", F.lit(0)).unionByName(other.withColumn("_side", F.lit(1)))
    return renumbered(both, keys, page, F.col("_side"), F.col(page)).drop("_side")


def extract_pages(df: DataFrame, keys: list[str], page: str, wanted: list[int]) -> DataFrame:
    """The wanted pages in the wanted order, repeats allowed; documents without one of them give what they have."""
    if not wanted:
        raise ValueError("no page is wanted")
    picks = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(p).alias("page")) for i, p in enumerate(wanted)))
    found = df.select("*", F.explode(F.filter(picks, lambda x: x["page"] == F.col(page))).alias("_pick"))
    return renumbered(found, keys, page, F.col("_pick.place")).drop("_pick")


def insert_blank(df: DataFrame, keys: list[str], page: str, at: int, blank: dict[str, Column]) -> DataFrame:
    """A new page at a place, or at the end of shorter documents; the others move."""
    new = df.select(*keys).distinct().select(*keys, F.lit(at).cast(df.schema[page].dataType).alias(page), *(c.alias(k) for k, c in blank.items()))
    both = df.withColumn("_new", F.lit(1)).unionByName(new.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return renumbered(both, keys, page, F.col(page), F.col("_new")).drop("_new")


def rotate_pages(df: DataFrame, rotation: str, chosen: Column, degrees: int) -> DataFrame:
    return df.withColumn(rotation, F.when(chosen, F.pmod(F.col(rotation) + degrees, F.lit(360))).otherwise(F.col(rotation)))


def bring_to_front(df: DataFrame, keys: list[str], slot: str, chosen: Column, back: bool = False) -> DataFrame:
    """Chosen slots last (or first), all else in its order."""
    return renumbered(df.withColumn("_chosen", chosen.cast("int") * (-1 if back else 1)), keys, slot, F.col("_chosen"), F.col(slot)).drop("_chosen")


def consecutive_runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers: first, last and how many."""
    w = Window.partitionBy(*keys).orderBy(number)
    told = df.select(*keys, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    return told.groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def first_pages(df: DataFrame, keys: list[str], most: int, *order: Column) -> DataFrame:
    """At most so many rows of each key: the feature is the limit."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_nth") <= most).drop("_nth")


def interleaved(blocks: DataFrame, images: DataFrame, key: str, after: str, top: str) -> DataFrame:
    """Blocks at their index and images half a step behind the block they follow; ties from the top."""
    both = blocks.withColumn("order_key", F.col(key).cast("double")).unionByName(images.withColumn("order_key", F.col(after) + 0.5), allowMissingColumns=True)
    return both.orderBy("order_key", F.desc(top))
