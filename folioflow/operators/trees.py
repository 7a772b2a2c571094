"""Trees and chains: inherited attributes, qualified names, chains of references, all with guards against loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(nodes: DataFrame, node: str, parent: str, name: str, inherited: list[str], order: str | None = None, most: int = 50) -> DataFrame:
    """Every node that a root reaches: depth, dotted name, place as an array, and attributes that it or its nearest ancestor has.

    A node's children are found level by level, and a node is never below itself. Each level is one join
    on the parent; a tree with more than ``most`` levels raises.
    """
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    own = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(name).alias("own_name"), place.alias("ord"), *(F.col(a).alias(f"own_{a}") for a in inherited))
    level = own.filter(F.col("parent").isNull()).select("node", "parent", F.lit(0).alias("depth"), F.coalesce("own_name", F.lit("")).alias("path_name"), F.array("ord").alias("place"), F.array("node").alias("seen"), *(F.col(f"own_{a}").alias(a) for a in inherited))
    found = level
    for _ in range(most):
        up = level.select(F.col("node").alias("parent"), "depth", "path_name", "place", "seen", *inherited)
        below = own.join(up, "parent").filter(~F.array_contains("seen", F.col("node")))
        level = below.select(
            "node", "parent", (F.col("depth") + 1).alias("depth"),
            F.when(F.col("own_name").isNull(), F.col("path_name")).when(F.col("path_name") == "", F.col("own_name")).otherwise(F.concat_ws(".", "path_name", "own_name")).alias("path_name"),
            F.concat("place", F.array("ord")).alias("place"), F.concat("seen", F.array("node")).alias("seen"),
            *(F.coalesce(f"own_{a}", a).alias(a) for a in inherited),
        ).checkpoint()
        if level.isEmpty():
            return found
        found = found.unionByName(level)
    raise ValueError(f"the tree has more than {most} levels")


def walk_sql(view: str, node: str, parent: str, name: str, inherited: list[str], most: int = 50) -> str:
    """The same as one recursive query, for a view's columns; a tree with more than ``most`` levels raises when it is run."""
    first = ", ".join(["", *inherited])
    later = "".join(f", coalesce(c.{a}, p.{a})" for a in inherited)
    return f"""
        WITH RECURSIVE walked (node, depth, path_name{first}) AS (
            SELECT {node}, 0, {name}{first} FROM {view} WHERE {parent} IS NULL
            UNION ALL
            SELECT c.{node}, p.depth + 1, concat(p.path_name, '.', c.{name}){later} FROM {view} AS c JOIN walked AS p ON c.{parent} = p.node
            WHERE CASE WHEN p.depth < {most} THEN true ELSE raise_error('the tree has more than {most} levels') IS NULL END
        )
        SELECT * FROM walked
    """


def resolve_chain(links: DataFrame, source: str, target: str, most: int = 10) -> DataFrame:
    """Where each source's chain of references ends, and in how many steps; null where it is longer than ``most`` or goes round.

    Distances double from join to join.
    """
    step = links.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("b is not null").dropDuplicates(["a"])
    now, reach = step.select("a", "b", F.lit(1).alias("steps")), 1
    while reach <= most:
        now = now.join(now.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("steps").alias("more")), "b", "left").select("a", F.coalesce("c", "b").alias("b"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")).checkpoint()
        reach *= 2
    ends = step.select(F.col("a").alias("b"), F.lit(True).alias("_goes_on"))
    told = now.join(ends, "b", "left")
    whole = F.col("_goes_on").isNull() & (F.col("steps") <= most)
    return told.select(F.col("a").alias(source), F.when(whole, F.col("b")).alias("end"), F.when(whole, F.col("steps")).alias("steps"))
