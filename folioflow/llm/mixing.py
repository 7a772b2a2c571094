"""Mixing sources to target weights by Sainte-Laguë apportionment, in built-in functions only.

Targets: the sources' weights share all words; a target stops at ``cap`` times its source's size and
the excess goes to the others by weight. Blocks of equal word counts are then given out by highest
quotients target / (2 k + 1), first to sources, then to the shards of each source in proportion to
their words. A shard holds its documents in seeded order; its quota first takes whole passes, then a
run of blocks from a seeded start, going round at the end.

Only tables with a row per source or shard are ordered as a whole, and a source has at most
``MOST_SHARDS`` shards. A seat can only go to a party near its fair share (within half a seat for
each party), so only those quotients are listed, a few per party.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import free_prefix, word_array, written

#: A source has a shard for so many words, up to so many shards.
SHARD_WORDS, MOST_SHARDS = 1 << 15, 4096
#: Shards whose rows (of about 150 bytes) go to all executors at most.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in order of their names (code points, null last), again and again."""

    weights: tuple[int, ...] = (1, 2, 3)
    cap: int = 3
    block_words: int = 64
    seed: int = 7


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("v"), source.cast("string")), F.lit("n"))


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """From (source, source_size), one row a source: adds key, weight and target."""
    every = Window.partitionBy()
    named = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weights = F.array(*map(F.lit, mix.weights))
    named = named.withColumn("weight", F.get(weights, ((F.col("place") - 1) % len(mix.weights)).cast("int")).cast("double"))
    named = named.withColumn("most", F.col("source_size").cast("double") * mix.cap).withColumn("ratio", F.col("most") / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = named.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))
    final = F.min(fits).over(every)["level"]
    target = F.least(F.col("most"), F.coalesce(final * F.col("weight"), F.col("most")))
    return leveled.select(source_key(F.col("source")).alias("key"), "place", "source_size", "weight", target.alias("target"))


def apportioned(parties: DataFrame, group: list[str], order: str, weight: str, seats: Column) -> DataFrame:
    """Add ``quota``: how many of its group's ``seats`` each party gets by the highest quotients; ties go to the first in order."""
    within = Window.partitionBy(*group)
    votes, total = F.col(weight).cast("double"), F.col("all_votes")
    known = parties.withColumn("seats", seats).withColumn("all_votes", F.sum(F.col(weight).cast("double")).over(within)).withColumn("n_parties", F.count(F.lit(1)).over(within))
    share = F.when(total > 0, F.col("seats") * votes / total).otherwise(F.lit(0.0))
    slack = F.when(total > 0, F.col("n_parties") / 2.0 * votes / total).otherwise(F.lit(0.0))
    known = known.withColumn("sure", F.greatest(F.floor(share - slack - 0.5), F.lit(0)).cast("long"))
    known = known.withColumn("possible", F.when(votes > 0, F.ceil(share + slack + 0.5).cast("long") + 1).otherwise(F.lit(0)))
    known = known.withColumn("open", F.col("seats") - F.sum("sure").over(within))
    seat = F.explode(F.when(F.col("possible") > F.col("sure"), F.sequence(F.col("sure"), F.col("possible") - 1)).otherwise(F.array().cast("array<bigint>")))
    listed = known.select(*group, order, "open", votes.alias("votes"), seat.alias("seat"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col("votes") / (2 * F.col("seat") + 1)), order, "seat")
    won = listed.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= F.col("open")).groupBy(*group, order).agg(F.count(F.lit(1)).alias("won"))
    joined = known.join(won, [*group, order], "left")
    return joined.withColumn("quota", F.col("sure") + F.coalesce(F.col("won"), F.lit(0))).drop("all_votes", "n_parties", "sure", "possible", "open", "won", "seats")


def measured(docs: DataFrame, text: str, source: str, mix: Mix, names: dict[str, str]) -> DataFrame:
    """Add each row's size in words, source key and seeded rank under ``names``."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    identity = F.xxhash64(F.col(f"`{names['id']}`"), body, F.lit(mix.seed))
    return docs.select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias(names["size"]),
        source_key(F.col(f"`{source}`")).alias(names["key"]),
        identity.alias(names["rank"]),
    )


def shard_of(rank: Column, shards: Column) -> Column:
    return F.pmod(F.xxhash64(rank, F.lit(1)), shards)


def shard_plan(narrow: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """From (source, key, rank, size): the sources with their targets and number of shards, and the shards with what each gives."""
    sources = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, mix)
    total = F.sum("source_size").over(Window.partitionBy())
    seats = F.round(total / mix.block_words).cast("long")
    quotas = apportioned(targets, [], "place", "target", seats)
    shards = F.least(F.greatest(F.ceil(F.col("source_size") / SHARD_WORDS), F.lit(1)), F.lit(MOST_SHARDS)).cast("long")
    known = written(quotas.select("key", "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards")), "mix-sources")
    placed = narrow.join(known.select("key", "shards"), "key").groupBy("key", shard_of(F.col("rank"), F.col("shards")).alias("shard")).agg(F.sum("size").alias("words"))
    parties = placed.join(known.select("key", "source_quota"), "key")
    given = apportioned(parties, ["key"], "shard", "words", F.col("source_quota"))
    words = F.col("words")
    due = F.least(F.col("quota") * mix.block_words, mix.cap * words)
    blocks = F.greatest(F.ceil(words / mix.block_words), F.lit(1)).cast("long")
    plan = given.select(
        "key", "shard", "words", "quota",
        F.when(words > 0, F.expr("1")).otherwise(0).alias("any"),
        due.alias("due"),
        (F.pmod(F.xxhash64("key", "shard", F.lit(mix.seed)), blocks) * mix.block_words).alias("first"),
    )
    plan = plan.withColumn("passes", F.when(F.col("words") > 0, F.expr("due div words")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("rest", F.col("due") - F.col("passes") * F.col("words")).drop("any", "due")
    return known, written(plan, "mix-shards")


def taken_parts(rows: DataFrame, known: DataFrame, plan: DataFrame, names: dict[str, str], shards: str, place: str) -> DataFrame:
    """Add passes and the two runs of words (``tail_from``, ``tail_to``; ``head_to``) that the mix takes of each row."""
    size, key, rank = (F.col(f"`{names[n]}`") for n in ("size", "key", "rank"))
    own = [F.col(f"`{c}`") for c in rows.columns]
    first = rows.join(known.select(F.col("key").alias(shards), F.col("shards").alias(place), F.col("source_size").alias(names["source_size"]), F.col("target").alias(names["target"])), key == F.col(shards))
    first = first.select(*own, names["source_size"], names["target"], shard_of(rank, F.col(place)).alias(place))
    before = Window.partitionBy(key, F.col(place)).orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)
    first = first.withColumn(shards, F.coalesce(F.sum(size).over(before), F.lit(0)))
    inner = plan.select(F.col("key").alias("mix_key"), F.col("shard").alias("mix_shard"), F.col("words").alias("mix_words"), F.col("passes").alias("mix_passes"), F.col("first").alias("mix_first"), F.col("rest").alias("mix_rest"))
    joined = first.alias("d").join(inner.alias("m"), (F.col(f"d.{names['key']}") == F.col("m.mix_key")) & (F.col(f"d.{place}") == F.col("m.mix_shard")))
    at = F.col(f"d.{shards}")
    here = F.col(f"d.{names['size']}")
    end = F.col("m.mix_first") + F.col("m.mix_rest")
    within = lambda x: F.least(F.greatest(x - at, F.lit(0)), here)
    return joined.select(
        *(F.col(f"d.`{c}`") for c in rows.columns), F.col(f"d.{names['source_size']}"), F.col(f"d.{names['target']}"),
        F.col("m.mix_passes").alias(names["passes"]),
        within(F.col("m.mix_first")).alias(names["tail_from"]),
        within(F.least(end, F.col("m.mix_words"))).alias(names["tail_to"]),
        within(end - F.col("m.mix_words")).alias(names["head_to"]),
    )


def _taken(n: dict[str, str]) -> Column:
    c = {k: F.col(f"`{v}`") for k, v in n.items()}
    return c["passes"] * c["size"] + (c["tail_to"] - c["tail_from"]) + c["head_to"]


def mix_report(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken (words that the mix takes, repeats counted) of every row.

    Null and blank texts have size 0 and give nothing; the null source is a source; repeated rows are
    rows of their own, told apart by nothing, so each order among them gives the same rows; an empty
    table gives an empty result. Other columns of the input don't matter.
    """
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text"))
    names = {n: n for n in ("size", "key", "rank", "source_size", "target", "passes", "tail_from", "tail_to", "head_to")} | {"id": "doc_id"}
    sizes = written(measured(narrow, "text", "source", mix, names).drop("text"), "mix-sizes")
    known, plan = shard_plan(sizes, mix)
    parts = taken_parts(sizes, known, plan, names, "mix_at", "mix_place")
    return parts.select("doc_id", "size", "source_size", "target", _taken(names).alias("taken"))


def cut_points(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """For each shard of (key, shard, rank, pos, size) rows and each end of the runs that it gives: the row it falls into and how many of its words lie before.

    In the order of a shard, rows before that row are wholly before the end, rows after it wholly behind; so
    one row a shard tells what is taken of every row, and no text has to move.
    """
    before = Window.partitionBy("key", "shard").orderBy("rank", "pos").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("key", "shard").orderBy("rank", "pos")
    alone = ~(F.lag("rank").over(order).eqNullSafe(F.col("rank")) | F.lead("rank").over(order).eqNullSafe(F.col("rank")))
    placed = rows.filter("size > 0").withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("alone", alone)
    end = F.col("first") + F.col("rest")
    ends = {"tail_from": F.col("first"), "tail_to": F.least(end, F.col("words")), "head_to": end - F.col("words")}
    sent = plan.select("key", "shard", "passes", *(F.when(x <= 0, F.lit(0)).when(x >= F.col("words"), F.lit(-1)).otherwise(x).alias(n) for n, x in ends.items()))
    met = placed.join(sent, ["key", "shard"])
    here = lambda n: F.max(F.when((F.col(n) > 0) & (F.col("at") <= F.col(n)) & (F.col(n) < F.col("at") + F.col("size")), F.struct("rank", "pos", "alone", (F.col(n) - F.col("at")).alias("words"))))
    found = met.groupBy("key", "shard").agg(F.first("passes").alias("passes"), *(F.first(n).alias(n) for n in ends), *(here(n).alias(f"{n}_row") for n in ends))
    return written(found, "mix-cuts")


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", n_chars: str = "n_chars", mix: Mix = Mix()) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row for each whole pass over a document, and one for the words taken beyond.

    Words taken beyond whole passes are joined by one space, in their order; if they are the whole
    text, it comes unchanged. ``n_chars``, if there, is counted anew. Documents of which nothing is
    taken are missing. Nulls, blanks, repeated rows and empty tables are as in ``mix_report``; repeated
    rows are told apart by their place in the scan, so ``docs`` should be a table where rows repeat. Texts stay where they
    are read: what is taken of them follows from a row for each shard.
    """
    prefix = free_prefix(docs, "mix")
    n = {c: f"{prefix}_{c}" for c in ("size", "key", "rank", "pos", "shard", "passes", "tail_from", "tail_to", "head_to", "nth")}
    c = {k: F.col(f"`{v}`") for k, v in n.items()}
    measures = measured(docs, text, source, mix, {"id": doc_id, "size": n["size"], "key": n["key"], "rank": n["rank"]}).withColumn(n["pos"], F.monotonically_increasing_id())
    sizes = written(measures.select(F.col(f"`{source}`").alias("source"), *(c[k].alias(k) for k in ("key", "rank", "pos", "size"))), "mix-sizes")
    known, plan = shard_plan(sizes, mix)
    shards = known.select("key", "shards")
    cuts = cut_points(sizes.join(shards, "key").withColumn("shard", shard_of(F.col("rank"), F.col("shards"))), plan)
    own = [k for k in cuts.columns if k not in ("key", "shard")]
    # where there are very many sources, rows meet their source and shard by joins
    sent = F.broadcast if cuts.count() <= MOST_SENT else (lambda side: side)
    met = measures.join(sent(shards.select(F.col("key").alias(n["key"]), F.col("shards").alias(n["passes"]))), n["key"]).withColumn(n["shard"], shard_of(c["rank"], c["passes"])).drop(n["passes"])
    met = met.join(sent(cuts.select(F.col("key").alias(n["key"]), F.col("shard").alias(n["shard"]), F.struct(*own).alias(n["nth"]))), [n["key"], n["shard"]])
    cut = {k: c["nth"][k] for k in own}

    def before(name: str) -> Column:
        at = cut[f"{name}_row"]
        same = c["rank"] == at["rank"]
        ahead = (c["rank"] < at["rank"]) | (same & ~at["alone"] & (c["pos"] < at["pos"]))
        here = same & (at["alone"] | (c["pos"] == at["pos"]))
        return F.when(cut[name] == 0, F.lit(0)).when(cut[name] < 0, c["size"]).when(ahead, c["size"]).when(here, at["words"]).otherwise(F.lit(0)).cast("int")

    told = met.filter(c["size"] > 0).select(
        *(F.col(f"`{x}`") for x in docs.columns), c["size"].alias(n["size"]), cut["passes"].alias(n["passes"]), *(before(k).alias(n[k]) for k in ("tail_from", "tail_to", "head_to"))
    )
    beyond = c["head_to"] + c["tail_to"] - c["tail_from"]
    copies = c["passes"] + F.when(beyond > 0, 1).otherwise(0)
    told = told.withColumn(n["nth"], F.explode(F.when(copies > 0, F.sequence(F.lit(1).cast("long"), copies)).otherwise(F.array().cast("array<bigint>"))))
    words = word_array(F.col(f"`{text}`"))
    some = F.array_join(F.concat(F.slice(words, F.lit(1), c["head_to"]), F.slice(words, c["tail_from"] + 1, c["tail_to"] - c["tail_from"])), " ")
    out = n["key"]
    told = told.select(*(F.col(f"`{x}`") for x in docs.columns), F.when((c["nth"] <= c["passes"]) | (beyond == c["size"]), F.col(f"`{text}`")).otherwise(some).alias(out))
    new = {text: F.col(f"`{out}`"), n_chars: F.length(f"`{out}`")}
    return told.select(*(new[x].cast(docs.schema[x].dataType).alias(x) if x in new else F.col(f"`{x}`") for x in docs.columns))
