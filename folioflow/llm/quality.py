"""Quality rules: base rules and minimum-covariance-determinant outliers, in built-in functions only.

Each document becomes a vector of transformed statistics. Per language and source, the centre and
covariance of the three quarters of the vectors that lie closest together (the minimum covariance
determinant) are found by concentration steps from two deterministic starts. Documents whose
Mahalanobis distance from their group's centre passes the cut-off are rejected.

Vectors are held as whole numbers of 1/256, so all sums are exact and reruns agree bit for bit.
Distances are sorted into bins of an eighth of an octave; a concentration step keeps the fewest
lowest bins with at least the wanted number of vectors. A step is one pass that adds up counts and
moments by group and bin, so no group's rows ever meet in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.llm.common import free_name, free_prefix, word_array, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "[#*$%&|<>]"
#: Vectors are whole numbers of 1/UNIT and lie within MOST in size.
UNIT, MOST = 256, 1 << 13
DIMS = 5
#: Bins of squared distance per octave.
FINE = 8
#: Estimates (about 200 bytes each) go to all executors if there are at most so many.
MOST_GROUPS = 100_000


@dataclass(frozen=True)
class QualityRules:
    """The rules' parameters.

    ``share``: part of a group that the concentrated subset holds. ``tail``: probability under a
    normal distribution of a distance beyond the cut-off, small because clean documents must stay.
    ``floors``: standard deviations added to those found, in the units of the vector, because most
    documents have no symbol and no repeated line at all; small enough that among such documents one
    with 5 repeated lines per 100 words, or with 19% of repeated words, passes the cut-off. ``least``: smaller groups use their
    language's estimate, then that of all documents, and are kept if that is too small as well.
    """

    min_words: int = 10
    most_repeats: float = 0.2
    share: float = 0.75
    tail: float = 1e-7
    floors: tuple[float, ...] = (0.1, 0.03, 0.25, 0.25, 0.45)
    least: int = 60
    steps: int = 5


def with_statistics(docs: DataFrame, text: str, names: dict[str, str], rules: QualityRules) -> DataFrame:
    """Add the base statistics under ``names`` (from those in BASE and base_failed), one row in, one row out."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    words, lines, grams, keys, places, body = (free_name(docs, f"quality_{x}") for x in ("words", "lines", "grams", "keys", "places", "text"))
    n = {k: F.col(f"`{v}`") for k, v in names.items()}
    staged = docs.select(*own, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(body))
    staged = staged.select("*", word_array(F.col(body)).alias(words), F.filter(F.split(body, "\n"), lambda x: x.rlike("[^ \\t-\\r]")).alias(lines))
    w = F.col(words)
    staged = staged.select(
        *own,
        words,
        F.size(w).cast("long").alias(names["n_words"]),
        F.length(F.array_join(w, "")).cast("long").alias(names["word_chars"]),
        (F.length(body) - F.length(F.regexp_replace(body, F.lit(SYMBOLS), F.lit("")))).cast("long").alias(names["n_symbols"]),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias(names["n_dup_lines"]),
        F.when(F.size(w) < 5, F.array().cast("array<bigint>"))
        .otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))))
        .alias(grams),
    )
    # only texts whose windows' hashes repeat are sorted, by the windows themselves
    some = F.size(F.array_distinct(grams)) < F.size(grams)
    listed = F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 5, F.lit(0))), lambda i: F.struct(F.concat_ws(" ", F.slice(w, i + 1, 5)).alias("w"), i.alias("p"))))
    staged = staged.select(*(c for c in staged.columns if c not in (grams,)), F.when(some, listed).alias(keys))
    k = F.col(keys)
    twice = F.filter(k, lambda x, i: x["w"].eqNullSafe(F.get(k, i - 1)["w"]) | x["w"].eqNullSafe(F.get(k, i + 1)["w"]))
    staged = staged.select(*(c for c in staged.columns if c not in (keys, words)), F.sort_array(F.transform(twice, lambda x: x["p"])).alias(places))
    p = F.col(places)
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    staged = staged.select(*(c for c in staged.columns if c != places), F.coalesce(covered, F.lit(0)).cast("long").alias(names["n_repeat_words"]))
    failed = (n["n_words"] < rules.min_words) | (100 * n["n_repeat_words"] > int(100 * rules.most_repeats) * n["n_words"])
    # as a generated row, because a filter on the result would otherwise be moved below and repeat all of the above
    return staged.select(*own, F.inline(F.array(F.struct(*(n[k] for k in BASE), failed.alias(names["base_failed"])))))


def vector(n: dict[str, Column]) -> list[Column]:
    """The transformed statistics in whole numbers of 1/UNIT."""
    size = F.greatest(n["n_words"], F.lit(1)).cast("double")
    parts = [
        F.log(size),
        F.log((n["word_chars"] + 250.0) / (size + 50.0)),  # with 50 words of 5 characters, so that short texts vary little
        F.log1p(100.0 * n["n_symbols"] / size),
        F.log1p(100.0 * n["n_dup_lines"] / size),
        F.log1p(100.0 * n["n_repeat_words"] / size),
    ]
    return [F.least(F.greatest(F.round(x * UNIT).cast("long"), F.lit(-MOST)), F.lit(MOST)) for x in parts]


def group_keys(lang: str, source: str) -> list[Column]:
    """Keys of the levels: language and source, language, all; null is a value of its own."""
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(f"`{c}`").cast("string")), F.lit("n"))
    return [F.concat(F.lit("2"), part(lang), F.lit("\x00"), part(source)), F.concat(F.lit("1"), part(lang)), F.lit("0")]


def chi2_cdf(x: float, dims: int) -> float:
    """The chi-squared distribution function, by the series of the incomplete gamma function."""
    a, z = dims / 2, x / 2
    term = total = 1 / a
    k = 0
    while term > 1e-16 * total:
        k += 1
        term *= z / (a + k)
        total += term
    return min(1.0, total * math.exp(-z + a * math.log(z) - math.lgamma(a)))


def chi2_quantile(p: float, dims: int) -> float:
    low, high = 1e-9, 50.0 * (dims + 10)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dims) < p else (low, mid)
    return (low + high) / 2


def cutoff(rules: QualityRules) -> float:
    """The squared distance beyond which a vector is an outlier; Wilson and Hilferty's form holds far into the tail."""
    z = -NormalDist().inv_cdf(rules.tail)
    return DIMS * (1 - 2 / (9 * DIMS) + z * math.sqrt(2 / (9 * DIMS))) ** 3


def pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(DIMS)]
    return [*(F.sum(x[i]).alias(f"m{i}") for i in range(DIMS)), *(F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs())]


def shaped(sums: DataFrame, scale: float, rules: QualityRules) -> DataFrame:
    """From a group's count and moments: centre c, the inverse w of the covariance's Cholesky factor, and the log determinant."""
    keep = ["group", "start", "members"]
    n = F.col("k").cast("double")
    rows = sums.select(*keep, "k", *(F.col(f"q{i}_{j}") for i, j in pairs()), *((F.col(f"m{i}") / n).alias(f"c{i}") for i in range(DIMS)))
    cov = lambda i, j: (F.col(f"q{i}_{j}") / n - F.col(f"c{i}") * F.col(f"c{j}")) * scale + ((rules.floors[i] * UNIT) ** 2 if i == j else 0.0)
    rows = rows.select(*keep, *(f"c{i}" for i in range(DIMS)), *(cov(i, j).alias(f"s{i}_{j}") for i, j in pairs()))
    return factored(rows)


def factored(rows: DataFrame) -> DataFrame:
    """Cholesky's factor of s and its inverse, element by element."""
    for i, j in pairs():
        rest = sum((F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}") for k in range(j)), F.lit(0.0))
        value = F.sqrt(F.greatest(F.col(f"s{i}_{j}") - rest, F.lit(1e-9))) if i == j else (F.col(f"s{i}_{j}") - rest) / F.col(f"l{j}_{j}")
        rows = rows.select("*", value.alias(f"l{i}_{j}"))
    for i in range(DIMS):
        for j in range(i, -1, -1):
            value = 1.0 / F.col(f"l{i}_{i}") if i == j else -sum((F.col(f"l{i}_{k}") * F.col(f"w{k}_{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}_{i}")
            rows = rows.select("*", value.alias(f"w{i}_{j}"))
    rows = rows.select("*", sum((F.log(F.col(f"l{i}_{i}")) for i in range(DIMS)), F.lit(0.0)).alias("det"))
    return rows.select(*(c for c in rows.columns if not (c[0] in "sl" and "_" in c)))


def distance(x: list[Column]) -> Column:
    """The squared distance in terms of the columns c and w."""
    gap = [x[i].cast("double") - F.col(f"c{i}") for i in range(DIMS)]
    parts = [sum((F.col(f"w{i}_{j}") * gap[j] for j in range(i + 1)), F.lit(0.0)) for i in range(DIMS)]
    return sum((p * p for p in parts), F.lit(0.0))


def estimates(vectors: DataFrame, rules: QualityRules) -> DataFrame:
    """Per group of ``vectors`` (group, x0 to x4): members, centre c and factor w of its minimum covariance determinant."""
    whole = vectors.groupBy("group").agg(F.count(F.lit(1)).alias("k"), *moments()).withColumn("members", F.col("k"))
    classical = shaped(whole.withColumn("start", F.lit(0)), 1.0, rules)
    parts = vectors.select("group", F.posexplode(F.array(*(f"x{i}" for i in range(DIMS)))).alias("dim", "x"))
    spread = parts.groupBy("group", "dim", "x").agg(F.count(F.lit(1)).alias("times"))
    spread = spread.groupBy("group", "dim").agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("times")).alias("at"), F.sum("times").alias("members"))
    pick = lambda i, k: F.max(F.when(F.col("dim") == i, F.col("at")[k]))
    sides = spread.groupBy("group").agg(
        F.max("members").alias("members"),
        *(pick(i, 1).alias(f"c{i}") for i in range(DIMS)),
        *(((pick(i, 2) - pick(i, 0)) / 1.349).alias(f"d{i}") for i in range(DIMS)),
    )
    medians = factored(
        sides.select(
            "group", "members", F.lit(1).alias("start"), *(f"c{i}" for i in range(DIMS)),
            *((F.col(f"d{i}") * F.col(f"d{i}") + (rules.floors[i] * UNIT) ** 2 if i == j else F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs()),
        )
    )
    now = written(classical.unionByName(medians), "quality-start")
    quantile = chi2_quantile(rules.share, DIMS)
    scale = rules.share / chi2_cdf(quantile, DIMS + 2)  # makes the subset's covariance that of a normal distribution
    up_to = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for step in range(rules.steps):
        # sent to all executors behind a check: a join by group would deal out a whole group to one task
        held = now.drop("det")
        near = vectors.join(F.broadcast(held) if now.count() <= MOST_GROUPS else held, "group")
        squared = distance([F.col(f"x{i}") for i in range(DIMS)])
        binned = near.select("group", "start", "members", *(f"x{i}" for i in range(DIMS)), F.floor(FINE * F.log2(squared + 1e-3)).cast("int").alias("bin"))
        sums = binned.groupBy("group", "start", "members", "bin").agg(F.count(F.lit(1)).alias("k"), *moments())
        lowest = sums.withColumn("below", F.coalesce(F.sum("k").over(up_to), F.lit(0)))
        lowest = lowest.filter(F.col("below") < F.ceil(F.col("members") * rules.share))
        totals = lowest.groupBy("group", "start", "members").agg(*(F.sum(c).alias(c) for c in sums.columns if c[0] in "kmq" and c != "members"))
        now = written(shaped(totals, scale, rules), f"quality-step{step}")
    best = Window.partitionBy("group").orderBy("det", "start")
    return now.withColumn("rank", F.row_number().over(best)).filter("rank = 1").drop("rank", "start", "det")


def fit(statistics: DataFrame, lang: str, source: str, names: dict[str, str], rules: QualityRules) -> DataFrame:
    """Estimates by the finest key, each from the finest level that has enough documents that pass the base rules."""
    keys = group_keys(lang, source)
    n = {k: F.col(f"`{v}`") for k, v in names.items()}
    passed = statistics.filter(~n["base_failed"]).select(
        *(k.alias(f"g{i}") for i, k in enumerate(keys)), *(x.alias(f"x{i}") for i, x in enumerate(vector(n)))
    )
    levels = passed.select(F.explode(F.array("g0", "g1", "g2")).alias("group"), *(f"x{i}" for i in range(DIMS)))
    vectors = written(levels, "quality-vectors")
    found = written(estimates(vectors, rules).filter(F.col("members") >= rules.least), "quality-estimates")
    groups = statistics.select(keys[0].alias("g0"), keys[1].alias("g1"), keys[2].alias("g2")).distinct()
    choice = groups.select("g0", F.posexplode(F.array("g0", "g1", "g2")).alias("level", "group")).join(found, "group")
    first = Window.partitionBy("g0").orderBy("level")
    chosen = choice.withColumn("rank", F.row_number().over(first)).filter("rank = 1")
    return written(chosen.select("g0", *(f"c{i}" for i in range(DIMS)), *(f"w{i}_{j}" for i, j in pairs())), "quality-chosen")


def verdict(statistics: DataFrame, fitted: DataFrame, lang: str, source: str, names: dict[str, str], rules: QualityRules, kept: str) -> DataFrame:
    """Add the column ``kept``; a document of a group without an estimate is kept if it passes the base rules."""
    own = [F.col(f"d.`{c}`") for c in statistics.columns]
    n = {k: F.col(f"d.`{v}`") for k, v in names.items()}
    sent = F.broadcast(fitted) if fitted.count() <= MOST_GROUPS else fitted  # else a group's rows would meet in one task
    joined = statistics.alias("d").join(sent.alias("e"), group_keys(f"{lang}", f"{source}")[0] == F.col("e.g0"), "left")
    far = distance(vector(n)) > cutoff(rules)
    return joined.select(*own, (~n["base_failed"] & ~F.coalesce(far, F.lit(False))).alias(kept))


def quality_report(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", columns: tuple[str, ...] = ("doc_id",), rules: QualityRules = QualityRules()) -> DataFrame:
    """The base statistics, ``base_failed`` and ``kept`` of every row, with the named columns before them.

    Null and blank texts have no words and fail; languages and sources that are null form groups of
    their own; repeated rows count and are judged each; an empty table gives an empty result. Columns
    of the input that are not named don't matter, whatever their names.
    """
    keep = [c for c in columns if c not in (lang, source)]
    names = {k: k for k in (*BASE, "base_failed")}
    narrow = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{lang}`").alias("quality_lang"), F.col(f"`{source}`").alias("quality_source"), F.col(f"`{text}`").alias("quality_body"))
    measured = with_statistics(narrow, "quality_body", names, rules).drop("quality_body")
    statistics = written(measured, "quality-statistics")
    fitted = fit(statistics, "quality_lang", "quality_source", names, rules)
    return verdict(statistics, fitted, "quality_lang", "quality_source", names, rules, "kept").drop("quality_lang", "quality_source")


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that the rules keep, with their columns unchanged.

    Rows are written once with their statistics, so that texts are measured once and never move between
    executors. Nulls, blanks, repeated rows and empty tables are as in ``quality_report``.
    """
    prefix = free_prefix(docs, "quality")
    names = {k: f"{prefix}_{k}" for k in (*BASE, "base_failed")}
    told = written(with_statistics(docs, text, names, rules), "quality-rows")
    fitted = fit(told, lang, source, names, rules)
    judged = verdict(told, fitted, lang, source, names, rules, f"{prefix}_kept")
    return judged.filter(F.col(f"`{prefix}_kept`")).select(*(F.col(f"`{c}`") for c in docs.columns))
