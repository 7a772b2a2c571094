"""Search in texts: literal and regular-expression matches with places, snippets, counts and navigation."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import PYTHON_SPACES, SPACES


#: Places in a batch that leaves Python, and characters of the texts that it holds, about.
MOST_PLACES, MOST_CHARACTERS = 1 << 16, 1 << 24
_WORD = re.compile("[0-9A-Za-z_]")


def _alone(body: str, a: int, b: int) -> bool:
    return not (a and _WORD.match(body[a - 1])) and not (b < len(body) and _WORD.match(body[b]))


def _scanned(df: DataFrame, text: str, places: Callable[[str], Iterable[tuple]], with_text: bool, **columns: str) -> DataFrame:
    """A row for each tuple that ``places`` gives for a text, with the other columns; one pass over each text in Arrow batches.

    Places leave Python as arrays, at most ``MOST_PLACES`` to a batch, and become rows in the JVM; a text is
    there once for each such array, and in the rows only if asked for.
    """
    kept = [c for c in df.columns if with_text or c != text]
    found = "_".join(["found", *kept])
    fields = ", ".join(f"{c}: {kind}" for c, kind in columns.items())
    schema = df.select(*(F.col(f"`{c}`") for c in kept), F.lit(None).cast(f"array<struct<{fields}>>").alias(found)).schema
    at, own = df.columns.index(text), [df.columns.index(c) for c in kept]
    kinds = [{"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[k] for k in columns.values()]
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sizes, values, held = [], [], [], 0

            def told(batch=batch) -> pa.RecordBatch:
                flat = zip(*values, strict=True) if values else ([] for _ in names)
                structs = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds, strict=True)], names)
                lists = pa.ListArray.from_arrays(pa.array([0, *itertools.accumulate(sizes)], pa.int32()), structs)
                taken = batch.select(own).take(pa.array(rows, pa.int64()))
                return pa.RecordBatch.from_arrays([*taken.columns, lists], names=[*kept, found])

            for i, body in enumerate(batch.column(at)):
                some = iter(places(whole)) if (whole := body.as_py()) else iter(())
                while part := list(itertools.islice(some, MOST_PLACES - len(values))):
                    rows.append(i)
                    sizes.append(len(part))
                    values += part
                    held += len(whole)
                    if len(values) >= MOST_PLACES or held >= MOST_CHARACTERS:
                        yield told()
                        rows, sizes, values, held = [], [], [], 0
            if rows:
                yield told()

    one = F.col(f"`{found}`")
    rows = df.mapInArrow(run, schema).select(*(F.col(f"`{c}`") for c in kept), F.explode(one).alias(found))
    return rows.select(*(F.col(f"`{c}`") for c in kept), *(one[c].alias(c) for c in names))


def _around(body: str, a: int, b: int, before: int, after: int) -> tuple[str, str, str, bool, bool]:
    """What stands before a match, the match, and what stands after it, in its line, and whether either is cut."""
    first = max(body.rfind("\n", max(0, a - before - 1), a) + 1, a - before, 0)
    cut = first > 0 and first == a - before and body[first - 1] != "\n"
    last = body.find("\n", b, b + after + 1)
    end = last if last >= 0 else min(len(body), b + after)
    return body[first:a], body[a:b], body[b:end], cut, last < 0 and end < len(body)


def _with_lines(places: Callable[[str], Iterator[tuple[int, int]]], lines: tuple[int, int] | None):
    """Places with what is around them, if ``lines`` are asked for; the columns' types."""
    plain = {"start": "int", "end": "int"}
    if lines is None:
        return places, plain
    more = {"before": "string", "match_text": "string", "after": "string", "cut_before": "boolean", "cut_after": "boolean"}
    return (lambda body: ((a, b, *_around(body, a, b, *lines)) for a, b in places(body))), plain | more


def find_literal(
    df: DataFrame, query: str, text: str = "text", case_sensitive: bool = False, whole_word: bool = False, with_text: bool = False, lines: tuple[int, int] | None = None
) -> DataFrame:
    """A row for each occurrence, with start and end (0-based code points, end beyond the last character).

    Occurrences are taken left to right and don't overlap; the search goes on at a match's end even if
    the whole-word test rejects it. An empty query and null texts find nothing; rows that are equal are
    searched each by itself. Without regard to case, both are lower-cased; where that changes a text's
    length, places are those of the characters that the match comes from. Rows have the text only
    ``with_text``; with ``lines``, they have what stands in the match's line before it, the match and
    what stands after it, at most so many characters on either side, and whether these are cut.
    """
    sought = query if case_sensitive else query.lower()

    def places(body: str) -> Iterator[tuple[int, int]]:
        if not sought:
            return
        flat = body if case_sensitive else body.lower()
        origin = None
        if len(flat) != len(body):
            origin = [i for i, c in enumerate(body) for _ in c.lower()] + [len(body)]
            origin = origin if len(origin) == len(flat) + 1 else None
        at = flat.find(sought)
        while at >= 0:
            end = at + len(sought)
            a, b = (at, end) if origin is None else (origin[at], origin[end - 1] + 1)
            if not whole_word or _alone(body, a, b):
                yield a, b
            at = flat.find(sought, end)

    found, columns = _with_lines(places, lines)
    return _scanned(df, text, found, with_text, **columns)


def find_regex(
    df: DataFrame, pattern: str, text: str = "text", case_sensitive: bool = False, whole_word: bool = False, with_text: bool = False, lines: tuple[int, int] | None = None
) -> DataFrame:
    """As ``find_literal`` for a pattern in which ^ and $ match at lines; empty hits don't count and an invalid pattern finds nothing.

    Places need a scan with state, so texts go through Arrow batches.
    """
    try:
        regex = re.compile(pattern, re.MULTILINE | (0 if case_sensitive else re.IGNORECASE))
    except re.error:
        regex = None

    def places(body: str) -> Iterator[tuple[int, int]]:
        for m in regex.finditer(body) if regex else ():
            if m.end() > m.start() and (not whole_word or _alone(body, *m.span())):
                yield m.span()

    found, columns = _with_lines(places, lines)
    return _scanned(df, text, found, with_text, **columns)


def count_regex(text: Column, pattern: str, case_sensitive: bool = False) -> Column:
    """How often a pattern occurs, without its places; one that the empty text matches is refused, as empty hits don't count."""
    if re.compile(pattern).match(""):
        raise ValueError("the pattern matches the empty text")
    return F.regexp_count(text, F.lit(("(?m)" if case_sensitive else "(?im)") + pattern))


def count_whole_words(text: Column, word: str) -> Column:
    """How often a word stands alone among ASCII word characters, without its places; texts without it aren't searched further."""
    flat, quoted = F.lower(text), re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", word.lower())
    n = F.regexp_count(flat, F.lit(f"(?<![0-9a-z_]){quoted}(?![0-9a-z_])"))
    return F.when(F.contains(flat, F.lit(word.lower())), n).when(text.isNotNull(), F.lit(0))


#: Characters that a snippet shows before and after a match.
SNIPPET = (36, 48)


def with_snippets(matches: DataFrame) -> DataFrame:
    """Matches found with ``lines``: adds prefix and suffix, what is around a match in its line, squashed, with ellipses where it is cut."""
    squash = lambda x: F.regexp_replace(x, f"[{SPACES}]+", " ")
    prefix = F.concat(F.when(F.col("cut_before"), F.lit("… ")).otherwise(F.lit("")), F.ltrim(squash(F.col("before"))))
    suffix = F.concat(F.rtrim(squash(F.col("after"))), F.when(F.col("cut_after"), F.lit(" …")).otherwise(F.lit("")))
    return matches.withColumns({"prefix": prefix, "suffix": suffix}).drop("before", "after", "cut_before", "cut_after")


def tokens(df: DataFrame, text: str = "text", with_text: bool = False) -> DataFrame:
    """A row for each run without white space, with token_index, token, start and end (0-based code points).

    Each text is scanned once where it lies: nothing is shuffled, and rows that are equal don't mix. Null
    and blank texts have none. Rows have the text only ``with_text``.
    """
    word = re.compile(f"[^{PYTHON_SPACES}]+")

    def places(body: str) -> Iterator[tuple[int, str, int, int]]:
        return ((i, m[0], m.start(), m.end()) for i, m in enumerate(word.finditer(body)))

    return _scanned(df, text, places, with_text, token_index="int", token="string", start="int", end="int")


def token_totals(text: Column) -> Column:
    """How many tokens a text has (n), how many characters they have (chars) and the longest has (longest); no Python, no shuffle."""
    words = F.transform(F.filter(F.split(text, f"[{SPACES}]+", -1), lambda x: x != ""), F.length)
    chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.struct(F.size(words).cast("long").alias("n"), chars.alias("chars"), F.array_max(words).cast("long").alias("longest"))


def next_match(current: Column, total: Column, step: int = 1) -> Column:
    """The match after (or before) the current one, round the end; null where there is none."""
    return F.when(total > 0, F.pmod(current + step, total))


def latest_search(requests: DataFrame, session: str, seq: str, query: str) -> DataFrame:
    """Of each session's searches the last one; earlier ones are superseded."""
    return requests.groupBy(session).agg(F.max_by(query, seq).alias(query), F.max(seq).alias(seq))
