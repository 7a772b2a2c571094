"""Text expressions. Lengths and offsets count code points."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the format's text rules count it, for use in a pattern's brackets: ASCII blanks, no-break and other spaces, line and paragraph separators, byte-order mark.
SPACES = "\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
#: The same for Python's patterns.
PYTHON_SPACES = "\t\n\x0b\x0c\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def normalized_spaces(x: Column) -> Column:
    """Runs of blanks, tabs, form feeds and vertical tabs become one space; ends are trimmed; line breaks stay."""
    return F.btrim(F.regexp_replace(x, "[ \\t\\f\\x0B]+", " "), F.lit(" "))


def label(x: Column, most: int = 60) -> Column:
    """White space squashed, and cut to ``most`` characters with an ellipsis."""
    flat = F.btrim(F.regexp_replace(x, f"[{SPACES}]+", " "), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def is_list_item(x: Column) -> Column:
    """Lines that start with a bullet, or with a short number or letter and a point or parenthesis."""
    return x.rlike(f"^[{SPACES}]*([•◦▪‣*–-]|\\(?([0-9]{{1,3}}|[A-Za-z])[.)])[{SPACES}]+")


def latin_only(x: Column) -> Column:
    """Characters beyond Latin-1 become spaces."""
    return F.regexp_replace(x, "[^\\x00-\\xFF]", " ")


def decoded(data: Column) -> Column:
    """Bytes as text: UTF-16BE or UTF-8 after a byte-order mark, else Latin-1."""
    rest = lambda n: F.substring(data, n, 1 << 30)
    return (
        F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", F.decode(rest(3), "UTF-16BE"))
        .when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", F.decode(rest(4), "UTF-8"))
        .otherwise(F.decode(data, "ISO-8859-1"))
    )


def encoded(x: Column) -> Column:
    """Text as bytes: Latin-1 where that holds it, else UTF-16BE after a byte-order mark."""
    return F.when(x.rlike("^[\\x00-\\xFF]*$"), F.encode(x, "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode(x, "UTF-16BE")))


def word_at(x: Column, place: Column) -> Column:
    """Whether the character at a 1-based place is one of 0-9, A-Z, a-z, _; false beyond the ends."""
    return F.when(place < 1, F.lit(False)).otherwise(F.coalesce(F.substring(x, place, F.lit(1)).rlike("[0-9A-Za-z_]"), F.lit(False)))


def pieces(x: Column, needle: str, case_sensitive: bool) -> Column:
    """What lies between the occurrences of ``needle``, left to right and without overlap."""
    body, sought = (x, needle) if case_sensitive else (F.lower(x), needle.lower())
    return F.split(body, re.sub(r"([^0-9A-Za-z_ ])", r"\\\1", sought), -1)


def joined_lines(lines: Column) -> Column:
    """One text of an array of lines: a hyphen at a line's end goes and the next follows at once, else a space is between."""
    join = lambda a, b: F.when(a == "", b).when(F.endswith(a, F.lit("-")), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat(a, F.lit(" "), b))
    return F.aggregate(lines, F.lit(""), join)


def dictionary_lines(x: Column) -> Column:
    """The entries of a recognizer's dictionary: lines without returns, the last empty one dropped, a space added."""
    lines = F.transform(F.split(x, "\n"), lambda line: F.regexp_replace(line, "\\r$", ""))
    whole = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    return F.concat(whole, F.array(F.lit(" ")))


def content_key(data: Column) -> Column:
    """A 32-bit FNV-1a key of binary data in lower-case hex: its length, then all bytes, or of long data about 4096 at equal steps."""
    n = F.octet_length(data)
    step = F.greatest(F.lit(1), F.when(n <= 4096, F.lit(1)).otherwise((n / 4096).cast("int")))
    head = F.transform(F.array(*(F.lit(8 * i) for i in range(4))), lambda s: F.call_function("shiftright", n, s).bitwiseAND(F.lit(255)).cast("long"))
    places = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), step))
    bytes_ = F.transform(places, lambda i: F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("long"))
    # fixed values of FNV-1a, 32 bits
    seed, prime = 0x811C9DC5, 0x01000193
    mixed = F.aggregate(F.concat(head, bytes_), F.lit(seed).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(prime)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lower(F.hex(mixed))
