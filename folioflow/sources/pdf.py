"""A lenient reader of PDF files: objects, pages, operations of content, and text runs, as DataFrames.

Files are read with Spark's binaryFile source and parsed one at a time in Arrow batches. What can't be
read is null or missing rather than an error; a file that can't be opened has its reason in
``_corrupt``. Encrypted files are only told as such.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from folioflow.sources.codecs import FilterError, decode_chain

_WHITE, _DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_HEADER = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
MOST_HOPS, MOST_NESTING = 1000, 200


class Name(str):
    """A name, without its slash."""


class Word(str):
    """An operator or keyword."""


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    about: dict
    raw: bytes


class Unreadable(ValueError):
    """A file that can't be opened."""


_END = object()


class Reader:
    """Tokens and objects from a place in some bytes."""

    def __init__(self, data: bytes, at: int = 0, references: bool = True):
        self.data, self.at, self.references, self.depth = data, at, references, 0

    def skip(self) -> None:
        data = self.data
        while self.at < len(data):
            c = data[self.at]
            if c in _WHITE:
                self.at += 1
            elif c == 0x25:
                while self.at < len(data) and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def object(self):
        """The next object or word; _END at the end."""
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            return _END
        c = data[at : at + 1]
        if c == b"/":
            found = _TOKEN.match(data, at + 1)
            self.at = found.end() if found else at + 1
            raw = found.group() if found else b""
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self.string()
        if data[at : at + 2] == b"<<":
            self.at += 2
            return self.dictionary()
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self.array()
        if c in (b"]", b"{", b"}", b")"):
            self.at += 1
            return Word(c.decode())
        if data[at : at + 2] == b">>":
            self.at += 2
            return Word(">>")
        if c == b">":
            self.at += 1
            return self.object()
        token = _TOKEN.match(data, at)
        self.at = token.end()
        return self.number_or_word(token.group())

    def number_or_word(self, token: bytes):
        if re.fullmatch(rb"[+-]?\d{1,18}", token):
            value = int(token)
            if self.references and value >= 0:
                found = re.compile(rb"[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![^\x00\t\n\x0c\r ()<>\[\]{}/%])").match(self.data, self.at)
                if found:
                    self.at = found.end()
                    return Ref(value, int(found[1]))
            return value
        if re.fullmatch(rb"[+-]*(\d+\.?\d*|\.\d+)(-\d*)?", token):
            body = re.match(rb"([+-]*)(\d*\.?\d*)", token)
            return float(body[2] or 0) * (-1 if b"-" in body[1] else 1)
        return {b"true": True, b"false": False, b"null": None}.get(token, Word(token.decode("latin-1")))

    def string(self) -> bytes:
        data, out, depth = self.data, bytearray(), 1
        i = self.at + 1
        while i < len(data):
            c = data[i]
            if c == 0x5C:
                i += 1
                e = data[i : i + 1]
                if e in b"nrtbf" and e:
                    out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}[e]
                elif e.isdigit() and e < b"8":
                    found = re.compile(rb"[0-7]{1,3}").match(data, i)
                    out.append(int(found.group(), 8) & 255)
                    i = found.end() - 1
                elif e == b"\r":
                    i += data[i + 1 : i + 2] == b"\n"
                elif e != b"\n":
                    out += e
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    break
                out.append(c)
            else:
                out.append(c)
            i += 1
        self.at = i + 1
        return bytes(out)

    def array(self) -> list:
        out: list = []
        self.depth += 1
        while self.depth < MOST_NESTING:
            value = self.object()
            if value is _END or (isinstance(value, Word) and value == "]"):
                break
            if isinstance(value, Word):
                if value in ("endobj", "endstream", ">>"):
                    break
                continue  # stray words in arrays are dropped
            out.append(value)
        self.depth -= 1
        return out

    def dictionary(self) -> dict:
        out: dict = {}
        self.depth += 1
        while self.depth < MOST_NESTING:
            key = self.object()
            if key is _END or (isinstance(key, Word) and key in (">>", "endobj", "stream")):
                break
            if not isinstance(key, Name):
                continue
            before = self.at
            value = self.object()
            if isinstance(value, Word):
                if value in (">>", "endobj"):
                    break
                self.at = before if value == "stream" else self.at
                continue
            out[str(key)] = value
        self.depth -= 1
        return out


@dataclass
class Document:
    """A file's objects by number, loaded when asked for."""

    data: bytes
    entries: dict[int, tuple] = field(default_factory=dict)
    trailer: dict = field(default_factory=dict)
    held: dict = field(default_factory=dict)
    recovered: bool = False
    parsed: dict = field(default_factory=dict)
    placed: dict[int, int] = field(default_factory=dict)

    @classmethod
    def open(cls, data: bytes) -> Document:
        """By the cross-reference sections, newest first; where these don't lead to a catalog, by a scan for objects."""
        doc = cls(data)
        try:
            doc.sections()
            if isinstance(doc.get(doc.trailer.get("Root")), dict) and doc.pages():
                return doc
        except (ValueError, TypeError, IndexError, KeyError, struct.error, RecursionError):
            pass
        doc = cls(data, recovered=True)
        doc.recover()
        if not isinstance(doc.get(doc.trailer.get("Root")), dict):
            raise Unreadable("no catalog")
        return doc

    def sections(self) -> None:
        found = re.findall(rb"startxref\s+(\d+)", self.data[-2048:])
        if not found:
            raise ValueError("no startxref")
        shift = max(0, self.data[:1024].find(b"%PDF-"))
        queue, seen = [int(found[-1])], set()
        while queue:
            at = queue.pop(0)
            if at in seen or not 0 <= at + shift < len(self.data):
                continue
            seen.add(at)
            trailer = self.section(at + shift, shift)
            for key, value in trailer.items():
                self.trailer.setdefault(key, value)
            queue = [v for v in (trailer.get("XRefStm"), trailer.get("Prev")) if isinstance(v, int)] + queue

    def section(self, at: int, shift: int) -> dict:
        reader = Reader(self.data, at)
        first = reader.object()
        if first == "xref":
            while True:
                start = reader.object()
                if not isinstance(start, int):
                    break
                count = reader.object()
                for i in range(count):
                    offset, generation, kind = reader.object(), reader.object(), reader.object()
                    if kind == "n":
                        self.entries.setdefault(start + i, ("at", offset + shift, generation))
                    else:
                        self.entries.setdefault(start + i, ("free",))
            found = reader.object() if start == "trailer" else {}
            return found if isinstance(found, dict) else {}
        stream = self.object_at(at)[1]
        if not isinstance(stream, Stream):
            raise ValueError("no cross-reference section")
        widths = stream.about["W"]
        table, step = self.decoded(stream), sum(widths)
        index = stream.about.get("Index") or [0, stream.about["Size"]]
        place = 0
        for start, count in zip(index[::2], index[1::2], strict=False):
            for number in range(start, start + count):
                row, fields, at_field = table[place : place + step], [], 0
                place += step
                if len(row) < step:
                    break
                for w in widths:
                    fields.append(int.from_bytes(row[at_field : at_field + w], "big") if w else None)
                    at_field += w
                kind = 1 if fields[0] is None else fields[0]
                entry = ("at", (fields[1] or 0) + shift, fields[2] or 0) if kind == 1 else ("in", fields[1] or 0, fields[2] or 0) if kind == 2 else ("free",)
                self.entries.setdefault(number, entry)
        return stream.about

    def recover(self) -> None:
        """Objects by their headers, the last of each number; trailers and object streams are merged in."""
        for m in _HEADER.finditer(self.data):
            self.entries[int(m[1])] = ("at", m.start(), int(m[2]))
        for m in re.finditer(rb"trailer", self.data):
            found = Reader(self.data, m.end()).object()
            if isinstance(found, dict):
                self.trailer |= found
        for number in list(self.entries):
            value = self.load(number)
            if isinstance(value, Stream) and value.about.get("Type") == "ObjStm":
                for inner in self.members(value):
                    self.entries.setdefault(inner[0], ("in", number, inner[2]))
            if isinstance(value, Stream) and value.about.get("Type") == "XRef":
                self.trailer = value.about | self.trailer
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            for number in self.entries:
                value = self.load(number)
                if isinstance(value, dict) and value.get("Type") == "Catalog":
                    self.trailer["Root"] = Ref(number, 0)

    def object_at(self, at: int) -> tuple[int, object]:
        reader = Reader(self.data, at)
        found = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj\b").match(self.data, at)
        if not found:
            raise ValueError(f"no object at {at}")
        reader.at = found.end()
        value = reader.object()
        if isinstance(value, dict):
            reader.skip()
            if self.data[reader.at : reader.at + 6] == b"stream":
                start = reader.at + 6
                start += 2 if self.data[start : start + 2] == b"\r\n" else 1 if self.data[start : start + 1] in (b"\n", b"\r") else 0
                length = self.get(value.get("Length"))
                end = start + length if isinstance(length, int) else -1
                if end < start or not re.match(rb"\s*endstream", self.data[end : end + 20]):
                    end = self.data.find(b"endstream", start)
                    end = len(self.data) if end < 0 else end
                    end -= self.data[end - 2 : end] == b"\r\n" and 2 or self.data[end - 1 : end] in (b"\n", b"\r")
                value = Stream(value, self.data[start:end])
        return int(found[1]), None if value is _END or isinstance(value, Word) else value

    def members(self, stream: Stream) -> list[tuple[int, object, int]]:
        """The objects of an object stream, parsed once."""
        if id(stream) in self.parsed:
            return self.parsed[id(stream)][1]
        body = self.decoded(stream)
        heads, out = Reader(body), []
        first = self.get(stream.about.get("First")) or 0
        for i in range(self.get(stream.about.get("N")) or 0):
            number, offset = heads.object(), heads.object()
            if not isinstance(number, int) or not isinstance(offset, int):
                break
            value = Reader(body, first + offset).object()
            out.append((number, None if value is _END or isinstance(value, Word) else value, i))
        self.parsed[id(stream)] = (stream, out)
        return out

    def headers(self) -> dict[int, int]:
        """Where the last object of each number begins, found once."""
        if not self.placed:
            self.placed = {int(m[1]): m.start() for m in _HEADER.finditer(self.data)}
        return self.placed

    def load(self, number: int):
        if number in self.held:
            return self.held[number]
        self.held[number] = None  # a loop ends here
        entry = self.entries.get(number, ("free",))
        value = None
        try:
            if entry[0] == "at":
                own, value = self.object_at(entry[1])
                if own != number:
                    value = self.object_at(self.headers()[number])[1] if number in self.headers() else None
            elif entry[0] == "in":
                held = self.load(entry[1])
                if isinstance(held, Stream):
                    for inner, found, _ in self.members(held):
                        if inner == number:
                            value = found
        except (ValueError, FilterError, RecursionError):
            value = None
        self.held[number] = value
        return value

    def get(self, value):
        """What a reference leads to."""
        for _ in range(MOST_HOPS):
            if not isinstance(value, Ref):
                return value
            value = self.load(value.number)
        return None

    def decoded(self, stream: Stream, stop_before: str | None = None) -> bytes:
        listed = lambda v: v if isinstance(v, list) else [] if v is None else [v]
        names = [self.get(x) for x in listed(self.get(stream.about.get("Filter", stream.about.get("F"))))]
        params = [self.get(x) for x in listed(self.get(stream.about.get("DecodeParms", stream.about.get("DP"))))]
        return decode_chain(stream.raw, [str(n) for n in names], [{k: self.get(v) for k, v in p.items()} if isinstance(p, dict) else {} for p in params], stop_before)

    def pages(self) -> list[dict]:
        """The leaves in order, with Resources, MediaBox, CropBox and Rotate from above where they have none; counts aren't trusted."""
        out, seen = [], set()
        keys = ("Resources", "MediaBox", "CropBox", "Rotate")

        def walk(ref, above: dict, depth: int) -> None:
            mark = ref.number if isinstance(ref, Ref) else id(ref)
            node = self.get(ref)
            if mark in seen or not isinstance(node, dict) or depth > 100:
                return
            seen.add(mark)
            own = {k: node.get(k, above.get(k)) for k in keys}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(node | {k: v for k, v in own.items() if v is not None})

        root = self.get(self.trailer.get("Root"))
        walk(root.get("Pages") if isinstance(root, dict) else None, {}, 0)
        return out

    def content(self, page: dict) -> bytes:
        """All parts of a page's content, a line break between; parts that can't be decoded are left out."""
        parts = self.get(page.get("Contents"))
        out = []
        for part in parts if isinstance(parts, list) else [parts]:
            stream = self.get(part)
            if isinstance(stream, Stream):
                try:
                    out.append(self.decoded(stream))
                except (FilterError, ValueError, IndexError):
                    continue
        return b"\n".join(out)

    def info(self) -> dict[str, str]:
        found = self.get(self.trailer.get("Info"))
        values = {k: self.get(v) for k, v in found.items()} if isinstance(found, dict) else {}
        return {k: text_of(v) if isinstance(v, bytes) else str(v) for k, v in values.items() if isinstance(v, bytes | Name)}


    def action(self, raw) -> tuple[str | None, str | None]:
        """Kind and target of an action: an address, a destination's name or page number, a named action, or a script."""
        about = self.get(raw)
        if not isinstance(about, dict):
            return None, None
        kind = str(self.get(about.get("S")) or "")
        if kind == "GoTo":
            return kind, self.destination(about.get("D"))
        value = self.get(about.get({"URI": "URI", "Named": "N", "JavaScript": "JS"}.get(kind, "")))
        if isinstance(value, Stream):
            return kind, self.decoded(value).decode("utf-8", "replace")
        return kind, text_of(value) if isinstance(value, bytes) else str(value) if isinstance(value, Name) else None

    def destination(self, raw) -> str | None:
        """The 0-based page that a destination leads to, as text; names are looked up in the catalog's trees."""
        value = self.get(raw)
        for _ in range(8):
            if isinstance(value, bytes | Name):
                value = self.named(value if isinstance(value, bytes) else value.encode("latin-1"))
            if isinstance(value, dict):
                value = self.get(value.get("D"))
            if isinstance(value, list):
                target = value[0] if value else None
                if isinstance(target, Ref):
                    return next((str(i) for i, r in enumerate(self.page_refs()) if r == target), None)
                return str(target) if isinstance(target, int) else None
            if value is None:
                return None
        return None

    def named(self, name: bytes):
        """A named destination: in the name tree, then among the older ones of the catalog."""
        root = self.get(self.trailer.get("Root"))
        names = self.get(root.get("Names")) if isinstance(root, dict) else None
        queue, seen = [names.get("Dests")] if isinstance(names, dict) else [], set()
        while queue:
            ref = queue.pop()
            node = self.get(ref)
            mark = ref.number if isinstance(ref, Ref) else id(node)
            if mark in seen or not isinstance(node, dict):
                continue
            seen.add(mark)
            limits = self.get(node.get("Limits"))
            if isinstance(limits, list) and len(limits) == 2 and all(isinstance(x, bytes) for x in map(self.get, limits)) and not self.get(limits[0]) <= name <= self.get(limits[1]):
                continue
            pairs = self.get(node.get("Names"))
            for k, v in zip(pairs[::2], pairs[1::2], strict=False) if isinstance(pairs, list) else ():
                if self.get(k) == name:
                    return self.get(v)
            kids = self.get(node.get("Kids"))
            queue += kids if isinstance(kids, list) else []
        old = self.get(root.get("Dests")) if isinstance(root, dict) else None
        return self.get(old.get(name.decode("latin-1"))) if isinstance(old, dict) else None

    def page_refs(self) -> list[Ref]:
        """The references of the page tree's leaves, in order."""
        out, seen = [], set()

        def walk(ref) -> None:
            node = self.get(ref)
            if not isinstance(ref, Ref) or ref.number in seen or not isinstance(node, dict):
                return
            seen.add(ref.number)
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid)
            else:
                out.append(ref)

        root = self.get(self.trailer.get("Root"))
        walk(root.get("Pages") if isinstance(root, dict) else None)
        return out

    def annotations(self, page: dict) -> list[dict]:
        """A page's annotations in order: subtype, rect, flags, texts, and coordinates of lines, vertices, quads and ink."""
        listed = self.get(page.get("Annots"))
        numbers = lambda v: [float(x) for x in map(self.get, v) if isinstance(x, int | float)] if isinstance(v, list) else None
        text = lambda v: text_of(v) if isinstance(v, bytes) else None
        out = []
        for slot, item in enumerate(listed if isinstance(listed, list) else []):
            about = self.get(item)
            if not isinstance(about, dict):
                continue
            got = lambda k, about=about: self.get(about.get(k))
            rect = numbers(got("Rect")) or []
            kind, target = self.action(about.get("A")) if "A" in about else ("GoTo", self.destination(about.get("Dest"))) if "Dest" in about else (None, None)
            ink = got("InkList")
            out.append(
                {
                    "slot": slot, "subtype": str(got("Subtype") or ""), "flags": got("F") if isinstance(got("F"), int) else 0,
                    "rect": dict(zip(("left", "bottom", "right", "top"), (min(rect[0], rect[2]), min(rect[1], rect[3]), max(rect[0], rect[2]), max(rect[1], rect[3])) if len(rect) == 4 else (0.0,) * 4, strict=True)),
                    "contents": text(got("Contents")), "author": text(got("T")), "name": text(got("NM")), "action": kind, "target": target,
                    "coordinates": numbers(got("L")) or numbers(got("Vertices")) or numbers(got("QuadPoints")), "ink": [numbers(self.get(s)) or [] for s in ink] if isinstance(ink, list) else None,
                }
            )
        return out

    def fields(self) -> list[dict]:
        """The form's terminal fields, depth first: dotted name, kind, flags, value, states and options; inherited where a field has none of its own."""
        root = self.get(self.trailer.get("Root"))
        form = self.get(root.get("AcroForm")) if isinstance(root, dict) else None
        out, seen = [], set()
        text = lambda v: text_of(v) if isinstance(v, bytes) else str(v) if isinstance(v, Name) else None

        def walk(ref, prefix: str, above: dict) -> None:
            node = self.get(ref)
            mark = ref.number if isinstance(ref, Ref) else id(node)
            if not isinstance(node, dict) or mark in seen:
                return
            seen.add(mark)
            own = self.get(node.get("T"))
            name = prefix if not isinstance(own, bytes) else f"{prefix}.{text_of(own)}" if prefix else text_of(own)
            held = above | {k: self.get(node[k]) for k in ("FT", "Ff", "V", "Opt") if k in node}
            kids = self.get(node.get("Kids"))
            below = [k for k in kids if isinstance(d := self.get(k), dict) and isinstance(self.get(d.get("T")), bytes)] if isinstance(kids, list) else []
            for kid in below:
                walk(kid, name, held)
            if below:
                return
            value = held.get("V")
            first = self.get(value[0]) if isinstance(value, list) and value else value
            options = [[text(self.get(x)) for x in o] if isinstance(o := self.get(raw), list) else [text(o)] * 2 for raw in held.get("Opt") or []] if isinstance(held.get("Opt"), list) else []
            out.append(
                {
                    "name": name, "kind": str(held.get("FT") or ""), "flags": held.get("Ff") if isinstance(held.get("Ff"), int) else 0, "value": text(first),
                    "checked": isinstance(value, Name) and value != "Off", "widgets": len(kids) if isinstance(kids, list) else 1,
                    "options": [{"export": o[0], "display": o[1]} for o in options if len(o) == 2],
                }
            )

        listed = self.get(form.get("Fields")) if isinstance(form, dict) else None
        for ref in listed if isinstance(listed, list) else []:
            walk(ref, "", {})
        return out


def text_of(data: bytes) -> str:
    if data[:2] == b"\xfe\xff":
        return data[2:].decode("utf-16-be", "replace")
    return data[3:].decode("utf-8", "replace") if data[:3] == b"\xef\xbb\xbf" else data.decode("latin-1")


def operations(content: bytes) -> list[tuple[str, list]]:
    """Operators with what stands before them; an inline picture is one operation, BI."""
    reader, operands, out = Reader(content, references=False), [], []
    while (value := reader.object()) is not _END:
        if not isinstance(value, Word):
            operands.append(value)
        elif value == "BI":
            about: dict = {}
            while isinstance(key := reader.object(), Name):
                about[str(key)] = reader.object()
            end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)").search(content, reader.at)
            raw = content[reader.at + 1 : end.start() if end else len(content)]
            reader.at = end.end() if end else len(content)
            out.append(("BI", [about, raw]))
            operands = []
        elif value not in ("]", ">>", "{", "}", ")"):
            out.append((str(value), operands))
            operands = []
    return out


class Font:
    """Codes of a font: how wide, and which text."""

    def __init__(self, doc: Document, about: dict):
        self.wide = about.get("Subtype") == "Type0"
        inner = about
        if self.wide:
            below = doc.get(about.get("DescendantFonts"))
            inner = doc.get(below[0]) if isinstance(below, list) and below else {}
            inner = inner if isinstance(inner, dict) else {}
        self.widths: dict[int, float] = {}
        self.default = 1000.0 if self.wide else 500.0
        listed = doc.get(inner.get("W" if self.wide else "Widths"))
        if self.wide:
            self.default = float(doc.get(inner.get("DW")) or 1000)
            items, i = [doc.get(x) for x in listed or []], 0
            while i + 1 < len(items):
                if isinstance(items[i + 1], list):
                    self.widths |= {int(items[i]) + k: float(doc.get(w) or 0) for k, w in enumerate(items[i + 1])}
                    i += 2
                else:
                    self.widths |= dict.fromkeys(range(int(items[i]), min(int(items[i + 1]), int(items[i]) + 65536) + 1), float(items[i + 2] or 0)) if i + 2 < len(items) else {}
                    i += 3
        elif isinstance(listed, list):
            first = doc.get(inner.get("FirstChar")) or 0
            self.widths = {int(first) + k: float(doc.get(w) or 0) for k, w in enumerate(listed)}
        self.text: dict[int, str] = {}
        cmap = doc.get(about.get("ToUnicode"))
        if isinstance(cmap, Stream):
            try:
                self.unicode(doc.decoded(cmap))
            except (FilterError, ValueError):
                pass
        encoding = doc.get(about.get("Encoding"))
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        self.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.names: dict[int, str] = {}
        code = 0
        for x in doc.get(encoding.get("Differences")) or [] if isinstance(encoding, dict) else []:
            x = doc.get(x)
            if isinstance(x, Name):
                self.names[code] = glyph_text(x)
                code += 1
            elif isinstance(x, int | float):
                code = int(x)

    def unicode(self, body: bytes) -> None:
        reader, values = Reader(body, references=False), []
        number = lambda b: int.from_bytes(b, "big")
        shown = lambda b: b.decode("utf-16-be", "replace")
        while (value := reader.object()) is not _END:
            if not isinstance(value, Word):
                values.append(value)
                continue
            if value == "endbfchar":
                self.text |= {number(a): shown(b) for a, b in zip(values[::2], values[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
            elif value == "endbfrange":
                for a, b, c in zip(values[::3], values[1::3], values[2::3], strict=False):
                    if not isinstance(a, bytes) or not isinstance(b, bytes):
                        continue
                    for k in range(min(number(b) - number(a) + 1, 65536)):
                        if isinstance(c, list):
                            if k < len(c) and isinstance(c[k], bytes):
                                self.text[number(a) + k] = shown(c[k])
                        elif isinstance(c, bytes) and len(c) >= 2:
                            self.text[number(a) + k] = shown(c[:-2] + ((number(c[-2:]) + k) & 0xFFFF).to_bytes(2, "big"))
            values = []

    def codes(self, data: bytes) -> list[tuple[int, int]]:
        """Codes, and whether each is the single-byte space."""
        if self.wide:
            return [(int.from_bytes(data[i : i + 2], "big"), 0) for i in range(0, len(data) - 1, 2)]
        return [(c, int(c == 32)) for c in data]

    def char(self, code: int) -> str:
        if code in self.text:
            return self.text[code]
        if self.wide:
            return ""
        return self.names.get(code) or bytes([code & 255]).decode(self.codec, "replace")


def glyph_text(name: str) -> str:
    """A glyph's text by its name: one letter, uniXXXX or uXXXXX, or a common name."""
    if len(name) == 1:
        return name
    if found := re.fullmatch(r"uni([0-9A-F]{4})+|u([0-9A-F]{4,6})", name):
        digits = name[3:] if name.startswith("uni") else found[2]
        return "".join(chr(int(digits[i : i + 4], 16)) for i in range(0, len(digits), 4)) if name.startswith("uni") else chr(int(digits, 16))
    import unicodedata

    signs = {"space": " ", "period": ".", "comma": ",", "hyphen": "-", "colon": ":", "semicolon": ";", "quotesingle": "'", "quoteright": "’", "quoteleft": "‘", "parenleft": "(", "parenright": ")", "slash": "/", "fi": "fi", "fl": "fl", "ff": "ff", "endash": "–", "emdash": "—", "bullet": "•"}
    if name in signs:
        return signs[name]
    digits = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
    if name in digits:
        return str(digits.index(name))
    if found := re.fullmatch(r"([A-Za-z])(acute|grave|circumflex|dieresis|tilde|cedilla|ring|caron)", name):
        accent = {"circumflex": "CIRCUMFLEX", "ring": "RING ABOVE", "dieresis": "DIAERESIS"}.get(found[2], found[2].upper())
        case = "CAPITAL" if found[1].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"LATIN {case} LETTER {found[1].upper()} WITH {accent}")
        except KeyError:
            return ""
    return ""


Matrix = tuple[float, float, float, float, float, float]


def times(m: Matrix, n: Matrix) -> Matrix:
    """First m, then n."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


_SAME: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def text_runs(doc: Document, page: dict, found: list[tuple[str, list]] | None = None) -> list[dict]:
    """The shown strings of a page: text, matrix of an em, width in ems' space. ``found``: the page's operations, where they are read already."""
    out: list[dict] = []
    fonts: dict[int, Font] = {}

    def show(found: list[tuple[str, list]], resources: dict, ctm: Matrix, depth: int) -> None:
        state = {"ctm": ctm, "font": None, "size": 0.0, "Tc": 0.0, "Tw": 0.0, "Tz": 1.0, "TL": 0.0, "Ts": 0.0}
        stack: list[dict] = []
        line = at = _SAME
        named = lambda kind, key: doc.get((doc.get(resources.get(kind)) or {}).get(key)) if isinstance(doc.get(resources.get(kind)), dict) else None

        def put(data: bytes) -> None:
            nonlocal at
            font, size = state["font"], state["size"]
            if font is None:
                return
            parts, along = [], 0.0
            start = times((size * state["Tz"], 0.0, 0.0, size, 0.0, state["Ts"]), times(at, state["ctm"]))
            codes = font.codes(data)
            known = {k: (font.char(k[0]), (font.widths.get(k[0], font.default) / 1000 * size + state["Tc"] + k[1] * state["Tw"]) * state["Tz"]) for k in set(codes)}
            for k in codes:
                part, step = known[k]
                parts.append(part)
                along += step
            text = "".join(parts)
            at = times((1, 0, 0, 1, along, 0), at)
            if text:
                out.append({"text": text, "width": along / (size * state["Tz"]) if size * state["Tz"] else 0.0, "matrix": dict(zip("abcdef", map(float, start), strict=True))})

        for operator, x in found:
            try:
                if operator == "q":
                    stack.append(dict(state))
                elif operator == "Q" and stack:
                    state = stack.pop()
                elif operator == "cm":
                    state["ctm"] = times(tuple(map(float, x[:6])), state["ctm"])
                elif operator == "BT":
                    line = at = _SAME
                elif operator == "Tf":
                    about = named("Font", x[0])
                    state["size"] = float(x[1])
                    if isinstance(about, dict):
                        state["font"] = fonts.setdefault(id(about), None) or Font(doc, about)
                        fonts[id(about)] = state["font"]
                elif operator in ("Td", "TD"):
                    if operator == "TD":
                        state["TL"] = -float(x[1])
                    line = at = times((1, 0, 0, 1, float(x[0]), float(x[1])), line)
                elif operator == "Tm":
                    line = at = tuple(map(float, x[:6]))
                elif operator == "T*":
                    line = at = times((1, 0, 0, 1, 0, -state["TL"]), line)
                elif operator in ("Tc", "Tw", "TL", "Ts"):
                    state[operator] = float(x[0])
                elif operator == "Tz":
                    state["Tz"] = float(x[0]) / 100
                elif operator == "Tj":
                    put(x[0])
                elif operator in ("'", '"'):
                    if operator == '"':
                        state["Tw"], state["Tc"] = float(x[0]), float(x[1])
                    line = at = times((1, 0, 0, 1, 0, -state["TL"]), line)
                    put(x[-1])
                elif operator == "TJ":
                    for part in x[0]:
                        if isinstance(part, bytes):
                            put(part)
                        elif isinstance(part, int | float):
                            at = times((1, 0, 0, 1, -part / 1000 * state["size"] * state["Tz"], 0), at)
                elif operator == "Do" and depth < 16:
                    form = named("XObject", x[0])
                    if isinstance(form, Stream) and form.about.get("Subtype") == "Form":
                        matrix = doc.get(form.about.get("Matrix"))
                        own = doc.get(form.about.get("Resources"))
                        show(operations(doc.decoded(form)), own if isinstance(own, dict) else resources, times(tuple(map(float, matrix)), state["ctm"]) if isinstance(matrix, list) and len(matrix) == 6 else state["ctm"], depth + 1)
            except (ValueError, TypeError, IndexError, KeyError, FilterError):
                continue  # an operation with wrong operands does nothing

    resources = doc.get(page.get("Resources"))
    show(operations(doc.content(page)) if found is None else found, resources if isinstance(resources, dict) else {}, _SAME, 0)
    return out


_PAGE = pa.struct(
    [
        ("page_index", pa.int32()), ("media_box", pa.list_(pa.float64())), ("crop_box", pa.list_(pa.float64())), ("rotation", pa.int32()), ("n_operations", pa.int32()),
        ("runs", pa.list_(pa.struct([("run_index", pa.int32()), ("text", pa.string()), ("width", pa.float64()), ("matrix", pa.struct([(c, pa.float64()) for c in "abcdef"]))]))),
        ("annotations", pa.list_(pa.struct([
            ("slot", pa.int32()), ("subtype", pa.string()), ("flags", pa.int64()), ("rect", pa.struct([(c, pa.float64()) for c in ("left", "bottom", "right", "top")])), ("contents", pa.string()), ("author", pa.string()), ("name", pa.string()),
            ("action", pa.string()), ("target", pa.string()), ("coordinates", pa.list_(pa.float64())), ("ink", pa.list_(pa.list_(pa.float64()))),
        ]))),
    ]
)
_FIELD = pa.struct([("name", pa.string()), ("kind", pa.string()), ("flags", pa.int64()), ("value", pa.string()), ("checked", pa.bool_()), ("widgets", pa.int32()), ("options", pa.list_(pa.struct([("export", pa.string()), ("display", pa.string())])))])
_SCHEMA = pa.schema([("path", pa.string()), ("version", pa.string()), ("is_encrypted", pa.bool_()), ("recovered", pa.bool_()), ("info", pa.map_(pa.string(), pa.string())), ("pages", pa.list_(_PAGE)), ("fields", pa.list_(_FIELD)), ("_corrupt", pa.string())])
SCHEMA = """path string, version string, is_encrypted boolean, recovered boolean, info map<string,string>,
    pages array<struct<page_index:int,media_box:array<double>,crop_box:array<double>,rotation:int,n_operations:int,
    runs:array<struct<run_index:int,text:string,width:double,matrix:struct<a:double,b:double,c:double,d:double,e:double,f:double>>>,
    annotations:array<struct<slot:int,subtype:string,flags:bigint,rect:struct<left:double,bottom:double,right:double,top:double>,contents:string,author:string,name:string,action:string,target:string,coordinates:array<double>,ink:array<array<double>>>>>>,
    fields array<struct<name:string,kind:string,flags:bigint,value:string,checked:boolean,widgets:int,options:array<struct<export:string,display:string>>>>, _corrupt string"""


def parse_file(path: str, data: bytes) -> dict:
    """One file's row."""
    head = re.search(rb"%PDF-(\d\.\d)", data[:1024])
    row = {"path": path, "version": head[1].decode() if head else None, "is_encrypted": None, "recovered": None, "info": None, "pages": None, "fields": None, "_corrupt": None}
    try:
        doc = Document.open(data)
        row |= {"is_encrypted": "Encrypt" in doc.trailer, "recovered": doc.recovered}
        if row["is_encrypted"]:
            return row
        row["info"], pages = list(doc.info().items()), []
        for i, page in enumerate(doc.pages()):
            box = lambda k, page=page: [float(v) for v in map(doc.get, doc.get(page.get(k)) or []) if isinstance(v, int | float)] or None
            turn = doc.get(page.get("Rotate"))
            turn = int(turn) % 360 // 90 * 90 if isinstance(turn, int | float) else 0
            found = operations(doc.content(page))
            runs = [r | {"run_index": k} for k, r in enumerate(text_runs(doc, page, found))]
            pages.append({"page_index": i, "media_box": box("MediaBox"), "crop_box": box("CropBox"), "rotation": turn, "n_operations": len(found), "runs": runs, "annotations": doc.annotations(page)})
        row["pages"], row["fields"] = pages, doc.fields()
    except (ValueError, RecursionError, TypeError, KeyError, IndexError, AttributeError, struct.error) as problem:
        row["_corrupt"] = f"{type(problem).__name__}: {problem}"
    return row


def parsed(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each file of a table of bytes; null bytes are a file that can't be opened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([parse_file(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"")], schema=_SCHEMA)

    return files.select(path, content).mapInArrow(run, SCHEMA)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each PDF file below a path."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path))


def read_operations(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each operation of each page's content: path, page_index, op_index, operator, and its operands in JSON (bytes as Latin-1, names with a slash)."""
    import json

    def shown(value):
        if isinstance(value, Name):
            return f"/{value}"
        if isinstance(value, bytes):
            return value.decode("latin-1")
        if isinstance(value, list):
            return [shown(x) for x in value]
        return {k: shown(v) for k, v in value.items()} if isinstance(value, dict) else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    doc = Document.open(batch.column(1)[i].as_py() or b"")
                    pages = doc.pages()
                except (ValueError, RecursionError, TypeError, KeyError, IndexError, AttributeError, struct.error):
                    continue
                for number, page in enumerate(pages):
                    found = operations(doc.content(page))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "path": pa.array([batch.column(0)[i].as_py()] * len(found), pa.string()), "page_index": pa.array([number] * len(found), pa.int32()), "op_index": pa.array(range(len(found)), pa.int32()),
                            "operator": pa.array([o for o, _ in found], pa.string()), "operands": pa.array([json.dumps(shown(x), ensure_ascii=False) for _, x in found], pa.string()),
                        }
                    )

    return files.select(path, content).mapInArrow(run, "path string, page_index int, op_index int, operator string, operands string")
