"""PDF files from objects: serialising, fresh files with either kind of cross-reference, and incremental saves.

A table of pages becomes a file a document with ``written_pdfs``; each document's pages are grouped once
and its bytes are made in one Arrow batch row, so a document has to fit in a task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.pdf import Name, Ref, Stream

_PLAIN_NAME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.+*")


def serialised(value) -> bytes:
    """An object in the format's syntax; what has no syntax raises."""
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return str(value).encode()
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, Name):
        return b"/" + b"".join(bytes([c]) if c in _PLAIN_NAME else b"#%02X" % c for c in value.encode("latin-1"))
    if isinstance(value, bytes):
        return b"<" + value.hex().upper().encode() + b">" if any(c < 32 or c > 126 for c in value) else b"(" + value.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") + b")"
    if isinstance(value, str):
        return serialised(value.encode("latin-1") if all(ord(c) < 256 for c in value) else b"\xfe\xff" + value.encode("utf-16-be"))
    if isinstance(value, Ref):
        return b"%d %d R" % (value.number, value.generation)
    if isinstance(value, list):
        return b"[" + b" ".join(map(serialised, value)) + b"]"
    if isinstance(value, dict):
        return b"<<" + b" ".join(serialised(Name(k)) + b" " + serialised(v) for k, v in value.items()) + b">>"
    if isinstance(value, Stream):
        return serialised(value.about | {"Length": len(value.raw)}) + b"\nstream\n" + value.raw + b"\nendstream"
    raise TypeError(f"{type(value).__name__} can't be written")


def packed(data: bytes, up: int = 0) -> Stream:
    """A stream with its data deflated; ``up``: bytes of a row that is told by its difference from the row above."""
    about = {"Filter": Name("FlateDecode")}
    if up:
        rows = [bytes(up), *(data[i : i + up] for i in range(0, len(data), up))]
        data = b"".join(b"\x02" + bytes((c - p) & 255 for c, p in zip(row, above, strict=False)) for above, row in zip(rows, rows[1:], strict=False))
        about["DecodeParms"] = {"Predictor": 12, "Columns": up}
    return Stream(about, zlib.compress(data))


def _numbered(objects: dict[int, object], start: int) -> tuple[bytes, dict[int, int]]:
    out, places = bytearray(), {}
    for number, value in sorted(objects.items()):
        places[number] = start + len(out)
        out += b"%d 0 obj\n" % number + serialised(value) + b"\nendobj\n"
    return bytes(out), places


def _table(places: dict[int, int], trailer: dict, at: int, first: bool) -> bytes:
    lines = [b"xref"]
    if first:
        lines += [b"0 1", b"0000000000 65535 f "]
    for number, place in sorted(places.items()):
        lines += [b"%d 1" % number, b"%010d 00000 n " % place]
    return b"\n".join([*lines, b"trailer", serialised(trailer), b"startxref", str(at).encode(), b"%%EOF\n"])


def built(objects: dict[int, object], root: int, info: int | None = None, version: str = "1.7", compact: bool = False) -> bytes:
    """A new file. ``compact`` puts what is no stream into an object stream and uses a cross-reference stream."""
    trailer: dict = {"Size": max(objects) + 1, "Root": Ref(root, 0)} | ({"Info": Ref(info, 0)} if info else {})
    head = f"%PDF-{version}\n%".encode() + b"\xe2\xe3\xcf\xd3\n"
    if not compact:
        body, places = _numbered(objects, len(head))
        return head + body + _table(places, trailer, len(head) + len(body), True)
    inner = {n: v for n, v in objects.items() if not isinstance(v, Stream)}
    holder, own = max(objects) + 1, max(objects) + 2
    parts, at, heads = [], 0, []
    for number, value in sorted(inner.items()):
        heads.append(b"%d %d" % (number, at))
        parts.append(serialised(value))
        at += len(parts[-1]) + 1
    index = b" ".join(heads) + b"\n"
    stream = packed(index + b"\n".join(parts))
    stream.about |= {"Type": Name("ObjStm"), "N": len(inner), "First": len(index)}
    body, places = _numbered({n: v for n, v in objects.items() if n not in inner} | {holder: stream}, len(head))
    places[own] = start = len(head) + len(body)
    order = {n: i for i, n in enumerate(sorted(inner))}
    rows = [(0, 0, 65535)] + [(2, holder, order[n]) if n in order else (1, places[n], 0) if n in places else (0, 0, 0) for n in range(1, own + 1)]
    table = packed(b"".join(bytes([kind]) + a.to_bytes(4, "big") + b.to_bytes(2, "big") for kind, a, b in rows), up=7)
    table.about |= trailer | {"Type": Name("XRef"), "Size": own + 1, "W": [1, 4, 2]}
    return head + body + b"%d 0 obj\n" % own + serialised(table) + b"\nendobj\nstartxref\n%d\n%%%%EOF\n" % start


def saved(data: bytes, changed: dict[int, object], trailer: dict, before: int) -> bytes:
    """A file's bytes as they are, then changed objects and a section that leads to the one ``before``."""
    start = data if data.endswith(b"\n") else data + b"\n"
    body, places = _numbered(changed, len(start))
    return start + body + _table(places, trailer | {"Prev": before}, len(start) + len(body), False)


def text_page(lines: list[str], size: float = 10.0) -> bytes:
    """Operations that show lines one under the other in font F1."""
    shown = b"\n".join(serialised(line) + b" Tj T*" for line in lines)
    return b"BT /F1 %d Tf %d TL 50 740 Td\n" % (int(size), int(size * 2)) + shown + b"\nET"


#: Ways in which a document's file is made, by its number.
WAYS = ("plain", "compact", "saved twice", "damaged", "unicode font")


def document_bytes(pages: list[str], way: str, title: str, notes: list[tuple[int, list[float], str]] = (), fields: list[tuple[str, str]] = ()) -> bytes:
    """A document of text pages with notes (page, rect, contents) and text fields (dotted name of two parts, value)."""
    first, fonts = 10, {"F1": Ref(3, 0)}
    font: dict = {"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name("Helvetica"), "Encoding": Name("WinAnsiEncoding")}
    objects: dict[int, object] = {}
    codes: dict[str, int] = {}
    if way == "unicode font":
        for c in sorted(set("".join(pages))):
            codes[c] = len(codes) + 1
        pairs = b"\n".join(b"<%04X> <%s>" % (n, c.encode("utf-16-be").hex().upper().encode()) for c, n in codes.items())
        objects[4] = packed(b"/CIDInit /ProcSet findresource begin begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange %d beginbfchar\n%s\nendbfchar endcmap end" % (len(codes), pairs))
        objects[5] = {"Type": Name("Font"), "Subtype": Name("CIDFontType2"), "BaseFont": Name("Made"), "DW": 500}
        font = {"Type": Name("Font"), "Subtype": Name("Type0"), "BaseFont": Name("Made"), "Encoding": Name("Identity-H"), "DescendantFonts": [Ref(5, 0)], "ToUnicode": Ref(4, 0)}
    objects |= {1: {"Type": Name("Catalog"), "Pages": Ref(2, 0)}, 3: font, 6: {"Title": title}}
    kids, number = [], first
    for i, text in enumerate(pages):
        if codes:
            content = b"BT /F1 10 Tf 50 740 Td <" + b"".join(b"%04X" % codes[c] for c in text) + b"> Tj ET"
        else:
            content = b"BT /F1 10 Tf 50 740 Td " + serialised(text) + b" Tj ET"
        page: dict = {"Type": Name("Page"), "Parent": Ref(2, 0), "Contents": Ref(number + 1, 0), "Annots": []}
        objects[number], objects[number + 1] = page, packed(content, up=4 if i % 2 else 0) if len(content) % 4 == 0 or i % 2 == 0 else packed(content + b" " * (-len(content) % 4), up=4)
        kids.append(Ref(number, 0))
        number += 2
    for at, rect, contents in notes:
        objects[number] = {"Type": Name("Annot"), "Subtype": Name("Text"), "Rect": rect, "Contents": contents, "NM": f"n{number}", "F": 4}
        objects[kids[at].number]["Annots"].append(Ref(number, 0))
        number += 1
    objects[2] = {"Type": Name("Pages"), "Kids": kids, "Count": len(kids), "MediaBox": [0, 0, 612, 792], "Resources": {"Font": fonts}}
    if fields:
        parents: dict[str, int] = {}
        for name, value in fields:
            above, _, own = name.partition(".")
            if above not in parents:
                parents[above] = number
                objects[number] = {"T": above, "FT": Name("Tx"), "Kids": []}
                number += 1
            objects[number] = {"T": own, "Parent": Ref(parents[above], 0), "V": value, "Subtype": Name("Widget"), "Rect": [0, 0, 10, 10], "P": kids[0]}
            objects[parents[above]]["Kids"].append(Ref(number, 0))
            number += 1
        objects[1]["AcroForm"] = {"Fields": [Ref(n, 0) for n in parents.values()]}
    data = built(objects, 1, 6, compact=way == "compact")
    if way == "saved twice":
        before = data.rindex(b"xref\n0 1")
        data = saved(data, {6: {"Title": title + "!"}}, {"Size": number, "Root": Ref(1, 0), "Info": Ref(6, 0)}, before)
    return data.replace(b"startxref", b"startxxxx") if way == "damaged" else data


def written_pdfs(pages: DataFrame, doc: str, page: str, text: str, notes: bool = False, fields: bool = False) -> DataFrame:
    """path and content of a file for each document: its pages in order, made in one of five ways by the document's number.

    With ``notes`` each page has one annotation with its text's first ten characters, with ``fields`` the
    document has a text field ``form.page<n>`` for each page. Characters beyond Latin-1 become question
    marks but in the way "unicode font"; null texts are empty pages.
    """
    held = pages.groupBy(F.col(doc).cast("long").alias("doc")).agg(F.sort_array(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), F.coalesce(text, F.lit("")).alias("text")))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, listed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                way = WAYS[number % len(WAYS)]
                texts = [p["text"] if way == "unicode font" else p["text"].encode("latin-1", "replace").decode("latin-1") for p in listed]
                marks = [(i, [10.0 * i, 20.5, 10.0 * i + 30, 40.25], t[:10]) for i, t in enumerate(texts)] if notes else []
                entries = [(f"form.page{i}", t[:20]) for i, t in enumerate(texts)] if fields else []
                data = document_bytes(texts, way, f"document {number}", marks, entries)
                yield pa.RecordBatch.from_pydict({"path": [f"{number}.pdf"], "content": pa.array([data], pa.binary())})

    return held.mapInArrow(run, "path string, content binary")
