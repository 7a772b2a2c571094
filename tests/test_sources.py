import random
import zlib

from folioflow.sources import codecs
from folioflow.sources.pdf import operations, parse_file, read_pdfs


def small_pdf(content: bytes, table: bool = True) -> bytes:
    packed = zlib.compress(content)
    objects = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 9 /MediaBox [0 0 300 200] /Rotate 450 >>",
        b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = bytearray(b"%PDF-1.7\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    start = len(out)
    if table:
        out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    out += b"trailer << /Size 6 /Root 1 0 R >>\n" + (b"startxref\n%d\n%%%%EOF" % start if table else b"")
    return bytes(out)


CONTENT = b"BT /F1 24 Tf 72 120 Td (Hello, \\(wor) Tj [(ld) -500 (!)] TJ ET"


def test_a_file_and_the_same_without_its_table():
    for table in (True, False):
        row = parse_file("x", small_pdf(CONTENT, table))
        assert row["_corrupt"] is None and row["recovered"] is not table
        (page,) = row["pages"]
        assert [r["text"] for r in page["runs"]] == ["Hello, (wor", "ld", "!"] and page["rotation"] == 90
        assert page["media_box"] == [0, 0, 300, 200] and page["runs"][0]["matrix"]["e"] == 72


def test_what_is_no_file_is_told():
    assert parse_file("x", b"nothing at all")["_corrupt"]


def test_files_as_a_table(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(small_pdf(CONTENT))
    (tmp_path / "b.pdf").write_bytes(b"broken")
    rows = read_pdfs(spark, f"file://{tmp_path}").selectExpr("pages[0].runs[0].text as text", "_corrupt is null as fine").collect()
    assert sorted((str(r.text), r.fine) for r in rows) == [("Hello, (wor", True), ("None", False)]


def test_operations_keep_inline_pictures_whole():
    assert operations(b"q BI /W 2 /H 1 ID \x01 \xffEI Q EI Q 1 0 0 RG") == [("q", []), ("BI", [{"W": 2, "H": 1}, b"\x01 \xffEI Q"]), ("Q", []), ("RG", [1, 0, 0])]


def test_codecs():
    data = bytes(range(256)) * 3
    assert codecs.flate(zlib.compress(data)) == data
    assert codecs.ascii_hex(b"48 65 6C6c 6F7>") == b"Hellop"
    assert codecs.ascii_85(b"87cURDZ~>") == b"Hello"
    assert codecs.run_length(bytes([2]) + b"abc" + bytes([254]) + b"x" + bytes([128])) == b"abcxxx"
    assert codecs.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    rows = b"".join(bytes([1]) + bytes([5, 1, 1, 1]) for _ in range(2))
    assert codecs.unpredicted(rows, {"Predictor": 15, "Columns": 4}) == bytes([5, 6, 7, 8] * 2)
    assert codecs.png_header(b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR\0\0\0\x02\0\0\0\x03\x08\x06") == (2, 3, 8, 6)


def test_rows_told_by_the_row_above():
    rng = random.Random(2)
    for columns, kinds, rest in ((4, [2] * 9, 0), (3, [2, 2, 1, 2, 0], 2), (5, [0, 2, 2], 0), (1, [2], 0)):
        rows = [bytes([k, *(rng.randrange(256) for _ in range(columns))]) for k in kinds]
        data, above, want = b"".join(rows) + (b"\x02\x07\x08")[:rest], bytes(columns), b""
        for row in [*rows, *([b"\x02\x07"] if rest else [])]:
            line = bytearray(row[1:])
            for i in range(len(line)):
                line[i] = (line[i] + (above[i] if row[0] == 2 else line[i - 1] if row[0] == 1 and i else 0)) & 255
            above, want = bytes(line) + bytes(columns - len(line)), want + bytes(line)
        assert codecs.unpredicted(data, {"Predictor": 12, "Columns": columns}) == want


def test_a_page_is_read_once(monkeypatch):
    from folioflow.sources import pdf, pdf_writer

    calls, read = [], pdf.operations
    monkeypatch.setattr(pdf, "operations", lambda content: calls.append(1) or read(content))
    row = pdf.parse_file("0.pdf", pdf_writer.document_bytes(["a b", "c"], "plain", "t"))
    assert len(calls) == 2 and [p["runs"][0]["text"] for p in row["pages"]] == ["a b", "c"] and [p["n_operations"] for p in row["pages"]] == [5, 5]
