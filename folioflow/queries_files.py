"""Registered queries that write PDF files from table rows, read them back, and compare them with the rows.

Conversations stand for documents and their turns for pages; files are made in five ways by the
conversation's number (see ``pdf_writer.WAYS``): with a cross-reference table, with object and
cross-reference streams, saved incrementally, damaged, and with a font that maps codes to text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import layout
from folioflow.queries import query, table
from folioflow.sources import pdf
from folioflow.sources.pdf_writer import written_pdfs

#: The rows as the files have them: pages in order, and characters beyond Latin-1 as question marks where the font has no more.
_PAGES = """(SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS page_index,
    CASE WHEN conv_id % 5 = 4 THEN coalesce(text, '') ELSE regexp_replace(coalesce(text, ''), '[^\\x{00}-\\x{FF}]', '?', 'g') END AS text FROM conversations)"""


def _files(spark, sf_dir, **options) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return written_pdfs(turns, "conv_id", "turn", "text", **options)


def _number(path: str = "path"):
    return F.regexp_extract(path, "(\\d+)\\.pdf", 1).cast("long").alias("conv_id")


@query(f"""SELECT conv_id, page_index, text FROM {_PAGES} WHERE text <> ''""")
def pdf_page_texts(spark, sf_dir):
    pages = pdf.parsed(_files(spark, sf_dir)).select(_number(), F.explode("pages").alias("p"))
    runs = pages.select("conv_id", "p.page_index", F.explode("p.runs").alias("r")).select("conv_id", "page_index", "r.*")
    return layout.joined_pages(runs, ["conv_id", "page_index"])


@query("""SELECT conv_id, '1.7' AS version, FALSE AS is_encrypted, conv_id % 5 = 3 AS recovered, CAST(count(*) AS INTEGER) AS n_pages, 'document ' || conv_id || CASE WHEN conv_id % 5 = 2 THEN '!' ELSE '' END AS title, 612.0 AS width, 792.0 AS height FROM conversations GROUP BY conv_id""")
def pdf_documents(spark, sf_dir):
    box = F.col("pages")[0]["media_box"]
    return pdf.parsed(_files(spark, sf_dir)).select(_number(), "version", "is_encrypted", "recovered", F.size("pages").alias("n_pages"), F.col("info")["Title"].alias("title"), box[2].alias("width"), box[3].alias("height"))


@query(f"""SELECT conv_id, page_index, o.i AS op_index, o.op AS operator FROM {_PAGES}, (VALUES (0, 'BT'), (1, 'Tf'), (2, 'Td'), (3, 'Tj'), (4, 'ET')) AS o(i, op)""")
def pdf_operations(spark, sf_dir):
    return pdf.read_operations(_files(spark, sf_dir)).select(_number(), "page_index", "op_index", "operator")


@query(f"""SELECT conv_id, page_index, 0 AS slot, 'Text' AS subtype, 10.0 * page_index AS left_side, 40.25::DOUBLE AS top_side, substr(text, 1, 10) AS contents, 4 AS flags FROM {_PAGES}""")
def pdf_annotations(spark, sf_dir):
    pages = pdf.parsed(_files(spark, sf_dir, notes=True)).select(_number(), F.explode("pages").alias("p"))
    found = pages.select("conv_id", "p.page_index", F.explode("p.annotations").alias("a"))
    return found.select("conv_id", "page_index", "a.slot", "a.subtype", F.col("a.rect.left").alias("left_side"), F.col("a.rect.top").alias("top_side"), "a.contents", F.col("a.flags").cast("int").alias("flags"))


@query(f"""SELECT conv_id, 'form.page' || page_index AS name, 'Tx' AS kind, substr(text, 1, 20) AS value FROM {_PAGES}""")
def pdf_form_fields(spark, sf_dir):
    found = pdf.parsed(_files(spark, sf_dir, fields=True)).select(_number(), F.explode("fields").alias("f"))
    return found.select("conv_id", "f.name", "f.kind", "f.value")
