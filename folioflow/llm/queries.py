"""The queries of the corpus operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import conversations_sql
from folioflow.llm.ann import nearest_neighbours
from folioflow.llm.bpe import bpe_encode_decode
from folioflow.llm.collocations import collocations
from folioflow.llm.conversations import damaged, repair_conversations
from folioflow.llm.elias_fano import read_token_files, write_token_files
from folioflow.llm.embedding_dedup import linked_vectors
from folioflow.llm.lm import score_documents
from folioflow.llm.mixing import mix_report
from folioflow.llm.ngram_join import similar_documents
from folioflow.llm.quality import quality_report
from folioflow.llm.sharding import extendible_shards
from folioflow.llm.substring import substring_dedup
from folioflow.llm.warc import read_archives, write_archives

#: How far the triangle inequality's pruning is relaxed; one is exact search.
PRUNING = 1.0
#: A shard's bytes: small enough that the directory splits at every scale of the tables.
SHARD_BYTES = 1 << 20


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), length=50, columns=["doc_id"])
    # a text of which nothing goes comes with its own white space
    joined = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t-\\r]+", " "), F.lit(" "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, factor=PRUNING)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extendible_shards(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary(), end_id=1)
    found = read_token_files(spark, manifest)
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(spark, write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_encode_decode(table(spark, sf_dir, "documents"), vocabulary(), columns=["doc_id"])
    return found.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"), threshold=0.8, size=5).select("doc_id", "class_id", "n_links")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_report(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_mixing": op2_mixing,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_sharding": op5_sharding,
    "op6_token_files": op6_token_files,
    "op7_warc": op7_warc,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_ngram_join": op9_ngram_join,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents
        ), words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
        ), runs AS (
            SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM words, (SELECT CAST(range AS INTEGER) AS size FROM range(1, 5)) AS sizes)
        ), counts AS (
            SELECT lang, size, phrase, count(*) AS a FROM runs GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(a) AS n FROM counts WHERE size = 1 GROUP BY lang
        ), found AS (
            SELECT *, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND a >= 30
        ), cuts AS (
            SELECT f.lang, f.phrase, f.a, k, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * f.a // (l.a + r.a) AS BIGINT) AS score
            FROM found AS f CROSS JOIN (SELECT CAST(range AS INTEGER) AS k FROM range(1, 4)) AS places
            JOIN counts AS l ON l.lang = f.lang AND l.phrase = array_to_string(f.w[1 : k], ' ') JOIN counts AS r ON r.lang = f.lang AND r.phrase = array_to_string(f.w[k + 1 :], ' ')
            WHERE k < f.size
        ), scored AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT f.lang, f.w, f.a, s.size, unnest(range(1, f.size - s.size + 2)) AS i FROM found AS f JOIN (SELECT CAST(range AS INTEGER) AS size FROM range(2, 4)) AS s ON s.size < f.size)
            GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score
        FROM scored LEFT JOIN longer USING (lang, phrase) JOIN totals USING (lang) WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * CAST(a AS HUGEINT)
        QUALIFY rank <= 2000
    """,
    "op12_conversation_repair": conversations_sql.sql(),
    "op13_embedding_dedup": """
        WITH RECURSIVE rows AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), fine AS (
            SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM rows
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM fine AS a JOIN fine AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93
        ), reached AS (
            SELECT a AS vec_id, a AS other FROM links UNION SELECT r.vec_id, l.b FROM reached AS r JOIN links AS l ON r.other = l.a
        ), least AS (
            SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
        ), counts AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
        FROM rows LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
    """,
    "op7_warc": """
        WITH rows AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
        ), firsts AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM rows
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
        FROM firsts
    """,
    "op5_sharding": f"""
        WITH rows AS (
            SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS bits FROM documents
        ), prefixes AS (
            SELECT *, bits >> (60 - depth) AS prefix FROM rows, (SELECT CAST(range AS INTEGER) AS depth FROM range(0, 31)) AS d
        ), sums AS (
            SELECT depth, prefix, sum(n_bytes) AS shard_bytes, min(bits) = max(bits) AS alone FROM prefixes GROUP BY ALL
        ), fitting AS (
            SELECT p.doc_id, p.n_bytes, p.depth, p.prefix, s.shard_bytes, row_number() OVER (PARTITION BY p.doc_id ORDER BY p.depth) AS nth
            FROM prefixes AS p JOIN sums AS s ON p.depth = s.depth AND p.prefix = s.prefix WHERE s.shard_bytes <= {SHARD_BYTES} OR s.alone
        )
        SELECT doc_id, n_bytes, depth, prefix, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, CAST(shard_bytes AS BIGINT) AS shard_bytes
        FROM fitting WHERE nth = 1
    """,
}
