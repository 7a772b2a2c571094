"""Registered queries of the document operators over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import calculator, geometry, measure
from folioflow.functions import text as texts
from folioflow.operators import annotations, caches, compare, editing, layout, pages, recognition, search, trees
from folioflow.plans.partitioning import spread
from folioflow.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if there is any."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


#: The pattern of white space in DuckDB's syntax, for use in brackets.
_BLANK = texts.SPACES


# search


@query("""SELECT doc_id, lang, n FROM (SELECT doc_id, lang, len(list_filter(string_split_regex(lower(text), '[^0-9a-z_]+'), lambda x: x = 'the')) AS n FROM documents)
    WHERE n > 0 ORDER BY n DESC, doc_id LIMIT 20""")
def search_top_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", search.count_whole_words(F.col("text"), "the").cast("long").alias("n"))
    return docs.filter("n > 0").orderBy(F.desc("n"), "doc_id").limit(20)


@query("""WITH parts AS (SELECT doc_id, list_transform(string_split(lower(text), 'ment'), lambda x: length(x)) AS p FROM documents),
    hits AS (SELECT doc_id, p, unnest(range(1, len(p))) AS i FROM parts)
    SELECT doc_id, CAST(list_sum(p[1:i]) + (i - 1) * 4 AS BIGINT) AS "start", CAST(list_sum(p[1:i]) + i * 4 AS BIGINT) AS "end" FROM hits""")
def search_matches(spark, sf_dir):
    found = search.find_literal(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "ment")
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query("""SELECT lang, CAST(sum(len(string_split(lower(text), 'ment')) - 1) AS BIGINT) AS matches, count(*) FILTER (lower(text) LIKE '%ment%') AS documents FROM documents GROUP BY lang""")
def search_counts(spark, sf_dir):
    n = F.size(texts.pieces(F.col("text"), "ment", False)) - 1
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(n).cast("long").alias("matches"), F.count_if(n > 0).alias("documents"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]+')) AS BIGINT) AS n FROM documents""")
def search_regex_counts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", search.count_regex(F.col("text"), "[0-9]+").cast("long").alias("n"))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[a-z]+ing') AS w, regexp_split_to_array(text, '[a-z]+ing') AS g FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(list_transform(w, lambda x: length(x))) AS w, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS g FROM t)
    SELECT doc_id, CAST(sum(w + g) OVER (PARTITION BY doc_id ORDER BY i) - w AS INTEGER) AS "start", CAST(w AS INTEGER) AS size FROM e""")
def search_regex_places(spark, sf_dir):
    found = search.find_regex(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "[a-z]+ing", case_sensitive=True)
    return found.select("doc_id", "start", (F.col("end") - F.col("start")).alias("size"))


@query(f"""WITH p AS (SELECT doc_id, text, list_transform(string_split(lower(text), 'license'), lambda x: length(x)) AS p FROM documents), h AS (SELECT doc_id, text, unnest(range(1, len(p))) AS i, p FROM p),
    m AS (SELECT doc_id, text, CAST(list_sum(p[1:i]) + (i - 1) * 7 AS BIGINT) AS a FROM h), w AS (SELECT *, a + 7 AS b FROM m WHERE NOT regexp_matches(substr(' ' || text, a + 1, 1), '[0-9A-Za-z_]') AND NOT regexp_matches(substr(text, a + 8, 1), '[0-9A-Za-z_]')),
    l AS (SELECT *, a - length(string_split(substr(text, 1, a), chr(10))[-1]) AS ls, b + length(string_split(substr(text, b + 1), chr(10))[1]) AS le FROM w), c AS (SELECT *, greatest(ls, a - 36) AS lo, least(le, b + 48) AS hi FROM l)
    SELECT doc_id, CAST(a AS INTEGER) AS "start", CASE WHEN lo > ls THEN '… ' ELSE '' END || ltrim(regexp_replace(substr(text, lo + 1, a - lo), '[{_BLANK}]+', ' ', 'g'), ' ') AS prefix, substr(text, a + 1, 7) AS match_text,
        rtrim(regexp_replace(substr(text, b + 1, hi - b), '[{_BLANK}]+', ' ', 'g'), ' ') || CASE WHEN hi < le THEN ' …' ELSE '' END AS suffix FROM c""")
def search_snippets(spark, sf_dir):
    found = search.find_literal(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "license", whole_word=True, lines=search.SNIPPET)
    return search.with_snippets(found).select("doc_id", "start", "prefix", "match_text", "suffix")


@query("""WITH m AS (SELECT doc_id, len(string_split(lower(text), 'ment')) - 1 AS n FROM documents)
    SELECT doc_id, CAST((n - 1 + 1) % n AS BIGINT) AS after_last, CAST((0 - 1 + n) % n AS BIGINT) AS before_first FROM m WHERE n > 0""")
def search_navigation(spark, sf_dir):
    n = F.size(texts.pieces(F.col("text"), "ment", False)) - 1
    docs = table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).filter("n > 0")
    return docs.select("doc_id", search.next_match(F.col("n") - 1, F.col("n")).cast("long").alias("after_last"), search.next_match(F.lit(0), F.col("n"), -1).cast("long").alias("before_first"))


@query("""SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id""")
def search_superseded(spark, sf_dir):
    return search.latest_search(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(f"""SELECT doc_id, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars, max(length(w)) AS longest FROM
    (SELECT doc_id, unnest(regexp_extract_all(text, '[^{_BLANK}]+')) AS w FROM documents) GROUP BY doc_id""")
def token_statistics(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", search.token_totals(F.col("text")).alias("t")).filter("t.n > 0").select("doc_id", "t.*")


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^{_BLANK}]+') AS w, regexp_split_to_array(text, '[^{_BLANK}]+') AS g FROM documents),
    e AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w, unnest(list_transform(g[1:len(w)], lambda x: length(x))) AS g FROM t)
    SELECT doc_id, CAST(i - 1 AS INTEGER) AS token_index, w AS token, i = 1 AS first, CAST(sum(length(w) + g) OVER (PARTITION BY doc_id ORDER BY i) - length(w) AS INTEGER) AS "start" FROM e""")
def token_offsets(spark, sf_dir):
    found = search.tokens(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("doc_id", "token_index", "token", (F.col("token_index") == 0).alias("first"), "start")


# text


@query("""SELECT doc_id, trim(regexp_replace(text, '[ \\t\\f\\x0B]+', ' ', 'g'), ' ') AS text FROM documents""")
def normalized_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", texts.normalized_spaces(F.col("text")).alias("text"))


@query(f"""WITH f AS (SELECT page_id, trim(regexp_replace(html, '[{_BLANK}]+', ' ', 'g'), ' ') AS t FROM pages)
    SELECT page_id, CASE WHEN length(t) > 60 THEN substr(t, 1, 59) || '…' ELSE t END AS label FROM f""")
def capped_labels(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", texts.label(F.col("html")).alias("label"))


@query(f"""SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^[{_BLANK}]*([•◦▪‣*–-]|\\(?([0-9]{{1,3}}|[A-Za-z])[.)])[{_BLANK}]+')) AS items
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id""")
def list_items(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(texts.is_list_item(F.col("line"))).alias("items"))


@query("""SELECT conv_id, turn, regexp_replace(text, '[^\\x{00}-\\x{FF}]', ' ', 'g') AS text FROM conversations""")
def latin_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.latin_only(F.col("text")).alias("text"))


@query("""SELECT doc_id, text, CASE WHEN regexp_matches(text, '[^\\x{00}-\\x{FF}]') THEN 2 + 2 * length(text) + 2 * len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) ELSE length(text) END AS size,
    CASE WHEN regexp_matches(text, '[^\\x{00}-\\x{FF}]') THEN 'FEFF' WHEN ascii(text) < 256 THEN printf('%02X', ascii(text)) END AS head FROM documents""")
def string_round_trip(spark, sf_dir):
    data = texts.encoded(F.col("text"))
    wide = F.col("text").rlike("[^\\x00-\\xFF]")
    return table(spark, sf_dir, "documents").select("doc_id", texts.decoded(data).alias("text"), F.octet_length(data).cast("long").alias("size"), F.hex(F.substring(data, 1, F.when(wide, 2).otherwise(1))).alias("head"))


@query("""WITH b AS (SELECT conv_id, turn, strlen(text) AS n, hex(encode(text)) AS h FROM conversations),
    s AS (SELECT *, CASE WHEN n <= 4096 THEN 1 ELSE n // 4096 END AS step FROM b),
    l AS (SELECT conv_id, turn, list_concat([n & 255, (n >> 8) & 255, (n >> 16) & 255, (n >> 24) & 255], list_transform(range(0, n, step), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))) AS v FROM s)
    SELECT conv_id, turn, lower(printf('%x', list_reduce(list_concat([2166136261::BIGINT], v), lambda a, x: (xor(a, x) * 16777619) % 4294967296))) AS key FROM l""")
def content_keys(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", texts.content_key(F.col("text").cast("binary")).alias("key"))


@query()
def reflowed_blocks(spark, sf_dir):
    return layout.line_blocks(table(spark, sf_dir, "documents"), "doc_id")


@query("""SELECT lang, count(*) AS n, CAST(median(n_chars) AS DOUBLE) AS middle FROM documents GROUP BY lang""")
def median_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.median("n_chars"), F.lit(0.0)).alias("middle"))


# comparison


_TURNS = "SELECT conv_id, turn, role, text FROM conversations"


@query("""WITH a AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 3 <> 0 OR turn < 2), b AS (SELECT conv_id, turn FROM conversations WHERE conv_id % 4 <> 0 OR turn <> 1)
    SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.turn AS before_page, b.turn AS after_page,
        CASE WHEN a.turn IS NULL THEN 'inserted' WHEN b.turn IS NULL THEN 'removed' ELSE 'matched' END AS kind
    FROM (SELECT DISTINCT * FROM a) AS a FULL JOIN (SELECT DISTINCT * FROM b) AS b ON a.conv_id = b.conv_id AND a.turn = b.turn""")
def paired_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    return compare.page_pairs(turns.filter("conv_id % 3 <> 0 or turn < 2"), turns.filter("conv_id % 4 <> 0 or turn <> 1"), ["conv_id"], "turn")


@query("""WITH a AS (SELECT * FROM customer WHERE c_custkey % 7 <> 0), b AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 11 <> 0)
    SELECT CAST(coalesce(a.c_custkey, b.c_custkey) AS VARCHAR) AS name, CASE WHEN a.c_custkey IS NULL THEN 'created' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS kind
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_acctbal <> b.c_acctbal""")
def revision_changes(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    after = customer.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.when(F.col("c_custkey") % 5 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return compare.revision_diff(customer.filter("c_custkey % 7 <> 0"), after, "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])


@query()
def token_differences(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).filter("before is not null")
    keyed = turns.select(F.concat_ws("/", "conv_id", "turn").alias("pair"), "before", "after")
    return compare.hunks(compare.token_diff(keyed, "pair"), "pair")


@query(f"""WITH t AS (SELECT conv_id, turn, text AS after_text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text FROM conversations)
    SELECT conv_id || '/' || turn AS pair, trim(regexp_replace(before_text, '[{_BLANK}]+', ' ', 'g'), ' ') AS before_text, trim(regexp_replace(after_text, '[{_BLANK}]+', ' ', 'g'), ' ') AS after_text FROM t WHERE before_text IS NOT NULL""")
def token_difference_texts(spark, sf_dir):
    """Both texts of each pair, put together again from the stretches of their difference."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("text").over(w).alias("before"), F.col("text").alias("after")).filter("before is not null")
    found = compare.token_diff(turns.select(F.concat_ws("/", "conv_id", "turn").alias("pair"), "before", "after"), "pair")
    parts = found.groupBy("pair").agg(F.sort_array(F.collect_list(F.struct("seg_index", "before", "after"))).alias("s"))
    joined = lambda side: F.array_join(F.flatten(F.col(f"s.{side}")), " ")
    return parts.select("pair", joined("before").alias("before_text"), joined("after").alias("after_text"))


@query("""WITH p AS (SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)
    SELECT vec_id, CAST(list_sum(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN abs(CAST(floor(a[i] * 1000) AS INTEGER) - CAST(floor(b[i] * 1000) AS INTEGER)) > 8 THEN 1 ELSE 0 END)) AS BIGINT) AS differing, CAST(len(a) AS BIGINT) AS total FROM p WHERE b IS NOT NULL""")
def vector_differences(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    scaled = F.transform("embedding", lambda x: F.floor(x * 1000).cast("int"))
    pairs = editing.next_rows(vectors.select("vec_id", scaled.alias("a")), "vec_id").filter("next is not null").select("vec_id", "a", F.col("next.a").alias("b"))
    differing = F.size(F.filter(F.zip_with("a", "b", lambda x, y: F.abs(x - y) > 8), lambda d: d))
    return pairs.select("vec_id", differing.cast("long").alias("differing"), F.size("a").cast("long").alias("total"))


# pages and lists

_CONV = "(SELECT conv_id, turn, role FROM conversations)"


@query(f"""SELECT conv_id, role, turn AS old, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY -turn) - 1 AS INTEGER) AS turn FROM {_CONV}""")
def reordered_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", F.col("turn").alias("old"), "turn")
    return pages.reorder_pages(turns, ["conv_id"], "turn", -F.col("turn"))


@query(f"""WITH t AS (SELECT *, turn % 2 = 1 AS gone FROM {_CONV}), k AS (SELECT *, bool_and(gone) OVER (PARTITION BY conv_id) AS every FROM t)
    SELECT conv_id, turn AS old, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS turn FROM k WHERE every OR NOT gone""")
def removed_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("old"), "turn")
    return pages.remove_pages(turns, ["conv_id"], "turn", F.col("turn") % 2 == 1)


@query(f"""WITH b AS (SELECT 0 AS side, conv_id, turn FROM {_CONV} WHERE conv_id % 2 = 0 UNION ALL SELECT 1, conv_id - 1, turn FROM {_CONV} WHERE conv_id % 2 = 1)
    SELECT conv_id, CAST(max(turn) AS INTEGER) AS last FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY side, turn) - 1 AS turn FROM b) GROUP BY conv_id""")
def appended_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    both = pages.append_pages(turns.filter("conv_id % 2 = 0"), turns.filter("conv_id % 2 = 1").withColumn("conv_id", F.col("conv_id") - 1), ["conv_id"], "turn")
    return both.groupBy("conv_id").agg(F.max("turn").alias("last"))


@query(f"""SELECT t.conv_id, t.turn AS old, CAST(row_number() OVER (PARTITION BY t.conv_id ORDER BY p.place) - 1 AS INTEGER) AS turn
    FROM {_CONV} AS t JOIN (VALUES (0, 2), (1, 0), (2, 2)) AS p(place, page) ON t.turn = p.page""")
def extracted_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("old"), "turn")
    return pages.extract_pages(turns, ["conv_id"], "turn", [2, 0, 2])


@query(f"""WITH b AS (SELECT conv_id, turn, role, 1 AS new FROM {_CONV} UNION ALL SELECT DISTINCT conv_id, 1, 'blank', 0 FROM {_CONV})
    SELECT conv_id, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, new) - 1 AS INTEGER) AS turn FROM b""")
def inserted_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return pages.insert_blank(turns, ["conv_id"], "turn", 1, {"role": F.lit("blank")})


@query("""SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN (p_size % 4 * 90 + 270) % 360 ELSE p_size % 4 * 90 END AS INTEGER) AS rotation FROM part""")
def rotated_pages(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("rotation", F.col("p_size") % 4 * 90)
    return pages.rotate_pages(part, "rotation", F.col("p_size") > 25, 270).select("p_partkey", F.col("rotation").cast("int").alias("rotation"))


@query("""SELECT l_orderkey, l_linenumber AS old, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity > 25 AS INTEGER), l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS slot FROM lineitem""")
def front_order(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem").withColumn("slot", F.row_number().over(w))
    return pages.bring_to_front(rows, ["l_orderkey"], "slot", F.col("l_quantity") > 25).select("l_orderkey", F.col("l_linenumber").alias("old"), "slot")


@query("""WITH d AS (SELECT DISTINCT event_type, event_id FROM events), r AS (SELECT *, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS run FROM d)
    SELECT event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY event_type, run""")
def consecutive_events(spark, sf_dir):
    return pages.consecutive_runs(table(spark, sf_dir, "events"), ["event_type"], "event_id")


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def newest_definitions(spark, sf_dir):
    return pages.newest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type", "value")


@query("""SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 3""")
def capped_pages(spark, sf_dir):
    return pages.first_pages(table(spark, sf_dir, "orders"), ["o_custkey"], 3, F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def slowest_files(spark, sf_dir):
    return editing.slowest(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 25, "o_totalprice", "o_orderkey")


@query("""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber, l_partkey) AS INTEGER) AS place, l_extendedprice AS top FROM lineitem""")
def visual_order(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_extendedprice": "top", "l_quantity": "left"})
    return layout.in_visual_order(lines, ["l_orderkey"], "top", "left", "l_linenumber", "l_partkey").select("l_orderkey", "place", "top")


# trees and chains


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer")
    node = lambda df, kind, key, up, name, box, turn: df.select(F.concat(F.lit(kind), key.cast("string")).alias("node"), up.alias("parent"), name.alias("name"), box.alias("box"), turn.alias("turn"))
    none = F.lit(None).cast("string")
    return (
        node(region, "r", F.col("r_regionkey"), none, F.col("r_name"), F.concat(F.lit("box"), F.col("r_regionkey").cast("string")), F.lit(90))
        .unionByName(node(nation, "n", F.col("n_nationkey"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")), F.lit(None).cast("int")))
        .unionByName(node(customer, "c", F.col("c_custkey"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.col("c_name"), none, F.when(F.col("c_custkey") % 4 == 0, F.lit(180))))
    )


@query("""WITH RECURSIVE tree AS (
        SELECT 'r' || r_regionkey AS node, NULL AS parent, r_name AS name, 'box' || r_regionkey AS box, 90 AS turn FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, CASE WHEN n_nationkey % 3 = 0 THEN n_name END, NULL FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, NULL, CASE WHEN c_custkey % 4 = 0 THEN 180 END FROM customer),
    walked AS (SELECT node, 0 AS depth, name AS path_name, box, turn FROM tree WHERE parent IS NULL
        UNION ALL SELECT t.node, w.depth + 1, w.path_name || '.' || t.name, coalesce(t.box, w.box), coalesce(t.turn, w.turn) FROM tree AS t JOIN walked AS w ON t.parent = w.node)
    SELECT node, CAST(depth AS INTEGER) AS depth, path_name, box, CAST(turn AS INTEGER) AS turn FROM walked""")
def inherited_tree(spark, sf_dir):
    view = f"folioflow_tree_{uuid.uuid4().hex}"
    _tree(spark, sf_dir).createOrReplaceTempView(view)
    found = spark.sql(trees.walk_sql(view, "node", "parent", "name", ["box", "turn"]))
    return found.select("node", F.col("depth").cast("int").alias("depth"), "path_name", "box", F.col("turn").cast("int").alias("turn"))


# caches and queues


@query("""WITH l AS (SELECT event_type, user_id, ts, event_id, 100 + user_id % 50 AS size FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1),
    t AS (SELECT *, sum(size) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held_bytes FROM l)
    SELECT event_type, user_id, CAST(held_bytes AS BIGINT) AS held_bytes FROM t WHERE held_bytes <= 4096""")
def cache_snapshot(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("size", 100 + F.col("user_id") % 50)
    return caches.lru_snapshot(events, ["event_type"], "user_id", "size", 4096, F.desc("ts"), F.desc("event_id")).select("event_type", "user_id", F.col("held_bytes").cast("long").alias("held_bytes"))


@query("""WITH o AS (SELECT event_type, user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT event_type, user_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS INTEGER) AS recent_rank FROM o QUALIFY recent_rank <= 20""")
def recent_items(spark, sf_dir):
    return caches.recents(table(spark, sf_dir, "events"), ["event_type"], "user_id", 20, F.desc("ts"), F.desc("event_id")).select("event_type", "user_id", "recent_rank")


@query("""SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(event_id % 100 - 50), event_id) = 1""")
def nearest_request(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", (F.col("event_id") % 100).alias("page"))
    return caches.nearest_to_focus(events, ["user_id"], "page", F.lit(50), "event_id").select("user_id", "event_id", "event_type")


@query("""SELECT user_id AS token, min(event_id) AS seq, arg_max(event_id % 10, event_id) AS priority, count(*) AS asked FROM events GROUP BY user_id""")
def coalesced_requests(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("token"), F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("priority"))
    return caches.coalesced(events, "token", "seq", "priority")


@query("""WITH e AS (SELECT user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id % 3 END AS page FROM events)
    SELECT user_id, page, count(*) + (SELECT count(*) FROM e AS x WHERE x.user_id = e.user_id AND x.page IS NULL) AS stamp FROM e WHERE page IS NOT NULL GROUP BY user_id, page""")
def render_stamps(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id") % 3).alias("page"))
    return caches.page_stamps(events, "user_id", "page")


@query("""WITH r AS (SELECT 't' || l_linenumber AS tool, l_suppkey AS file, count(*) AS pages, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS ms FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
    f AS (SELECT file, min(pages) AS common FROM r GROUP BY file HAVING count(*) = 3)
    SELECT tool, CAST(sum(common) AS BIGINT) AS pages, round(sum(ms / pages * common), 4) AS ms FROM r JOIN f USING (file) GROUP BY tool""")
def benchmark_totals(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 3")
    results = lines.groupBy(F.concat(F.lit("t"), F.col("l_linenumber").cast("string")).alias("tool"), F.col("l_suppkey").alias("file")).agg(F.count(F.lit(1)).alias("pages_rendered"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("render_ms"))
    found = caches.common_totals(results.withColumn("error", F.lit(None).cast("string")), ["t1", "t2", "t3"])
    return found.select("tool", "pages", F.round("ms", 4).alias("ms"))


# geometry and measures


@query("""SELECT l_orderkey, min(l_quantity) AS "left", min(l_extendedprice) AS bottom, max(l_quantity + 10) AS "right", max(l_extendedprice + 5) AS top FROM lineitem GROUP BY l_orderkey""")
def box_unions(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(geometry.box_union(q, p, q + 10, p + 5).alias("b")).select("l_orderkey", "b.*")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS x, CAST(l_partkey % 100 AS DOUBLE) AS y FROM lineitem),
    n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, x ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT l_orderkey, CASE WHEN count(*) < 3 THEN 0 ELSE abs(sum(x * ny - nx * y)) / 2 END AS area, count(*) AS points FROM n GROUP BY l_orderkey""")
def polygon_areas(spark, sf_dir):
    point = F.struct("l_linenumber", "l_partkey", F.col("l_quantity").cast("long").cast("double").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y"))
    orders = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(point)).alias("p"))
    return orders.select("l_orderkey", geometry.shoelace(F.col("p")).alias("area"), F.size("p").cast("long").alias("points"))


@query("""SELECT p_partkey, p_size >= 10 AND p_size <= 30 AND p_retailprice % 100 >= 20 AND p_retailprice % 100 <= 60 AS inside, ((p_size * 45) % 360) - ((p_size * 45) % 360) % 90 AS turn FROM part""")
def boxes_and_turns(spark, sf_dir):
    area = geometry.box(F.lit(10.0), F.lit(20.0), F.lit(30.0), F.lit(60.0))
    return table(spark, sf_dir, "part").select("p_partkey", geometry.contains(area, F.col("p_size").cast("double"), F.col("p_retailprice") % 100).alias("inside"), geometry.rotation(F.col("p_size") * 45).alias("turn"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(v / 12) AS BIGINT) || ' ft ' || CAST(v % 12 AS BIGINT) || ' in' AS shown FROM (SELECT *, CAST(l_quantity AS BIGINT) * 7 AS v FROM lineitem)""")
def measured_lengths(spark, sf_dir):
    v = F.col("l_quantity").cast("long") * 7 / F.lit(12)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", measure.cascade_text(v, [(1.0, " ft"), (12.0, " in")]).alias("shown"))


@query("""SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN CAST(p_size // 8 AS VARCHAR) WHEN p_size < 8 THEN f ELSE (p_size // 8) || ' ' || f END AS shown FROM
    (SELECT *, CASE WHEN p_size % 8 = 4 THEN '1/2' WHEN p_size % 4 = 2 THEN ((p_size % 8) // 2) || '/4' ELSE (p_size % 8) || '/8' END AS f FROM part)""")
def fraction_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", measure.number_text(F.col("p_size"), 1 / 8, 8, "F").alias("shown"))


@query("""SELECT o_orderkey, 'D:' || strftime(o_orderdate, '%Y%m%d%H%M%S') || 'Z' AS written, o_orderdate AS read FROM orders""")
def dates_written_and_read(spark, sf_dir):
    w = measure.date_text(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", w.alias("written"), measure.date_read(w).alias("read"))


@query("""SELECT p_partkey, round(0.2 + power(p_size / 50.0, 2) * 0.6, 9) AS exponential, round(CASE WHEN p_size / 50.0 < 0.5 THEN 2 * (p_size / 50.0) ELSE 1 - (p_size / 50.0 - 0.5) * 2 END, 9) AS stitched,
    CASE WHEN p_size % 3 = 0 THEN 0 ELSE trunc(p_size / (p_size % 3)) END AS divided, CASE WHEN p_size > 25 THEN p_size - 25.0 ELSE 25.0 - p_size END AS folded FROM part""")
def page_functions(spark, sf_dir):
    x = F.col("p_size") / 50.0
    size = F.col("p_size").cast("double")
    same = lambda v: v
    far = [(0.0, 1000.0)]
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(calculator.exponential(x, [0.2], [0.8], 2.0)[0], 9).alias("exponential"),
        F.round(calculator.stitched(x, [same, same], [0.5], (0.0, 1.0), [(0.0, 1.0), (1.0, 0.0)]), 9).alias("stitched"),
        calculator.calculator("{ dup 3 mod idiv }", [size], far, far)[0].alias("divided"),
        calculator.calculator("{ dup 25 gt { 25 sub } { 25 exch sub } ifelse }", [size], far, far)[0].alias("folded"),
    )


@query("""SELECT p_partkey, CAST(round((1 - least(1.0, c + k)) * 255) AS INTEGER) AS r, CAST(round((1 - least(1.0, 0.25 + k)) * 255) AS INTEGER) AS g, CAST(round((1 - least(1.0, 0.5 + k)) * 255) AS INTEGER) AS b
    FROM (SELECT p_partkey, (p_size % 5) / 4.0::DOUBLE AS c, (p_size % 3) / 2.0::DOUBLE AS k FROM part)""")
def colours(spark, sf_dir):
    rgb = geometry.rgb_from_cmyk((F.col("p_size") % 5) / 4.0, F.lit(0.25), F.lit(0.5), (F.col("p_size") % 3) / 2.0)
    return table(spark, sf_dir, "part").select("p_partkey", rgb.alias("c")).select("p_partkey", "c.*")


# annotations, forms, recognition


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CASE WHEN f & 65536 <> 0 THEN 'push_button' WHEN f & 32768 <> 0 THEN 'radio' ELSE 'check_box' END WHEN 1 THEN CASE WHEN f & 131072 <> 0 THEN 'combo' ELSE 'list' END WHEN 2 THEN 'text' ELSE 'signature' END AS type
    FROM (SELECT *, p_partkey * 4096 AS f FROM part)""")
def field_types(spark, sf_dir):
    kind = F.get(F.array(F.lit("Btn"), F.lit("Ch"), F.lit("Tx"), F.lit("Sig")), F.col("p_size") % 4)
    return table(spark, sf_dir, "part").select("p_partkey", annotations.field_type(kind, F.col("p_partkey") * 4096).alias("type"))


@query("""WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 3 THEN 'removed' WHEN event_id % 4 = 0 THEN 'created' ELSE 'modified' END AS kind, value FROM events)
    SELECT user_id, event_id, value FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE kind <> 'removed'""")
def replayed_feed(spark, sf_dir):
    kind = F.when(F.col("event_id") % 4 == 3, F.lit("removed")).when(F.col("event_id") % 4 == 0, F.lit("created")).otherwise(F.lit("modified"))
    feed = table(spark, sf_dir, "events").withColumn("kind", kind)
    return annotations.applied(feed, ["user_id"], "event_id").select("user_id", "event_id", "value")


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN a OR b WHEN 1 THEN a AND b WHEN 2 THEN NOT a OR NOT b ELSE NOT a AND NOT b END AS visible, NOT a AND (b OR a) AS expression
    FROM (SELECT c_custkey, c_acctbal > 0 AS a, c_nationkey % 2 = 0 AS b FROM customer)""")
def visible_content(spark, sf_dir):
    a, b = F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0
    policy = F.get(F.array(F.lit("AnyOn"), F.lit("AllOn"), F.lit("AnyOff"), F.lit("AllOff")), (F.col("c_custkey") % 4).cast("int"))
    expression = annotations.visibility(["And", ["Not", "a"], ["Or", "b", "a"]], {"a": a, "b": b})
    return table(spark, sf_dir, "customer").select("c_custkey", annotations.membership_visible(F.array(a, b), policy).alias("visible"), expression.alias("expression"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS winner, round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 9) AS probability FROM embeddings""")
def winners(spark, sf_dir):
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", recognition.first_maximum(e).alias("winner"), F.round(recognition.winner_probability(e), 9).alias("probability"))


@query("""SELECT event_id, value FROM events WHERE value > 16 OR event_id % 20 > 16""")
def janky_frames(spark, sf_dir):
    frames = table(spark, sf_dir, "events").withColumn("raster", (F.col("event_id") % 20).cast("double"))
    return recognition.janky(frames, "value", "raster").select("event_id", "value")


@query("""SELECT conv_id, turn, text FROM conversations WHERE role IS NULL OR role IN ('user', 'system')""")
def wanted_categories(spark, sf_dir):
    return recognition.in_categories(table(spark, sf_dir, "conversations"), "role", ["user", "system"]).select("conv_id", "turn", "text")


@query("""SELECT conv_id AS doc_id, count(*) AS n, string_agg(turn || ':' || text, '|' ORDER BY turn, text) AS texts FROM conversations GROUP BY doc_id""")
def context_pages(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text")
    none = turns.limit(0).select("doc_id", F.lit("").alias("name"), F.lit("").alias("type"), F.lit("").alias("value"))
    held = annotations.document_context(turns, none, "doc_id")
    listed = F.from_json("context", "pages array<struct<page_index:long,text:string>>")["pages"]
    return held.select("doc_id", F.size(listed).cast("long").alias("n"), F.array_join(F.transform(listed, lambda x: F.concat(x["page_index"].cast("string"), F.lit(":"), x["text"])), "|").alias("texts"))


@query("""SELECT conv_id AS doc_id, 'Pages: ' || count(*) || chr(10) || string_agg('Page ' || (turn + 1) || ':' || chr(10) || text, chr(10) ORDER BY turn, text) AS prompt FROM conversations GROUP BY conv_id""")
def prompt_reports(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), "text")
    return annotations.prompt_text(turns, "doc_id")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM g)
    SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, part""")
def idle_sessions(spark, sf_dir):
    return changes.sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "30 minutes")
