import pytest
from pyspark.sql import functions as F

from folioflow.functions import measure
from folioflow.functions import text as texts
from folioflow.operators import search


@pytest.fixture(scope="module")
def page(spark):
    return spark.createDataFrame([(0, "Hello, world!")], "page int, text string")


@pytest.mark.parametrize(("query", "options", "found"), [("world", {}, 1), ("HELLO", {}, 1), ("HELLO", {"case_sensitive": True}, 0), ("wor", {"whole_word": True}, 0), ("world", {"whole_word": True}, 1), ("", {}, 0)])
def test_literal_search(page, query, options, found):
    assert search.find_literal(page, query, **options).count() == found


@pytest.mark.parametrize(("pattern", "found"), [(r"w\w+d", 1), ("[", 0), ("x*", 0)])
def test_regex_search(page, pattern, found):
    assert search.find_regex(page, pattern).count() == found


def test_rejected_whole_words_still_take_their_place(spark):
    df = spark.createDataFrame([("ba a a",)], "text string")
    assert search.find_literal(df, "a a", whole_word=True).count() == 0


def test_offsets_and_snippets(spark):
    df = spark.createDataFrame([("one\nthe  quick brown fox jumps over the lazy dog and runs away from the other animals of the wood\nend",)], "text string")
    rows = search.with_snippets(search.find_literal(df, "runs", with_text=True, lines=search.SNIPPET)).collect()
    body = rows[0].text
    assert body[rows[0].start : rows[0].end] == "runs" and rows[0].match_text == "runs"
    assert rows[0].prefix.startswith("… ") and rows[0].suffix == " away from the other animals of the wood"


def test_tokens_have_their_places(spark):
    body = "  ab\tc\n\n def "
    df = spark.createDataFrame([(1, body), (2, ""), (3, "x")], "id int, text string")
    rows = search.tokens(df).orderBy("id", "token_index").collect()
    assert [(r.id, r.token) for r in rows] == [(1, "ab"), (1, "c"), (1, "def"), (3, "x")]
    assert all({1: body, 3: "x"}[r.id][r.start : r.end] == r.token for r in rows)


@pytest.mark.parametrize(("words", "most"), [(20_000, 1 << 16), (200_000, 1 << 16), (3_000, 7)])
def test_long_texts(spark, words, most, monkeypatch):
    monkeypatch.setattr(search, "MOST_PLACES", most)
    bodies = {i: " ".join(f"w{k % 97}İ" if k % 5 == i else f"word{k % 13}" for k in range(words)) for i in range(3)} | {3: "", 4: None, 5: "word1"}
    df = spark.createDataFrame(list(bodies.items()), "id int, text string")
    got = search.tokens(df).select("id", "token_index", "token", "start", "end").collect()
    assert len(got) == 3 * words + 1
    for r in got if words < 50_000 else got[:: words // 100]:
        assert bodies[r.id][r.start : r.end] == r.token
    hits = search.find_literal(df, "word1", whole_word=True).groupBy("id").count().collect()
    assert {r.id: r["count"] for r in hits} == {i: b.split().count("word1") for i, b in bodies.items() if b and "word1" in b.split()}
    found = search.find_regex(df, "word1[0-2]?", with_text=True).filter("id = 0").selectExpr("substr(text, start + 1, end - start) AS m").groupBy("m").count().collect()
    assert {r.m: r["count"] for r in found} == {w: bodies[0].split().count(w) for w in ("word1", "word10", "word11", "word12")}


def test_lines_around_matches(spark):
    import random

    rng = random.Random(3)
    bodies = ["".join(rng.choice("ab \nx") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(bodies)), "id int, text string")
    for r in search.find_literal(df, "x", with_text=True, lines=(5, 7)).collect():
        line_start = r.text.rfind("\n", 0, r.start) + 1
        line_end = (r.text + "\n").find("\n", r.end)
        low, high = max(line_start, r.start - 5), min(line_end, r.end + 7)
        assert (r.before, r.match_text, r.after, r.cut_before, r.cut_after) == (r.text[low : r.start], "x", r.text[r.end : high], low > line_start, high < line_end)


def test_strings_and_keys(spark):
    df = spark.createDataFrame([("naïve",), ("→ far",), ("",)], "t string")
    back = df.select("t", texts.decoded(texts.encoded(F.col("t"))).alias("b")).collect()
    assert all(r.t == r.b for r in back)

    def key(data: bytes) -> str:
        h = 0x811C9DC5
        step = 1 if len(data) <= 4096 else len(data) // 4096
        for b in [*len(data).to_bytes(4, "little"), *data[::step]]:
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        return f"{h:x}"

    blobs = [b"", b"abc", bytes(range(256)) * 40]
    rows = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(blobs)], "i int, d binary").select("i", texts.content_key(F.col("d")).alias("k")).orderBy("i").collect()
    assert [r.k for r in rows] == [key(b) for b in blobs]


def test_measures(spark):
    df = spark.range(1)
    show = lambda c: df.select(c.alias("x")).first().x
    assert show(measure.number_text(F.lit(1234.5), 1.0, 100)) == "1,234.5"
    assert show(measure.number_text(F.lit(2.999), 1.0, 100, "T")) == "2.99"
    assert show(measure.number_text(F.lit(0.75), 1.0, 16, "F")) == "3/4"
    assert show(measure.number_text(F.lit(1.999), 1.0, 8, "F")) == "2"
    assert show(measure.number_text(F.lit(-3.0), 1.0, 1, unit="m")) == "-3 m"
    assert show(measure.cascade_text(F.lit(5.5), [(1.0, " ft"), (12.0, " in")])) == "5 ft 6 in"
    assert str(show(measure.date_read(F.lit("D:20240102030405+01'00'")))) == "2024-01-02 02:04:05"
    assert show(measure.date_read(F.lit("nonsense"))) is None
    assert show(texts.joined_lines(F.array(F.lit("para-"), F.lit("graph text")))) == "paragraph text"
