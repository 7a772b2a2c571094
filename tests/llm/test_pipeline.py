"""The stages in order over a small table, each held against what it must keep."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(rng.randint(60, 200)) for _ in range(100)]
    passage = prose(70)
    texts[10], texts[20] = texts[5], texts[5] + " more"
    texts[30], texts[31] = prose(60) + " " + passage + " " + prose(60), prose(60) + " " + passage + " " + prose(60)
    texts[40] = " ".join(w + "%%%" for w in prose(80).split())
    texts[41], texts[42] = "too short", None
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"{i}"))
        docs = spark.read.parquet(str(tmp_path / f"{i}"))
        kept.append({r.doc_id: r.text for r in docs.collect()})
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
    assert set(range(100)) - set(kept[0]) == {40, 41, 42}
    assert set(kept[0]) - set(kept[1]) == {10, 20}
    assert set(kept[1]) == set(kept[2]) and passage in kept[2][30] and passage not in kept[2][31] and len(kept[2][31].split()) == 120
    assert set(kept[3]) <= set(kept[2]) and set(kept[4]) == set(kept[3])
    assert all(r.n_tokens == len(r.token_ids) > 0 for r in docs.collect())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words int, similar_id string, token_ids string"


def test_run_on_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, prose(rng.randint(80, 160)), ["en", None][i % 2], ["a", "b", None][i % 3], 1, 7, "x", "y") for i in range(30)]
    long = prose(60_000)
    rows += [rows[3], rows[3], (40, None, "en", "a", None, 7, "x", "y"), (41, " ", None, None, 1, 7, "x", "y"), (42, long, "en", "a", len(long), 7, "x", "y"), (None, prose(90), "en", "b", 1, 7, "x", "y")]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in got}
    assert ids <= {r[0] for r in rows} and not ids & {40, 41} and None in ids and len(ids) >= 28
    assert all(r.n_tokens == len(r.token_ids) for r in got)
    whole = {r[0]: r[1] for r in rows}
    assert all(set(r.text.split()) <= set(whole[r.doc_id].split()) for r in got)


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"token_ids", "n_tokens", "decoded"} <= set(out.columns)
