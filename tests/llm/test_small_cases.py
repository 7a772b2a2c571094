"""Each operator against brute force on small fixtures with nulls, blanks, ties, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from folioflow.llm import queries as registered  # noqa: E402
from folioflow.llm.ann import VantageTree, nearest_neighbours  # noqa: E402
from folioflow.llm.bpe import LEAF_BYTES, Encoder, bpe_encode_decode  # noqa: E402
from folioflow.llm.elias_fano import EliasFano, read_token_files, write_token_files  # noqa: E402
from folioflow.llm.lm import score_documents  # noqa: E402
from folioflow.llm.mixing import Mix, apportioned, mix_documents, mix_report  # noqa: E402
from folioflow.llm.ngram_join import keep_one_of_each, similar_documents  # noqa: E402
from folioflow.llm.quality import QualityRules, chi2_cdf, chi2_quantile, cutoff, quality_filter, quality_report  # noqa: E402
from folioflow.llm.sharding import extendible_shards  # noqa: E402
from folioflow.llm.substring import substring_dedup  # noqa: E402
from folioflow.llm.warc import read_archives, write_archives  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, mix_key string, size int"
VOCABULARY = public.path("word_bpe_49k.json")


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    base = prose(rng, 120)
    passage = prose(rng, 60)
    for i in range(60):
        text = prose(rng, rng.randint(20, 200))
        if i % 9 == 3:
            text = base
        if i % 9 == 5:
            words = base.split()
            words[rng.randrange(120)] = "changed"
            text = " ".join(words)
        if i % 9 == 7:
            text = prose(rng, 30) + "\n" + passage + " " + prose(rng, 30)
        out.append((i, text, ["en", "de", None][i % 3], ["a", "b", "c", None][i % 4], len(text)))
    out += [(60, None, "en", "a", None), (61, "", "en", "a", 0), (62, " \n\t ", None, None, 4), (None, base, "en", "b", 1), out[4], out[4], (63, "a b", "en", "a", 3), (64, "a b", "en", "a", 3)]
    return [(*r, "x", "y", 7) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe(docs, rows, empty):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    got = Counter((r.doc_id, tuple(r.token_ids), r.decoded) for r in bpe_encode_decode(docs, VOCABULARY, columns=["doc_id"]).collect())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[(r[0], tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert bpe_encode_decode(empty, VOCABULARY).count() == 0
    clash = docs.withColumn("Token_IDs", F.lit(1))
    assert "Token_IDs" not in bpe_encode_decode(clash, VOCABULARY).columns


def test_long_unsplit_text_and_plain_chunks():
    encoder, rng = Encoder(VOCABULARY), random.Random(1)
    library = encoder.tokenizer
    for _ in range(200):
        alphabet = rng.choice(["ab", "abcdefghij", "théñ", "a", "日本", "!?."])
        piece = library.pre_tokenizer.pre_tokenize_str("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 300))))[0][0]
        assert encoder.tree(piece, leaf=rng.choice([2, 3, 7, 30])) == encoder.model_only.encode(piece).ids
    for text in ["a" * 9000 + "<|endoftext|>" + "b!" * 3000 + " it's É é \x1c ok", "İstanbul ΑΣ ß 1234", "don't<|startoftext|>x"]:
        (ids,) = encoder.encode([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    # merging by rank agrees with merging by pairs because every token's text encodes to that token
    whole = [t for t in encoder.tokens[:49406] if t.endswith("</w>")]
    assert all(len(e.ids) == 1 for e in encoder.model_only.encode_batch([t.removesuffix("</w>") for t in whole]))


def test_tree_concatenation_of_long_texts(spark):
    encoder, rng = Encoder(VOCABULARY), random.Random(2)
    library = encoder.tokenizer
    signs = "abcXYZ  \n\t'éÉñ1%<|日é   \x1c\x85"
    for k in range(60):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 9000)))
        text = text.replace("%", "<|endoftext|>") if k % 3 == 0 else text
        text = text.replace(" ", "") if k % 5 == 0 else text
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    before = encoder.joins
    long = [prose(rng, 20_000), "x y " + "abcdefg" * 150_000 + " end", "Ti wh, " * 3000, "\n" * 5000 + "a" + " " * 5000]
    got = encoder.encode([t.encode() for t in long])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in long]
    assert encoder.joins >= before + len(long[0]) // LEAF_BYTES - 1  # one less than leaves


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, most in [(0, 1), (1, 0), (1, 10**12), (5000, 4), (5000, 10**9), (1500, 1500)]:
        numbers = np.sort(rng.integers(0, most + 1, n))
        data = EliasFano.pack(numbers)
        held = EliasFano(data)
        for a, b in [(0, n), (n // 2, n // 2 + 1), (n - 1, n + 5), (700, 1400)]:
            assert held.select(a, b).tolist() == numbers[max(0, a) : min(n, b)].tolist()
    assert len(EliasFano.pack(np.arange(0, 10**6, 100))) < 10**4 * 1.3 + 100


def test_token_files(spark, docs, rows, empty):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    got = [(r.doc_id, r.start, bytes(r.ids)) for r in read_token_files(spark, write_token_files(docs, VOCABULARY, end_id=1)).collect()]
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sorted(got, key=lambda g: g[1]) == want
    manifest = write_token_files(docs, VOCABULARY, end_id=1, file_bytes=2000)
    assert len(manifest) > 5  # in several files, with the same numbers
    assert sorted(((r.doc_id, r.start, bytes(r.ids)) for r in read_token_files(spark, manifest).collect()), key=lambda g: g[1]) == want
    assert read_token_files(spark, write_token_files(empty, VOCABULARY, end_id=1)).count() == 0


def kept_words(rows, length):
    first = {}
    for r in rows:
        words = (r[1] or "").split()
        for k in range(len(words) - length + 1):
            w = tuple(words[k : k + length])
            if r[0] is not None:
                first[w] = min(first.get(w, r[0]), r[0])
    out = []
    for r in rows:
        words = (r[1] or "").split()
        gone = set()
        for k in range(len(words) - length + 1):
            if r[0] is not None and first[tuple(words[k : k + length])] < r[0]:
                gone.update(range(k, k + length))
        out.append((r[0], len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return Counter(out)


@pytest.mark.parametrize("held", [True, False])
def test_substring_dedup(docs, rows, empty, monkeypatch, held):
    from folioflow.llm import substring

    if not held:
        monkeypatch.setattr(substring, "MOST_HELD", -1)
        monkeypatch.setattr(substring, "MOST_SENT", -1)
    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in substring_dedup(docs, 50).collect())
    assert got == kept_words(rows, 50)
    if held:
        assert substring_dedup(empty, 50).count() == 0


@pytest.mark.parametrize(("held", "segment", "shard", "served"), [(True, 2048, 64, 1024), (False, 2048, 64, 1024), (True, 30, 3, 5)])
def test_substring_dedup_of_unlike_texts_under_one_id(spark, monkeypatch, held, segment, shard, served):
    from folioflow.llm import substring

    for name, value in ({"SEGMENT": segment, "SHARD": shard, "SERVED": served} | ({} if held else {"MOST_HELD": -1, "MOST_SENT": -1})).items():
        monkeypatch.setattr(substring, name, value)
    rng = random.Random(8)
    a, b, c, d = prose(rng, 70), prose(rng, 70), prose(rng, 400), prose(rng, 90)
    rows = [(1, a), (5, a), (5, b), (5, b), (5, f"{b} {a}"), (3, f"{d} {c} {d}"), (9, f"{d} x {a} y {b} {c}"), (9, d), (None, c), (2, f"{c} {c}"), (2, None), (7, b), (7, f"{b} x")]
    rows += [(i, " ".join(rng.sample([a, b, c, d], 3))) for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in substring_dedup(docs, 50).collect())
    assert got == kept_words(rows, 50)
    from corpus_pipeline import repeated_passages

    staged = repeated_passages(spark, docs.selectExpr("*", "'en' AS lang", "'a' AS source", "length(text) AS n_chars"), "")
    left = Counter((r.doc_id, " ".join((r.text or "").split())) for r in staged.collect())
    assert left == Counter((i, t) for i, words, gone, t in kept_words(rows, 50).elements() if gone == 0 or gone < words)


def test_automaton_knows_the_least_document_of_each_run():
    from folioflow.llm.substring import SuffixAutomaton

    rng = random.Random(6)
    for _ in range(200):
        runs = [(rng.randrange(9), [rng.choice("abc") for _ in range(rng.randint(1, 12))]) for _ in range(rng.randint(1, 6))]
        automaton = SuffixAutomaton()
        for doc, words in runs:
            automaton.add(words, doc)
        automaton.finish()
        own, least, doc = [rng.choice("abc") for _ in range(12)], rng.randint(1, 4), rng.randrange(10)
        covered = set()
        for i in range(len(own) - least + 1):
            if any(other < doc and words[k : k + least] == own[i : i + least] for other, words in runs for k in range(len(words) - least + 1)):
                covered.update(range(i, i + least))
        assert {k for x, y in automaton.spans(own, least, doc) for k in range(x, y)} == covered


def links_of(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    n = len(rows)
    near = [[j for j in range(n) if j != i and rows[i][0] is not None and rows[j][0] is not None and sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        label = [min([label[i], *(label[j] for j in near[i])], key=lambda k: rows[k][0] if rows[k][0] is not None else 1 << 60) for i in range(n)]
    return [(r[0], rows[label[i]][0] if r[0] is not None else None, len(near[i])) for i, r in enumerate(rows)]


def test_ngram_join(docs, rows, empty, monkeypatch):
    want = Counter(links_of(rows))
    assert Counter(tuple(r) for r in similar_documents(docs).select("doc_id", "class_id", "n_links").collect()) == want
    from folioflow.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # groups over several blocks
    monkeypatch.setattr(ngram_join, "MOST_SENT", -1)
    monkeypatch.setattr(ngram_join, "MOST_BYTES", -1)
    assert Counter(tuple(r) for r in similar_documents(docs).select("doc_id", "class_id", "n_links").collect()) == want
    assert similar_documents(empty).count() == 0
    left = keep_one_of_each(docs)
    assert left.columns == docs.columns
    ids = sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x))
    assert ids == sorted({(r[0]) for r in want if r[0] is None or r[0] == r[1]}, key=lambda x: (x is None, x))


def near_copies(rng, n, most):
    """Copies of one text with up to ``most`` words changed, some of which change alike, and what else shares its buckets."""
    base = prose(rng, 100).split()
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(100)
            words[at] = f"new{rng.randrange(3) if rng.random() < 0.5 else i}"
        out.append((i, " ".join(words), "en", "a", 0, "x", "y", 7))
    return out


def test_ngram_join_in_a_large_group(spark, monkeypatch):
    from folioflow.llm import ngram_join

    made = near_copies(random.Random(5), 150, 4)
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    got = Counter(tuple(r) for r in similar_documents(spark.createDataFrame(made, SCHEMA)).select("doc_id", "class_id", "n_links").collect())
    assert got == Counter(links_of(made))


def test_ngram_join_rows_grow_with_the_group(spark, monkeypatch):
    from folioflow.llm import ngram_join

    whole, made = ngram_join.dealt, {}

    def counted(members, group, key):
        out = whole(members, group, key)
        made[n] = made.get(n, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "dealt", counted)
    for n in (400, 1600):
        docs = spark.createDataFrame(near_copies(random.Random(n), n, 1), SCHEMA)
        assert similar_documents(docs).filter(f"n_links <> {n - 1}").count() == 0
    assert made[1600] <= 5 * max(made[400], 400)


def test_keep_one_of_rows_that_share_an_id(spark):
    rng = random.Random(12)
    one, other = prose(rng, 80), prose(rng, 80)
    made = [(1, one), (2, one + " end"), (2, other), (3, other), (3, None), (4, "")]
    docs = spark.createDataFrame([(*r, "en", "a", 0, "x", "y", 7) for r in made], SCHEMA)
    left = Counter((r.doc_id, r.text) for r in keep_one_of_each(docs.union(docs.filter("doc_id = 1"))).collect())
    assert left == Counter([(1, one), (2, other), (3, None), (4, "")])


def naive_seats(votes: list[int], seats: int) -> list[int]:
    """Highest quotients, one seat after another; ties to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_quotas_are_those_of_highest_quotients(spark):
    rng = random.Random(9)
    groups = {g: [rng.choice([0, 5, 5, rng.randrange(1, 4000)]) for _ in range(rng.randint(1, 12))] + [3] for g in range(40)}
    parties = [(g, i, v, 7 * g + 1) for g, votes in groups.items() for i, v in enumerate(votes)]
    table = spark.createDataFrame(parties, "grp long, party long, votes long, due long")
    got = {(r.grp, r.party): r.quota for r in apportioned(table, ["grp"], "party", "votes", F.col("due")).collect()}
    assert got == {(g, i): n for g, votes in groups.items() for i, n in enumerate(naive_seats(votes, 7 * g + 1))}


def test_shards_share_their_source_by_highest_quotients(spark, monkeypatch, tmp_path):
    from folioflow.llm import mixing

    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", "abcd"[min(3, i % 7)], 0) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    docs, mix = spark.read.parquet(f"{tmp_path}/docs"), Mix(block_words=8)
    plain = {n: n for n in ("size", "key", "rank")} | {"id": "doc_id"}
    sizes = mixing.written(mixing.measured(docs, "text", "source", mix, plain).select("source", "key", "rank", "size"), "sizes")
    known, plan = mixing.shard_plan(sizes, mix)
    known, plan = {r.key: r for r in known.collect()}, sorted(plan.collect(), key=lambda r: (r.key, r.shard))
    seats = round(sum(r.source_size for r in known.values()) / 8)
    order = sorted(known)
    assert [known[k].source_quota for k in order] == naive_seats([Fraction(known[k].target) for k in order], seats)
    for k in order:
        own = [r for r in plan if r.key == k]
        assert len(own) > 2 and [r.quota for r in own] == naive_seats([r.words for r in own], known[k].source_quota)
    taken = Counter()
    for r in mixing.mix_documents(docs, mix=mix).collect():
        taken[r.doc_id] += len(r.text.split())
    assert +taken == +Counter({r.doc_id: r.taken for r in mix_report(docs, mix=mix).collect()})
    for least in (-1, 10**6):
        monkeypatch.setattr(mixing, "MOST_SENT", least)
        assert Counter(map(tuple, mixing.mix_documents(docs.union(docs), mix=mix).collect())).total() > 400


def test_mixing(spark, docs, rows, empty, tmp_path):
    mix = Mix(block_words=8)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = mix_report(docs, mix=mix).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight, target, total = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    free, rest = set(order), float(total)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3.0 * sizes[s] for s in over)
        free -= over
    source = defaultdict(set)
    for r in rows:
        source[r[0]].add(r[3])
    taken = defaultdict(int)
    for r in got:
        (own,) = source[r.doc_id]
        assert r.source_size == sizes[own] and r.target == pytest.approx(target[own]) and 0 <= r.taken <= 3 * r.size
        taken[own] += r.taken
    assert all(abs(taken[s] - target[s]) <= 8 for s in order)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mix_report(docs.repartition(5), mix=mix).collect()))
    told = mix_documents(docs, mix=mix)
    assert told.columns == docs.columns
    words = Counter()
    for r in told.collect():
        words[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in got:
        want[r.doc_id] += r.taken
    assert +words == +want
    assert mix_report(empty).count() == 0 and mix_documents(empty).count() == 0


def base_statistics(text):
    words = (text or "").split()
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    covered = {k for i, g in enumerate(grams) if g in twice for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, rows, empty):
    rng = random.Random(8)
    more = [(1000 + i, prose(rng, rng.randint(50, 300)), "en", "big", 0, "x", "y", 7) for i in range(150)]
    junk = [(2000 + i, " ".join(w + "%%%" for w in prose(rng, 80).split()), "en", "big", 0, "x", "y", 7) for i in range(8)]
    repeat = [(3000, "one two three four five six\n" * 9, "en", "big", 0, "x", "y", 7), (3001, "five words in a row " * 2 + prose(rng, 60), "en", "big", 0, "x", "y", 7)]
    every = spark.createDataFrame([*rows, *more, *junk, *repeat], SCHEMA)
    texts = {r[0]: r[1] for r in [*rows, *more, *junk, *repeat]}
    got = quality_report(every).collect()
    for r in got:
        stats = base_statistics(texts[r.doc_id])
        assert tuple(r)[1:6] == stats
        assert r.base_failed == (stats[0] < 10 or 100 * stats[4] > 20 * stats[0])
    verdicts = {r.doc_id: r.kept for r in got}
    assert all(verdicts[r[0]] for r in more) and not any(verdicts[r[0]] for r in junk) and not verdicts[3000]
    left = quality_filter(every)
    assert left.columns == every.columns and Counter(r.doc_id for r in left.collect()) == Counter(r.doc_id for r in got if r.kept)
    assert quality_report(empty).count() == 0 and quality_filter(empty).count() == 0
    assert chi2_cdf(chi2_quantile(0.75, 5), 5) == pytest.approx(0.75) and cutoff(QualityRules(tail=0.01)) == pytest.approx(chi2_quantile(0.99, 5), rel=0.01)


def test_quality_rules_reject_repeated_lines_and_words(spark):
    rng = random.Random(9)
    clean = [(i, prose(rng, rng.randint(150, 300)), "en", "big", 0, "x", "y", 7) for i in range(150)]
    menu = "\n".join(f"item{i} price{i}\nAdd to cart" for i in range(40))
    passage = prose(rng, 19)
    twice = f"{passage} {prose(rng, 81)} {passage} {prose(rng, 81)}"
    df = spark.createDataFrame([*clean, (500, menu, "en", "big", 0, "x", "y", 7), (501, twice, "en", "big", 0, "x", "y", 7)], SCHEMA)
    got = {r.doc_id: r for r in quality_report(df).collect()}
    assert not got[500].base_failed and got[500].n_dup_lines == 39 and not got[500].kept
    assert not got[501].base_failed and got[501].n_repeat_words == 38 and not got[501].kept
    assert all(got[r[0]].kept for r in clean)


def brute_neighbours(rows, asked, k):
    """Of each row that is asked for, its id and the k best others; ties to the smaller id."""
    found = Counter()
    for q, (name, v) in enumerate(rows):
        if asked(name):
            scores = [(-round(float((np.array(v) * np.array(w)).sum()), 9), other) for i, (other, w) in enumerate(rows) if i != q]
            found[(name, tuple(i for _, i in sorted(scores)[:k]))] += 1
    return found


def found_neighbours(df, k, **options):
    by = defaultdict(list)
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=k, **options).orderBy("query_id", "rank").collect():
        by[r.query_id].append(r.vec_id)
    return by


def test_nearest_neighbours(spark, monkeypatch):
    from folioflow.llm import ann

    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(700, 8))
    vectors[100:140] = vectors[100]  # ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    bad = [(700, None), (701, [0.0] * 8), (702, [float("nan")] + [1.0] * 7), (703, [None] + [1.0] * 7), (704, [float("inf")] + [1.0] * 7), (705, []), (706, [1.0, 2.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame([(*r, 7, "x") for r in [*rows, *bad]], "vec_id long, embedding array<double>, row int, dims string")
    want = brute_neighbours(rows, lambda i: i % 20 == 0, 5)
    assert Counter((q, tuple(ids)) for q, ids in found_neighbours(df, 5).items()) == want
    monkeypatch.setattr(ann, "SHARD_BYTES", 64 * 8 * 8)  # several shards, and trees of several pieces
    assert Counter((q, tuple(ids)) for q, ids in found_neighbours(df, 5).items()) == want
    assert nearest_neighbours(df.limit(0), k=5).count() == 0
    score = nearest_neighbours(df, F.col("vec_id") == 20, k=1).first()
    assert score.score == pytest.approx(float(vectors[20] @ vectors[score.vec_id]), abs=1e-12)


def test_nearest_neighbours_with_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [9.0, 0.0]), (0, [2.0, 0.0]), (3, [4.0, 1.0]), (3, [4.0, 1.0])], "vec_id long, embedding array<double>")
    got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest_neighbours(df, F.col("vec_id") == 0, k=3).collect())
    assert got == Counter([(0, 1, 1, 9.0), (0, 2, 1, 5.0), (0, 3, 3, 4.0), (0, 1, 1, 18.0), (0, 2, 1, 10.0), (0, 3, 3, 8.0)])


def test_vantage_trees_prune(spark, monkeypatch):
    from folioflow.llm import ann

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 16))
    vectors = centres[rng.integers(0, 60, 6000)] + 0.05 * rng.normal(size=(6000, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    ids, asked = np.arange(6000), np.arange(0, 6000, 20)
    tree = VantageTree.build(ids, ids, vectors)
    assert len(tree.nodes) > 100  # several levels
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    want = np.argsort(-scores, axis=1)[:, :10]
    seen = []
    for factor, recall in ((1.0, 1.0), (0.7, 0.9), (0.5, 0.9)):
        tree.seen = 0
        got, _ = tree.search(asked, vectors[asked], 10, factor)
        seen.append(tree.seen / (6000 * len(asked)))
        assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(got, want, strict=True)]) >= recall
    assert seen[0] < 0.5 and seen == sorted(seen, reverse=True) and seen[2] < seen[0]
    monkeypatch.setattr(ann, "SHARD_BYTES", 500 * 16 * 8)
    visits = []
    whole = ann.Index.search
    monkeypatch.setattr(ann.Index, "search", lambda self, some, *more: (visits.append(some.count()), whole(self, some, *more))[1])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = found_neighbours(df, 10)
    assert all(set(got[q]) == set(w.tolist()) for q, w in zip(asked.tolist(), want, strict=True))
    assert sum(visits) < 0.7 * len(asked) * 16


@pytest.mark.parametrize("held", [True, False])
def test_lm_scoring(docs, rows, empty, monkeypatch, held):
    from folioflow.llm import lm

    if not held:
        monkeypatch.setattr(lm, "MOST_HELD", -1)
    train = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
    for r in rows:
        if not out(r[0]):
            train.update([*lower(r[1]), None])
    total, types = sum(train.values()), len(train)
    texts = {r[0]: r[1] for r in rows}
    got = score_documents(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        tokens = [*lower(texts[r.doc_id]), None]
        base = sum(np.log10((train[t] + 0.5) / (total + 0.5 * (types + 1))) for t in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(tokens), sum(train[t] > 0 for t in tokens), total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    if held:
        again = {r.doc_id: r.score for r in score_documents(docs.repartition(5)).collect()}
        assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-3, abs=0.5) for r in got)
        assert score_documents(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    """Over all tokens after one context, decisions and shares make a distribution."""
    from folioflow.llm import lm

    rng = np.random.default_rng(2)
    hashes = lm.mixed(np.arange(1, 4000, dtype=np.uint64))
    counts = rng.integers(1, 50, len(hashes))
    totals = np.bincount(lm.bucket_of(hashes), weights=counts, minlength=1 << lm.BITS)
    share = counts / totals[lm.bucket_of(hashes)]
    filled = np.bincount(lm.bucket_of(hashes), weights=share, minlength=1 << lm.BITS)
    assert np.allclose(filled[totals > 0], 1)
    nodes, went = lm.decisions(hashes)
    assert (nodes[:, 0] == 1).all() and (nodes < 1 << lm.BITS).all()
    assert ((nodes[:, :-1] * 2 + went[:, :-1]) == nodes[:, 1:]).all()


def test_lm_contexts_grow_with_the_corpus(spark):
    """Words that come nine times among 600,000 tell their followers, and counts along paths are those of all training texts."""
    from folioflow.llm import lm

    rng = np.random.default_rng(6)
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    ids, held = [i for i in range(4000) if not out(i)], [i for i in range(4000) if out(i)]
    told = " ".join(f"a{i}zz b{i}zz" for i in range(40))
    train = [(i, told if k < 9 else " ".join(f"w{x}zz" for x in rng.integers(0, 50_000, 600))) for k, i in enumerate(ids[:1009])]
    other = " ".join(f"a{i}zz b{(i + 7) % 40}zz" for i in range(40))
    rows = [*train, (held[0], told), (held[1], other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    score = {r.doc_id: r.score for r in score_documents(df).collect()}
    assert score[held[0]] - score[held[1]] > 40
    assert lm.bits_for(8 << 14) == 14 and lm.bits_for(1) == lm.BITS

@pytest.mark.parametrize("most", [300, 7_000_000_000])
def test_lm_paths_keep_counts_of_any_size(most):
    from folioflow.llm import lm

    rng = np.random.default_rng(6)
    pairs = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64) >> np.uint64(47))
    pairs, times = np.unique(pairs, return_counts=True)
    times[3], times[9] = 100_000, most
    again = lm.unpacked_pairs(lm.packed_pairs(pairs, times), len(pairs))
    assert (again[0] == pairs).all() and (again[1] == times).all()
    along = lm.paths(pairs, times, 12)
    for k in range(14):
        group = pairs >> np.uint64(13 - k)
        assert all(along[k, i] == times[group == group[i]].sum() for i in range(0, len(pairs), 50))
    some = np.flatnonzero(rng.random(len(pairs)) < 0.5)
    assert (lm.unpacked_paths(lm.packed_paths(pairs[some], along[:, some], 12), pairs[some], 12) == along[:, some].T).all()


def test_sharding(spark, docs, rows, empty):
    big = spark.createDataFrame([*rows, (99, "x" * 9000, "en", "a", 0, "x", "y", 7)] + [(77, "same key " * 40, "en", "a", 0, "x", "y", 7)] * 12, SCHEMA)
    got = extendible_shards(big, 2000).collect()
    assert len(got) == len(rows) + 13
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    count = Counter(r.shard for r in got)
    assert all(n <= 2000 or count[s] == 1 for s, n in sizes.items()) and all(sizes[r.shard] == r.shard_bytes for r in got)
    names = sorted({r.shard.split("+")[0] for r in got})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    parents = Counter()
    for r in got:
        if r.depth:
            parents[(r.depth - 1, r.prefix >> 1)] += 0
    for (depth, prefix) in parents:
        assert sum(r.n_bytes for r in got if r.depth > depth and r.prefix >> (r.depth - depth) == prefix) > 2000
    assert extendible_shards(empty, 2000).count() == 0


def test_archives(spark):
    long = "<p>" + "word " * 400
    rows = [(1, "http://a/ b", long), (2, "u", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (None, "u", long), (8, "ü\r\nx", "é" * 900)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in read_archives(spark, write_archives(df)).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        revisit = html == long and page != 3
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 3) if revisit else ("response", None))
        assert (got[page].payload is None) == revisit and (revisit or bytes(got[page].payload) == body)
    assert read_archives(spark, write_archives(df.limit(0))).count() == 0


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registered.QUERIES) == list(range(1, 14))
