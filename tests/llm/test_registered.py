"""The registered queries on small written tables against brute force: nulls, blanks, ties, repeated rows, a very long text, extra columns with clashing names, and empty tables."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from folioflow.llm.queries import QUERIES  # noqa: E402
from tests.llm.test_small_cases import base_statistics, kept_words, links_of, prose  # noqa: E402

VOCABULARY = public.path("word_bpe_49k.json")
#: Columns beside those of the tables, named like columns that the operators make.
CLASHING = ("n_words", "node", "label", "rank", "score", "part", "ids", "shard", "row", "text_key", "kept", "target")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    base, passage = prose(rng, 120), prose(rng, 60)
    out = []
    for i in range(24):
        text = prose(rng, rng.randint(12, 160))
        if i % 6 == 2:
            text = base
        if i % 6 == 3:
            text = " ".join("changed" if k == i else w for k, w in enumerate(base.split()))
        if i % 6 == 4:
            text = f"{prose(rng, 20)}\n{passage}  {prose(rng, 20)} #% 日本 É"
        out.append((i, text, "en", ["a", "b", None][i % 3], len(text)))
    long = prose(rng, 200_000)
    return [*out, (24, None, "en", "a", None), (25, "", None, "b", 0), (26, " \n\t ", "de", None, 4), (27, long, "en", "a", len(long)), (28, f"{long} end", "en", "b", len(long) + 4), (29, "a b", "en", "a", 3), (30, "a b", "en", "a", 3), out[5], out[5]]


def talks():
    rng = random.Random(31)
    out = [(c, t if rng.random() < 0.95 else None, rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), rng.choice(["Yes.", "no", "", None, " \n", f"Line {t}.", "x" * 5000])) for c in range(60) for t in range(rng.randint(1, 9))]
    return [*out, *((None, t, "user", "a.") for t in range(3)), out[4], out[4], out[9]]


def written(folder, name, columns: dict, n: int) -> None:
    extra = {c: pa.array(["x"] * n, pa.string()) for c in CLASHING}
    pq.write_table(pa.table(extra | columns), f"{folder}/{name}.parquet", row_group_size=max(1, n // 3 or 1))


@pytest.fixture(scope="module")
def tables(tmp_path_factory, rows):
    folder = tmp_path_factory.mktemp("tables")
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    written(folder, "documents", {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(types.items())}, len(rows))
    vectors = np.random.default_rng(5).normal(size=(90, 6)).round(2).tolist()
    vectors[7] = vectors[3]
    ids = [*range(90), 40, 7, 91, 92, None]
    vectors += [vectors[40], vectors[7], None, [0.0] * 6, vectors[1]]
    labels = [None if i % 9 == 8 else i % 3 for i in range(len(ids))]
    written(folder, "embeddings", {"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array(labels, pa.int32())}, len(ids))
    talk = talks()
    written(folder, "conversations", {c: pa.array([r[i] for r in talk], t) for i, (c, t) in enumerate({"conv_id": pa.int64(), "turn": pa.int64(), "role": pa.string(), "text": pa.string()}.items())}, len(talk))
    big = "<p>é" + "x" * 1200
    html = ["<p>a", None, big, big, "", "<p>a", big + "y"]
    written(folder, "pages", {"page_id": pa.array(range(7), pa.int64()), "url": pa.array([f"http://s/{i}" for i in range(7)]), "html": pa.array(html)}, 7)
    return str(folder), list(zip(ids, vectors, strict=True)), html


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    types = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
    written(folder, "documents", {c: pa.array([], t) for c, t in types.items()}, 0)
    written(folder, "embeddings", {"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], pa.list_(pa.float64())), "label": pa.array([], pa.int32())}, 0)
    written(folder, "conversations", {"conv_id": pa.array([], pa.int64()), "turn": pa.array([], pa.int64()), "role": pa.array([], pa.string()), "text": pa.array([], pa.string())}, 0)
    written(folder, "pages", {"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string()), "html": pa.array([], pa.string())}, 0)
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words_of(text):
    return (text or "").encode().split()


def test_op1(spark, tables, rows):
    got = Counter(tuple(r) for r in QUERIES["op1_substring_dedup"](spark, tables[0]).collect())
    # Python's split takes more white space than the contract's; no-break spaces stay in words
    plain = [(r[0], b" ".join(words_of(r[1])).decode().replace(" ", "~")) for r in rows]
    want = Counter({(i, n, gone, sha(kept.replace("~", " "))): c for (i, n, gone, kept), c in kept_words(plain, 50).items()})
    assert got == want


def test_op2(spark, tables, rows):
    got = QUERIES["op2_mixing"](spark, tables[0]).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    source = {r[0]: r[3] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    targets = {source[r.doc_id]: r.target for r in got}
    assert sum(targets.values()) == pytest.approx(sum(sizes.values())) and all(t <= 3 * sizes[s] + 1e-6 for s, t in targets.items())
    assert all(abs(taken[s] - targets[s]) <= max(0.02 * targets[s], 64) for s in targets)
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)


def test_op3(spark, tables):
    got = defaultdict(list)
    for r in QUERIES["op3_nearest_neighbours"](spark, tables[0]).orderBy("query_id", "rank", "vec_id").collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    usable = [(i, np.array(v)) for i, v in tables[1] if i is not None and v is not None and any(v)]
    want = defaultdict(list)
    for q, (name, v) in enumerate(usable):
        if name % 20 == 0:
            best = sorted((-round(float((v * w).sum()), 9), other) for k, (other, w) in enumerate(usable) if k != q)[:20]
            want[name] += [(k + 1, other, -less) for k, (less, other) in enumerate(best)]
    assert {k: Counter(v) for k, v in got.items()} == {k: Counter(v) for k, v in want.items()}


def test_op4(spark, tables, rows):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 1 for r in rows}
    tokens = [(r[0], [*(w.translate(lower) for w in words_of(r[1])), None]) for r in rows]
    counts = Counter(t for i, ts in tokens if not held[i] for t in ts)
    total, types = sum(counts.values()), len(counts)
    want = Counter()
    for i, ts in tokens:
        score = sum(np.log10((counts[t] + 0.5) / (total + 0.5 * (types + 1))) for t in ts)
        want[(i, held[i], len(ts), sum(counts[t] > 0 for t in ts), total, round(score, 4))] += 1
    got = QUERIES["op4_lm_scoring"](spark, tables[0]).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)


def test_op5(spark, tables, rows):
    got = QUERIES["op5_sharding"](spark, tables[0]).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.n_bytes
    assert all(r.shard_bytes == sizes[r.shard] for r in got) and Counter((r.doc_id, r.n_bytes) for r in got) == Counter((r[0], len((r[1] or "").encode())) for r in rows)
    alone = Counter((r.shard, r.doc_id) for r in got)
    assert all(n <= 1 << 20 or sum(s == shard for s, _ in alone) == 1 for shard, n in sizes.items())


@pytest.fixture(scope="module")
def encoded(rows):
    library = tokenizers.Tokenizer.from_file(VOCABULARY)
    ids = {text: library.encode(text or "", add_special_tokens=False).ids for text in {r[1] for r in rows}}
    return [(r[0], r[1], ids[r[1]]) for r in rows], library


def test_op6(spark, tables, encoded):
    at, want = 0, []
    for i, _, ids in sorted(encoded[0], key=lambda r: r[0]):
        data = np.array([*ids, 1], dtype="<u4").tobytes()
        want.append((i, at, len(ids) + 1, zlib.crc32(data)))
        at += len(ids) + 1
    assert sorted(tuple(r)[:4] for r in QUERIES["op6_token_files"](spark, tables[0]).select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == want


def test_op7(spark, tables):
    html = [(h or "").encode() for h in tables[2]]
    want = set()
    for i, h in enumerate(html):
        last = max(k for k, other in enumerate(html) if other == h)
        again = len(h) >= 1000 and last != i
        want.add((i, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", last if again else None))
    assert {tuple(r) for r in QUERIES["op7_warc"](spark, tables[0]).collect()} == want


def test_op8(spark, tables, encoded):
    pairs, library = encoded
    want = Counter((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))) for i, _, ids in pairs)
    assert Counter(tuple(r) for r in QUERIES["op8_bpe_encode_decode"](spark, tables[0]).collect()) == want


def test_op9(spark, tables, rows):
    plain = [(r[0], None if r[1] is None else b" ".join(words_of(r[1])).decode().replace(" ", "~")) for r in rows]
    assert Counter(tuple(r) for r in QUERIES["op9_ngram_join"](spark, tables[0]).collect()) == Counter(links_of(plain))


def test_op10(spark, tables, rows):
    got = QUERIES["op10_quality_rules"](spark, tables[0]).collect()
    want = Counter()
    for r in rows:
        n, chars, symbols, lines, repeats = base_statistics((r[1] or "").replace(" ", "~"))
        want[(r[0], n, chars, symbols, lines, repeats, n < 10 or 100 * repeats > 20 * n)] += 1
    assert Counter(tuple(r)[:7] for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


def test_op11(spark, tables, rows):
    from folioflow.llm.collocations import Rules
    from tests.llm.test_collocations import expected

    assert sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, tables[0]).collect()) == expected([(r[0], r[1], r[2]) for r in rows], Rules())


def test_op12(spark, tables):
    from tests.llm.test_conversations import expected

    got = QUERIES["op12_conversation_repair"](spark, tables[0]).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == {c: w for c, (w, _) in expected(talks()).items()} and len(got) == 61


def test_op13(spark, tables):
    from tests.llm.test_embedding_dedup import expected

    rows = [(i, v, None if k % 9 == 8 else k % 3) for k, (i, v) in enumerate(tables[1])]
    assert sorted((tuple(r) for r in QUERIES["op13_embedding_dedup"](spark, tables[0]).collect()), key=str) == expected(rows, 0.93)
