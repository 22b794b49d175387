"""Prefix trie, whitening and token counts against brute force and the library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexdrift.llm import prefix_trie, token_counts, whitening
from lexdrift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def trie_by_hand(rows):
    """What prefix_trie gives, from plain dicts."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), key, (role, text)))
    own = {c: [x[2] for x in sorted(t, key=lambda x: x[:2])] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        paths[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids = {}
    for prefix in members:
        if prefix:
            kids.setdefault(prefix[:-1], []).append(prefix)
    out = {}
    for prefix in sorted(members, key=len, reverse=True):
        here, below = members[prefix], [out[k] for k in kids.get(prefix, [])]
        last = len(prefix[-1][1].encode()) if prefix else 0
        ends = ",".join(str(c) for c in sorted(here) if len(paths[c]) == len(prefix))
        out[prefix] = (min(here), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(here), len(below), sum(b[5] for b in below) or 1, (len(here) - 1) * last + sum(b[6] for b in below), hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=lambda r: (r[1], r[0]))


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def trie_rows(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda r: (r[1], r[0]))


def test_trie_of_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-12, 90), *range(1000, 1020)]:
        for t in range(rng.choice([1, 2, 3, 3, 12])):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if t else "user", rng.choice(["a", "é", "", None, "long text"]) if t else "hello"))
    rng.shuffle(rows)
    assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows))) == trie_by_hand(rows)


def test_trie_of_copies_and_long_ones(spark):
    """A third of all conversations alike, one of many turns, one that shares all of them, null and equal turns, repeated rows, rows without an id."""
    rows = [(5 * c, t, "user", f"copy {t}") for c in range(40) for t in range(4)]
    rows += [(1001, t, "user", f"turn {t}") for t in range(60)] + [(1002, t, "user", f"turn {t}") for t in range(25)]
    rows += [(2003, None, "user", "none"), (2003, None, None, "none"), (2003, 1, "user", "b"), (2003, 1, "user", "a"), (2003, 1, "user", "a"), (None, 1, "user", "x")]
    got = trie_rows(prefix_trie.prefix_trie(conversations(spark, rows).withColumn("key", F.lit(1)).withColumn("place", F.lit("x")).withColumn("m", F.lit(2))))
    assert got == trie_by_hand(rows)


def test_trie_of_little(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).count() == 0
    for rows in ([(7, 1, "a", "b")], [(c, 0, None, None) for c in (1, 2, 3, 4, 6)]):  # some of them are left without turns
        assert trie_rows(prefix_trie.prefix_trie(conversations(spark, rows))) == trie_by_hand(rows)


def test_packs_of_ends(spark, monkeypatch):
    """Nodes whose ids take several rows and several partitions."""
    monkeypatch.setattr(prefix_trie, "PACK", 7)
    ends = spark.range(1000).selectExpr("if(id % 10 < 7, 1L, 2L) as depth", "id % 3 as m", "1000 - id as conv_id")
    want = {}
    for i in range(1000):
        want.setdefault((1 if i % 10 < 7 else 2, i % 3), []).append(1000 - i)
    got = {(r.depth, r.m): r.ends_sha256 for r in prefix_trie.hashed_ends(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


def test_trie_equals_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view conversations as select * from '{DATA}/conversations.parquet'")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = db.sql(f"select {', '.join(columns)} from ({ORACLES['op11_conversation_prefix_trie']})").fetchall()
    assert trie_rows(QUERIES["op11_conversation_prefix_trie"](spark, DATA)) == sorted(want, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("name", ["op8_ngram_jaccard_join", "op9_line_dedup"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    rows = QUERIES[name](spark, DATA)
    want = db.sql(f"select {', '.join(rows.columns)} from ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def whitened_by_hand(vectors, k=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], "i8")
    n, s = len(x), x.sum(0)
    off = x.astype(np.longdouble) - s.astype(np.longdouble) / n
    v = (off.T @ off / n).astype(float)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x]
    return off.astype(float) @ q, e, deviation, np.trace(v)


def test_whitening_of_the_table(spark):
    rows = QUERIES["op12_embedding_whitening"](spark, DATA).toPandas()
    table = duckdb.sql(f"select vec_id, embedding from '{DATA}/embeddings.parquet' order by vec_id").fetchall()
    projected, e, deviation, trace = whitened_by_hand([np.array(v, "f4") for _, v in table])
    assert len(rows) == 32 * len(table) and rows.n.eq(len(table)).all()
    assert rows.drop_duplicates("vec_id").sort_values("vec_id").deviation.tolist() == deviation
    w = rows.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    signs = np.sign((w * projected).sum(0))
    np.testing.assert_allclose(w * signs, projected / np.sqrt(e), atol=1e-8)
    np.testing.assert_allclose(rows.drop_duplicates("component").sort_values("component").explained, e / trace, rtol=1e-9)
    found = np.cov(w.T, bias=True) - np.eye(32)
    assert rows.identity_error.nunique() == 1 and abs(rows.identity_error[0] - np.abs(found).max()) < 1e-9 and rows.identity_error[0] < 1e-4


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(5)
    # Far from the origin, with variances from 1e10 down to next to nothing, and one vector a third of all.
    plain = (rng.normal(size=(60, 6)) * [1e5, 3e3, 100, 10, 1, 0.2] + [1e6, 0, -7e5, 3, 0, 0]).astype("f4").tolist()
    rows = [(k, v) for k, v in enumerate(plain)] + [(100 + k, plain[0]) for k in range(30)] + [(3, plain[3])]
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0] * 5), (906, [3e38] * 6)]
    got = whitening.whiten(vectors(spark, rows + odd).withColumn("x", F.lit("y")).withColumn("w", F.lit(0)), 4).toPandas()
    projected, e, deviation, trace = whitened_by_hand([v for _, v in rows], 4)
    assert len(got) == 4 * len(rows) and set(got.vec_id) == {k for k, _ in rows}
    assert sorted(int(d) for d in got[got.component == 1].deviation) == sorted(deviation)
    np.testing.assert_allclose(got.drop_duplicates("component").sort_values("component").explained, e / trace, rtol=1e-4)
    w = got[got.vec_id == 7].sort_values("component").whitened.to_numpy()
    np.testing.assert_allclose(np.abs(w), np.abs(projected[7] / np.sqrt(e)), rtol=1e-4, atol=1e-6)
    assert got.identity_error[0] < 1e-4


def test_whitening_without_variance(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, [])])).count() == 0
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.identity_error == 0 for r in same)
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [3.0, 2.0])])).collect()
    assert [r.whitened is None for r in sorted(flat, key=lambda r: (r.component, r.vec_id))] == [False] * 3 + [True] * 3
    assert all(r.identity_error < 1e-9 for r in flat)


def test_more_pairs_than_one_aggregation(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(k, v) for k, v in enumerate(rng.normal(size=(40, 5)).astype("f4").tolist())]
    want = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(vectors(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "MOST_SUMS", 4)
    assert {(r.vec_id, r.component): pytest.approx(abs(r.whitened)) for r in whitening.whiten(vectors(spark, rows)).collect()} == want


def test_deviations_beyond_64_bits():
    off, sums = np.array([[3 * 10**12, -5], [7, 9]], "i8"), [10**19 + 3, 4]
    n = 10**7
    want = [str(sum((n * int(o) - s % n) ** 2 for o, s in zip(row, sums))) for row in off]
    assert whitening.deviations(off, n, sums) == want


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def odd_texts():
    rng = random.Random(11)
    alphabets = ["ab c", "aÉ́ İ1.", "日本語、。", "<|startoftext|> a", "don't we'll ' s 12 34", "🎉é\n\t x", "  a\x0bb\x0cc", "x" * 40 + "1-", "ΣΑΣ σ|<>"]
    texts = ["", None, " ", "a" * 5000, "日" * 3000, "<|endoftext|>" * 300, "1" * 900, "word " * 2000, "it's" * 700, "a.b" * 900, "é" * 1200, " ́" * 700]
    texts += ["".join(rng.choice(a) for _ in range(rng.randint(0, 2500))) for a in alphabets for _ in range(6)]
    texts += ["".join(rng.choice(rng.choice(alphabets)) for _ in range(2000)) for _ in range(6)]
    return texts + ["a" * 700 + " b. " + "日" * 900 + "x y" * 200 + "z" * 1500]


def test_stable_places_are_stable(library):
    """Around every place that is held stable, counts of both sides add up to that of the whole, whatever is cut off outside."""
    for text in [t for t in odd_texts() if t][::3]:
        for place in [p for p in range(1, len(text)) if token_counts.is_stable(text[p - 1], text[p])][:40]:
            low, high = max(0, place - 37), place + 23
            count = lambda t: len(library.encode(t, add_special_tokens=False))
            assert count(text[low:high]) == count(text[low:place]) + count(text[place:high])


@pytest.mark.parametrize("chunk, overlap", [(64, 8), (200, 200), (16_384, 256)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    texts = odd_texts()
    df = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("window", F.lit("w")).withColumn("n_tokens", F.lit(-1))
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, WORDS, 500, chunk, overlap).collect())
    sizes = [len(library.encode(t or "", add_special_tokens=False)) for t in texts]
    assert got == sorted((k // 2, len((t or "").encode()), n, n > 500) for k, (t, n) in enumerate(zip(texts, sizes)))


def test_overlaps_are_widened(spark, library):
    """Words longer than windows: no overlap has a stable place, so windows are joined, the others stay."""
    text = "plain words " * 60 + "a" * 1000 + " plain words" * 60 + "日" * 1300
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = token_counts.count_tokens(df, WORDS, chunk=100, overlap=20).first()
    assert row.n_tokens == len(library.encode(text, add_special_tokens=False)) and row.n_windows == -(-len(text) // 100)


def test_other_tokenizers_and_no_rows(spark):
    text, path = "One. Two words " * 90, public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.n_tokens for r in token_counts.count_tokens(df, path, chunk=100, overlap=20).collect()] == [want]
    assert [r.n_tokens for r in token_counts.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), chunk=100, overlap=20).collect()] == [len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text))]
    assert token_counts.count_tokens(df.where("doc_id > 1"), WORDS).count() == 0


def test_query_counts_the_table(spark, library):
    texts = duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet'").fetchall()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op13_token_counts"](spark, DATA).collect()}
    assert got == {k: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False)), n > 2048) for k, t in texts}
