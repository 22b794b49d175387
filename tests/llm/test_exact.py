"""Operators with exact contracts against brute force, round trips and the libraries."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from tokenizers import Tokenizer

from lexdrift.llm import byte_bpe, pivot_topk, secret_scan, substring_dedup, token_files, warc
from lexdrift.llm.fm_index import FmIndex
from lexdrift.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
ODD = ["", None, " ", "  a  b", "a\n\n  b \t c ", "don't  we'll 123abc  ", "日本語 émile 🎉🎉", " x", "x ", "a \nb", "<|endoftext|> hi", "\x00\x01 \x02", "word " * 30_000]


def docs(spark, texts, **more):
    rows = [(k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in more.items():
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit(value))
    return df


def some_texts(n=60):
    return [t for (t,) in duckdb.sql(f"select text from '{DATA}/documents.parquet' order by doc_id limit {n}").fetchall()]


@pytest.fixture(scope="module")
def bpe():
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = byte_bpe.load_ranks(path)
    return byte_bpe.ByteBpe(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(bpe):
    own, library = bpe
    for text in [*some_texts(), *(t or "" for t in ODD)]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text
    for word in (b"abc" * 300, b"\xff\xfe", "🎉".encode() * 50):
        assert list(own.transducer.stream(word)) == own.transducer.encode(word)


def test_long_words_are_streamed(bpe):
    own, library = bpe
    rng = random.Random(11)
    t = own.transducer
    words = ["a" * 5000, "ab" * 3000, "".join(rng.choice("abcdefgh") for _ in range(4000)), "é🎉" * 800, "=" * 3001, "".join(map(str, range(2000))), "".join(rng.choice(some_texts(3)[0].split()) for _ in range(900))]
    for word in words:
        data = word.encode()
        assert len(data) > 2 * t.longest and t.encode(data) == t.merge(data)
        lag = most = 0
        it = iter(data)

        def counted():
            nonlocal lag, most
            for byte in it:
                lag += 1
                most = max(most, lag)
                yield byte

        for token in t.stream(counted()):
            lag -= t.length[token]
        assert lag == 0 and most <= 3 * t.longest


def test_small_caches_change_nothing(bpe):
    own, library = bpe
    tight = byte_bpe.Transducer(own.transducer.ranks, most_states=50, most_pairs=50)
    for w in set(" ".join(some_texts(5)).split()):
        assert tight.encode(w.encode()) == library.encode_ordinary(w)


def test_utf8_machine():
    raw = "é日🎉a".encode() + b"\xff\xe2\x28\xf0\x9f" + b"\xed\xa0\x80" + "z".encode()
    for size in (1, 2, 3, 5):
        machine = byte_bpe.Utf8Machine()
        got = "".join(machine.feed(raw[k : k + size]) for k in range(0, len(raw), size)) + machine.finish()
        assert got == raw.decode("utf-8", "replace")


def test_bpe_frames(spark, bpe):
    own, library = bpe
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    df = docs(spark, ODD, ids="clash", n_tokens="clash")
    rows = {r.doc_id: r for r in byte_bpe.encode_decode(df, path, public_tokenizers.PATTERN, with_chars=True).collect()}
    for k, t in enumerate(ODD):
        ids = library.encode_ordinary(t or "")
        assert rows[k].n_tokens == len(ids)
        assert rows[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert rows[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert rows[k].decoded_chars == len(t or "")
    back = byte_bpe.decode(byte_bpe.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in back.collect()} == {k: t or "" for k, t in enumerate(ODD)}
    assert byte_bpe.encode_decode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


def test_token_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ODD + some_texts(20)
    df = docs(spark, texts, start="clash", n_tokens=1)
    got = token_files.read_token_files(token_files.write_token_files(df, path, f"file://{tmp_path}/t")).collect()
    library = Tokenizer.from_file(path)
    start = 0
    rows = {r.doc_id: r for r in got}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_ids_equal_the_library_as_it_comes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = token_files.LibraryEncoder(path), Tokenizer.from_file(path)
    own.most_pieces = 500
    every = [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    texts = ["hi <|endoftext|> x", "<|endoftext|><|endoftext|>", "a<|endoftext|>b  c", "x é́t²a a²b ⅷx x's 'tis a's'll b\u0301c z_1 ab12 12ab \u200bq q\u00adr x\ty z\n\nw", "\u00a0 x\u3000 y", " a\u2003b ", *(t or "" for t in ODD), *every]
    got = own.encode_batch(texts)
    for text, packed in zip(texts, got, strict=True):
        assert np.frombuffer(packed, own.kind).tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(got[0], own.kind).tolist() == [5303, 220, 50256, 2124]


def test_rows_of_one_id_are_dealt_to_several_shards(spark, tmp_path):
    df = spark.range(400).selectExpr("cast(if(id < 200, null, 7) as long) as doc_id", "concat('text ', id) as text").repartition(4)
    manifest = token_files.write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"))
    assert [r.n_docs < 200 for r in manifest.collect()] == [True] * 4
    rows = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.read_token_files(manifest).collect())
    assert [i for _, i, _ in rows] == [None] * 200 + [7] * 200 and all(a + n == b for (a, _, n), (b, _, _) in zip(rows, rows[1:]))


def test_token_files_with_unknown_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "b"), (3, "a"), (3, "a"), (1, None)], "doc_id long, text string")
    rows = sorted(token_files.read_token_files(token_files.write_token_files(df, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 3, 3] and [r.n_tokens for r in rows] == [2, 1, 2, 2]
    empty = token_files.write_token_files(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "e"))
    assert token_files.read_token_files(empty).count() == 0


BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 24),
}


def brute_secrets(text):
    found = [(m.start(), k, m.end()) for k, (name, (p, f, ok)) in enumerate(BASE.items()) for m in re.finditer(p, text, f) if ok(m)]
    return sorted(found)


def test_base_secrets(spark):
    rng = random.Random(5)
    pieces = ["token", "secret=", "Password: ", "api_key", "APIKEY = '", "abc", "abcdef123", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef" * 2, " ", "=", "ſecret=abcdefg", "\n"]
    texts = ["".join(rng.choice(pieces) for _ in range(30)) for _ in range(200)] + some_texts()
    for t in texts:
        assert secret_scan.scan(t) == brute_secrets(t)
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(docs(spark, [*texts, None, ""], spans="clash")).collect()}
    for k, t in enumerate([*texts, "", ""]):
        assert rows[k].base == secret_scan.joined(brute_secrets(t))
        assert set(rows[k].base.split(",")) <= set(rows[k].spans.split(","))


def test_nested_secrets():
    secret = "token = 'abcdef123'"
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    cases = [
        f"see {b64(secret)} end",
        f"see {b64('x ' + b64(secret))}",
        f"see {b64(gzip.compress(secret.encode()))}",
        f"see {b64(zlib.compress(zlib.compress(secret.encode())))}",
        "see token%3Dabcdefg%20",
        r"see token=\u{61}bcdefgh",
        "see " + b64("".join(f"%{c:02x}" for c in secret.encode())),
        "see " + b64(gzip.compress(b64(gzip.compress(secret.encode())).encode())),
    ]
    for text in cases:
        base, every, layers, cut = secret_scan.scan_layers(text)
        assert set(base) <= set(every) and len(every) > len(base) and layers and not cut, text
        assert all(4 <= a < b <= len(text) for a, _, b in every)
    base, every, _, _ = secret_scan.scan_layers("é🎉 token%3Dabcdefg!")
    assert secret_scan.joined(every) == "assign:3:18"


def test_secrets_beside_other_letters_and_over_lines():
    secret = "password=abcdef123"
    b64 = base64.b64encode(secret.encode()).decode()
    packed = gzip.compress("".join(f"{k} {hashlib.md5(str(k).encode()).hexdigest()[:20]}\n" for k in range(40)).encode() + secret.encode())
    mime = base64.encodebytes(packed).decode()
    cases = [f"https://h.example.com/{b64}", f"key_{b64}", f"/{b64}", f"ab-{b64}/tail", mime, mime.replace("\n", "\r\n"), mime.replace("\n", "\\n")]
    cases += [base64.encodebytes(b"x" * 48 + secret.encode()).decode(), "%FF" + "".join(f"%{c:02X}" for c in secret.encode())]
    cases += ["".join(f"%{c:02X}" for c in packed), "".join(f"\\x{c:02x}" for c in packed), base64.b64encode(b"\x00\x01" + secret.encode() + b"\xff").decode()]
    for text in cases:
        base, every, _, cut = secret_scan.scan_layers(text)
        assert [k for _, k, _ in set(every) - set(base)] == [0] and not cut, text
    assert secret_scan.scan_layers(cases[0])[1] == [(22, 0, 22 + len(b64))]


def test_every_member_of_compressed_data_is_read():
    two = gzip.compress(b"nothing here") + gzip.compress(b"token=abcdef123")
    assert len(secret_scan.scan_layers(base64.b64encode(two).decode())[1]) == 1


def test_secrets_behind_much_filler_are_found():
    rng = random.Random(16)
    filler = "".join(f"{rng.randrange(10**9)} line of filler, with words.\n" for _ in range(80_000)).encode()
    deep = filler + b"token=abcdef123" + filler
    long = filler * 6 + deep
    assert len(long) > 17 << 20 and len(deep) > 5 * secret_scan.WINDOW
    for data in (gzip.compress(long, 1), zlib.compress(deep, 1), gzip.compress(filler, 1) + gzip.compress(deep, 1), gzip.compress(b"head " + gzip.compress(deep, 1), 1), bz2.compress(filler + b" token=abcdef123", 1), zstandard.compress(deep)):
        text = f"see {base64.b64encode(data).decode()} end"
        base, every, layers, cut = secret_scan.scan_layers(text)
        assert {k for _, k, _ in every} == {0} and not cut and layers > 3


@pytest.mark.parametrize("lines", [False, True])
def test_packed_data_in_letters_beyond_a_window(lines):
    """A base64 run of compressed data within compressed data that is longer than a window is read to its end."""
    rng = random.Random(17)
    filler = b"".join(rng.randbytes(3).hex().encode() + b" words\n" for _ in range(300_000))
    inner = base64.b64encode(gzip.compress(filler + b"token=abcdef123", 1))
    assert len(inner) > 1.2 * secret_scan.WINDOW
    if lines:
        inner = b"\n".join(inner[k : k + 76] for k in range(0, len(inner), 76))
    text = "see " + base64.b64encode(gzip.compress(b"head " + inner + b" tail", 1)).decode()
    base, every, _, cut = secret_scan.scan_layers(text)
    assert [k for _, k, _ in set(every) - set(base)] == [0] and not cut


def test_damaged_data_are_read_as_far_as_they_go():
    plain = "".join(f"{k} {hashlib.md5(str(k).encode()).hexdigest()[:20]}\n" for k in range(60)).encode()
    whole = gzip.compress(plain + b"token=abcdef123")
    wrong_sum = whole[:-8] + bytes(4) + whole[-4:]
    late = gzip.compress(b"token=abcdef123 " + plain * 40)
    broken = bytearray(late)
    broken[len(late) // 2] ^= 0xFF
    for data in (wrong_sum, whole[:-6], bytes(broken), late[: len(late) // 2], lzma.compress(plain + b"token=abcdef123")):
        text = f"see {base64.b64encode(data).decode()} end"
        base, every, _, _ = secret_scan.scan_layers(text)
        assert {k for _, k, _ in set(every) - set(base)} == {0}


def test_memory_does_not_grow_with_what_is_packed():
    bomb = base64.b64encode(gzip.compress(b"a b " * 3_000_000, 1)).decode()
    text = " ".join(["", bomb, bomb, bomb, "token=abcdef123"])
    tracemalloc.start()
    assert len(secret_scan.scan_layers(text)[0]) == 1
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_bombs_end():
    bomb = base64.b64encode(zlib.compress(b"a" * 5_000_000)).decode()
    assert secret_scan.scan_layers(bomb, most_bytes=1 << 16)[3] == 1
    deep = "token=abcdefg"
    for _ in range(30):
        deep = "x " + base64.b64encode(gzip.compress(deep.encode())).decode()
    assert len(secret_scan.scan_layers(deep)[1]) == 1


def brute_repeats(rows, window=13):
    first = {}
    words = {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [100_000, 3])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR", hot)
    monkeypatch.setattr(substring_dedup, "SHARD_STRETCHES", 40)
    rng = random.Random(7)
    words = [f"w{k}" for k in range(400)] + ["é"]
    shared = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 20, 60)]
    rows = []
    for i in range(60):
        parts = [[rng.choice(words) for _ in range(rng.randrange(0, 40))]]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(shared), [rng.choice(words) for _ in range(rng.randrange(10))]]
        rows.append((i, " ".join(w for p in parts for w in p)))
    rows += [(100 + k, rows[3][1]) for k in range(5)] + [(200, None), (201, ""), (202, "a b a b " * 40), (203, "b a " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as runs")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(df).collect()}
    assert got == brute_repeats(rows)


def test_substring_dedup_edges(spark):
    df = spark.createDataFrame([(None, "a " * 20), (None, "a " * 20)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(df).collect()] == [0, 0]
    assert substring_dedup.remove_repeats(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts_are_judged_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (2, f"{a} {b}"), (2, c), (2, c), (2, None), (3, f"x {b}"), (None, a)]
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect())
    assert got == sorted([("1", 20, 0, a), ("2", 40, 20, b), ("2", 20, 0, c), ("2", 20, 0, c), ("2", 0, 0, ""), ("3", 21, 20, "x"), ("None", 20, 0, a)])


def test_fm_index_matches():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 6, 500)
    text[-1] = 0
    index = FmIndex(text, 8)
    stream = rng.integers(1, 6, 100)
    ends = np.arange(1, 101)
    length, low, high = index.matching(stream, ends, 8)
    plain = [tuple(text[k : k + 8]) for k in range(len(text))]
    for e, n, a, b in zip(ends, length, low, high):
        best = max((m for m in range(0, min(8, e) + 1) if m == 0 or any(p[:m] == tuple(stream[e - m : e]) for p in plain)))
        assert n == best
        if n:
            assert b - a == sum(p[:n] == tuple(stream[e - n : e]) for p in plain)


def brute_top(rows, queries, k):
    v = {i: [int(np.floor(float(x) * 64)) for x in e] for i, e in rows}
    out = []
    for q in queries:
        scores = sorted((-sum(a * b for a, b in zip(v[q], v[c])), c) for c in v if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 30)
    monkeypatch.setattr(pivot_topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(rng.standard_normal((150, 6)).astype("f4"))]
    rows += [(1000 + k, rows[7][1]) for k in range(40)]
    extra = [(500, None), (501, [float("nan")] + [0.0] * 5), (502, [None] + [0.0] * 5), (503, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as block")
    got = sorted(tuple(r) for r in pivot_topk.top_k(df, df.where("vec_id % 20 = 0"), 7).collect())
    assert got == brute_top(rows, [i for i, _ in rows if i % 20 == 0], 7)
    few = pivot_topk.top_k(df.where("vec_id < 4"), df.where("vec_id = 0"), 20)
    assert few.count() == 3
    assert pivot_topk.top_k(df.limit(0), df, 5).count() == pivot_topk.top_k(df, df.limit(0), 5).count() == 0


@pytest.mark.parametrize("scale", [1.0, 1e3, 3e5])
def test_search_in_one_block_evaluates_by_bounds(spark, scale):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 5)) * 9
    rows = [(k, [float(x) for x in (centres[k % 12] + rng.standard_normal(5) * 0.2) * scale]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    tally = pivot_topk.Tally.on(spark)
    asked = df.where("vec_id % 500 = 0")
    got = sorted(tuple(r) for r in pivot_topk.top_k(df, asked, 5, tally=tally).collect())
    assert got == brute_top(rows, range(0, 3000, 500), 5)
    assert 0 < tally.evaluated.value < tally.met.value < 0.2 * 6 * 3000


def test_vectors_of_any_size_take_part(spark):
    """Large ones too, as long as their scores fit a long; only a component that is no long leaves a vector out."""
    rows = [(0, [1.0, 2.0]), (1, [1e9, -1e9]), (2, [1e300, 0.0]), (20, [1e7, 1e7]), (3, [-1e7, 5e6]), (4, [1e12, 2e3]), (5, [1e15, -1e15]), (40, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id in (0, 40)")
    got = sorted(tuple(r) for r in pivot_topk.top_k(df, asked, 20).collect())
    assert got == brute_top([r for r in rows if r[0] != 2], [0, 40], 20) and {r[2] for r in got} == {0, 1, 3, 4, 5, 20, 40}
    with pytest.raises(Exception, match="does not fit a long"):
        pivot_topk.top_k(df, df.where("vec_id = 4"), 20).collect()


def test_rows_of_one_query_are_one_query(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [2.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = sorted(((sum(int(64 * a) * int(64 * b) for a, b in zip(x, y)), i) for q, x in rows if q == 0 for i, y in rows if i), key=lambda s: (-s[0], s[1]))[:3]
    assert [(r.score, r.vec_id) for r in sorted(pivot_topk.top_k(df, df.where("vec_id = 0"), 3).collect(), key=lambda r: r["rank"])] == scores


def test_warc(spark, tmp_path):
    big, other = "<p>é" * 400, "x" * 1000
    rows = [(1, "http://a", big), (5, "http://b c", big), (3, None, big), (3, "http://d", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (None, "u", big), (9, "u", "y" * 2000), (9, "v", "y" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as digest")
    manifest = warc.write_archives(df, f"file://{tmp_path}/w", date="2024-01-01T00:00:00Z")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.read_archives(manifest).collect()), key=str)
    want = []
    seen = False
    for i, _, h in rows:
        body = (h or "").encode()
        kind, to = "response", None
        if h == big and i != 5:
            kind, to = "revisit", 5
        if i == 9 and seen:
            kind, to = "revisit", 9
        seen = seen or i == 9
        want.append((i, kind, to, len(body), hashlib.sha1(body).hexdigest()))
    assert got == sorted(want, key=str)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC-Type: response") + raw.count(b"WARC-Type: revisit") == len(rows)
    assert raw.count("<p>é".encode() * 400) == 1
    paths = warc.manifest_of(spark, [f"file://{f}" for f in files])
    assert warc.read_archives(paths).count() == len(rows)
    assert warc.read_archives(warc.write_archives(df.limit(0), str(tmp_path / "e"))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rows = QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    answer = db.execute(ORACLES[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = sorted((tuple(str(x[names.index(c)]) for c in columns) for x in answer.fetchall()))
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows.collect()) == want
