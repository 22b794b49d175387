import http.server
import json
import random
import threading
import time
import urllib.parse

import numpy as np
import pytest

from lexdrift.sources import archives, endpoint, pages, stores, triples

#: When the stub server got its queries.
times: list[float] = []


def test_anchor_pages():
    page = "<p>7. early</p><a name='MO'></a><p>1. First <b>bold</b></p><p>no number</p><a name='DI'></a><p>2&nbsp;&nbsp;Second</p><p>3.</p>"
    got = [(p["para_id"], p["section"], p["text"]) for p in pages.paragraphs(page, "X")]
    assert got == [("X_P0007", "other", "early"), ("X_P0001", "grounds", "First bold"), ("X_OP0002", "operative", "Second")]


def test_class_pages():
    row = "<tr><td><p class='{0}count'>{1}</p></td><td><p class='{0}normal'>{2}</p><p class='{0}normal'>more</p></td></tr>"
    page = "<table>" + row.format("coj-", 1, "a") + row.format("coj-", 2, "On those grounds, b") + row.format("coj-", "x", "c") + "</table>"
    assert [(p["para_id"], p["text"]) for p in pages.paragraphs(page, "X")] == [("X_P0001", "a more"), ("X_OP0002", "On those grounds, b more")]
    plain = "<table>" + row.format("", 4, "t") + "</table>"
    assert pages.paragraphs(plain, "X")[0]["para_id"] == "X_P0004"


def test_summaries_and_broken_pages():
    assert pages.summary_only("<div class='x listNotice'><p>Subject</p></div>")
    assert not pages.summary_only("<div class='listNotice'></div><a name='MO'></a>")
    assert not pages.summary_only("<p>text") and not pages.summary_only(None)
    assert pages.paragraphs("<p>1. a<p>2. b<table><tr><td>", "X")[1]["text"] == "b"
    assert pages.paragraphs(None, None) == []


def test_language_fallback(spark):
    df = spark.createDataFrame([("a", "fra", 1), ("a", "eng", 2), ("b", "deu", 3), ("c", "fra", 4)], "celex string, lang string, n int")
    assert {r.celex: r.n for r in pages.best_language(df, ["eng", "fra"]).collect()} == {"a": 2, "c": 4}
    assert [r.celex for r in pages.to_fetch(df, df.where("celex = 'b'"), max_items=1).collect()] == ["a"]


def test_case_names_and_academic_citations(spark):
    rows = [("w", "resource_legal_id_celex", "62001CJ0001", None), ("w", "resource_legal_id_sector", "6", None), ("w", "case-law_article_journal_related", "Rev. 1", None), ("e", "expression_belongs_to_work", "w", None), ("e", "expression_uses_language", "http://x/language/ENG", None), ("e", "expression_case-law_parties", "A v B", None), ("f", "expression_belongs_to_work", "w", None), ("f", "expression_uses_language", "http://x/language/FRA", None)]
    t = spark.createDataFrame(rows, "s string, p string, o string, lang string")
    assert triples.case_names(t).first().case_name == "A v B"
    assert triples.academic_citations(t).first().citation_text == "Rev. 1"
    assert triples.decisions(t).count() == 0  # no date
    assert triples.appeals(t).count() == triples.ag_opinions(t).count() == triples.annulled_acts(t).count() == 0


def test_stores(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"celex": "a", "year": 1}\n\nnot json\n{"celex": "b", "year": 2}\n')
    rows = stores.read_records(spark, str(tmp_path / "r.jsonl"), "celex string, year int")
    assert sorted(r.celex for r in stores.existing_ids(rows, "celex").collect()) == ["a", "b"]
    stores.append_records(rows, str(tmp_path / "out"))
    stores.append_records(rows, str(tmp_path / "out"))
    assert stores.read_records(spark, str(tmp_path / "out"), "celex string, year int").count() == 4
    (tmp_path / "s.txt").write_text("a b\n c  d \n")
    assert [r.tokens for r in stores.read_lines(spark, str(tmp_path / "s.txt")).collect()] == [["a", "b"], ["c", "d"]]
    emb = spark.createDataFrame([("w", 2000, 1, [1.0]), ("w", 2000, 2, [2.0]), ("w", 2001, 3, [1.0]), ("v", 2000, 4, [1.0])], stores.USAGE_EMBEDDINGS)
    stores.write_by(emb, str(tmp_path / "e"), "year")
    stores.write_by(emb.where("year = 2000"), str(tmp_path / "e"), "year")
    got = stores.load_usage_embeddings(spark, str(tmp_path / "e"), [2000, 2001], spark.createDataFrame([("w",)], "word string"), 2)
    assert sorted(r.usage_id for r in got.collect()) == [1, 2]
    assert stores.missing_parts(emb, emb.where("year = 2000"), "year").count() == 1
    stores.write_csv(emb.drop("emb"), str(tmp_path / "c"))
    assert stores.read_csv(spark, str(tmp_path / "c")).count() == 4
    stores.save_vocabulary(rows.withColumnRenamed("celex", "word"), str(tmp_path / "v"))
    assert stores.load_vocabulary(spark, str(tmp_path / "v")).count() == 2
    years = spark.createDataFrame([("2001-05-01",), ("bad",), (None,)], "date string")
    assert stores.in_years(years, 2000, 2002).count() == 1


def test_streaming_counts(spark, tmp_path):
    from lexdrift.streaming import counts

    rows = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 'tariff duty tariff' as text union all select timestamp'2024-01-05 00:00:00', 'court case'")
    rows.write.parquet(str(tmp_path / "in"))
    stream = counts.token_counts(counts.read_stream(spark, str(tmp_path / "in"), "ts timestamp, text string"), "ts")
    counts.run_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    found = {(r.word, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {("tariff", 2), ("duty", 1)}  # the later window is still open


def test_endpoint_pages():
    from lexdrift.sources.endpoint import SparqlSource

    source = SparqlSource({"columns": "a, b", "total": "25", "page_size": "10", "endpoint": "http://x", "query": "q"})
    reader = source.reader(source.schema())
    lanes = reader.partitions()
    assert [p.pages for p in lanes] == [[(0, 10)], [(10, 10)], [(20, 5)]] and {p.lanes for p in lanes} == {3}


def test_lanes_never_share_a_slot():
    rng, sent = random.Random(4), []
    for lane in range(4):
        slots, now = endpoint.Slots(100.0, 0.5, lane, 4), 100.0 + rng.random() * 9
        for _ in range(50):
            at = slots.next(now)
            assert at >= now - 1e-9
            sent.append(at)
            now = at + rng.random() * rng.choice([0.01, 7.0])
    sent.sort()
    assert min(b - a for a, b in zip(sent, sent[1:])) > 0.5 - 1e-9


@pytest.fixture
def server():
    """A stub of an endpoint with 25 rows and of documents, of which one fails once."""
    asked, failed = [], set()
    times.clear()

    class Stub(http.server.BaseHTTPRequestHandler):
        def answer(self, code, body=b""):
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self):
            query = urllib.parse.parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["query"][0]
            offset, limit = int(query.split("OFFSET ")[1].split()[0]), int(query.split("LIMIT ")[1])
            asked.append((offset, limit))
            times.append(time.time())
            rows = [{"x": {"value": str(k)}} for k in range(25)[offset : offset + limit]]
            self.answer(200, json.dumps({"results": {"bindings": rows}}).encode())

        def do_GET(self):
            lang = self.headers.get("Accept-Language")
            asked.append((time.time(), self.path, lang, self.headers.get("Accept")))
            if self.path == "/c2" and (self.path, lang) not in failed:
                failed.add((self.path, lang))
                return self.answer(503)
            if self.path == "/broken":  # fewer bytes than were said
                self.send_response(200)
                self.send_header("Content-Length", "99")
                self.end_headers()
                return self.wfile.write(b"x")
            there = {("/c1", "fra"), ("/c2", "eng"), ("/c2", "fra"), ("/empty", "fra")}
            return self.answer(200, b"" if (self.path, lang) == ("/empty", "eng") else f"{self.path} {lang}".encode()) if (self.path, lang) in there | {("/empty", "eng")} else self.answer(404)

        def log_message(self, *args):
            pass

    with http.server.ThreadingHTTPServer(("127.0.0.1", 0), Stub) as httpd:
        threading.Thread(target=httpd.serve_forever, daemon=True).start()
        yield f"http://127.0.0.1:{httpd.server_port}", asked
        httpd.shutdown()


@pytest.mark.parametrize("options, want, pages", [({}, 25, [(0, 10), (10, 10), (20, 10)]), ({"max_items": "12"}, 12, [(0, 10), (10, 2)]), ({"total": "25"}, 25, [(0, 10), (10, 10), (20, 5)])])
def test_endpoint_is_read_page_by_page(spark, server, options, want, pages):
    url, asked = server
    endpoint.register(spark)
    reader = spark.read.format("sparql").options(endpoint=url, query="select ?x", columns="x", page_size="10", interval="0", **options)
    assert sorted(int(r.x) for r in reader.load().collect()) == list(range(want))
    assert sorted(asked) == pages


def test_documents_are_fetched_in_the_order_of_languages(spark, server):
    """The header names the language; an empty page counts as none, a failure is tried again, and neither ends the job."""
    url, asked = server
    keys = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("c1",), ("empty",), ("broken",), (None,)], "celex string")
    rows = {r.celex: (r.language, r.html, r.status, r.error) for r in endpoint.fetch_pages(keys, url + "/{key}", ["eng", "fra"], tasks=3, interval=0.01).collect()}
    lost = (None, None, "not_found", "Not available in: eng, fra")
    assert rows == {"c1": ("fra", "/c1 fra", "ok", None), "c2": ("eng", "/c2 eng", "ok", None), "c3": lost, "empty": ("fra", "/empty fra", "ok", None), "broken": lost}
    paths = [(p, lang) for _, p, lang, _ in asked]
    assert paths.count(("/c2", "eng")) == 2 and ("/c2", "fra") not in paths and paths.count(("/broken", "fra")) == 3
    assert {accept for *_, accept in asked} == {endpoint.ACCEPT}


def test_tasks_share_one_rate(spark, server):
    url, asked = server
    endpoint.register(spark)
    reader = spark.read.format("sparql").options(endpoint=url, query="select ?x", columns="x", page_size="2", interval="0.15", total="25", tasks="4")
    assert reader.load().count() == 25 and len(times) == 13
    sent = sorted(times)
    assert min(b - a for a, b in zip(sent, sent[1:])) > 0.1
    asked.clear()
    keys = spark.createDataFrame([(f"k{k}",) for k in range(9)], "celex string")
    assert endpoint.fetch_pages(keys, url + "/{key}", ["eng"], tasks=4, interval=0.15).count() == 9
    sent = sorted(t for t, *_ in asked)
    assert len(sent) == 9 and min(b - a for a, b in zip(sent, sent[1:])) > 0.1


def test_array_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    sets = {year: {w: rng.normal(size=(n, 4)).astype("f2") for w, n in words.items()} for year, words in {1999: {"a": 3, "b": 2}, 2000: {"a": 1, "c": 5}, 2001: {"b": 0, "d": 2}}.items()}
    for year, words in sets.items():
        np.savez(tmp_path / f"{year}.npz", **{("w::" + w if w != "c" else w): x for w, x in words.items()})
    (tmp_path / "notes.txt").write_text("no archive")
    archives.register(spark)
    rows = spark.read.format("npz").load(str(tmp_path))
    assert rows.columns == ["word", "year", "usage_id", "emb"]
    got = {(r.word, r.year, r.usage_id): r.emb for r in rows.collect()}
    want = {(w, year, k): v for year, words in sets.items() for w, x in words.items() for k, v in enumerate(x.astype("f4").tolist())}
    assert got == want
    pruned = rows.where("year >= 2000 and word in ('a', 'b')")
    assert {(r.word, r.year) for r in pruned.collect()} == {("a", 2000)}
    reader = archives.ArchiveReader({"path": str(tmp_path)})
    assert sum(len(p.names) for p in reader.partitions()) == 6
    from pyspark.sql.datasource import EqualTo, In, IsNotNull

    left = list(reader.pushFilters([EqualTo(("year",), 1999), In(("word",), ("a", "x")), IsNotNull(("emb",))]))
    assert left == [IsNotNull(("emb",))] and [p.names for p in reader.partitions()] == [["w::a.npy"]]
    assert spark.read.format("npz").load(str(tmp_path / "notes.txt")).count() == 0
    archives.write_archives(rows, str(tmp_path / "out"))
    again = spark.read.format("npz").load(str(tmp_path / "out"))
    assert {(r.word, r.year, r.usage_id): r.emb for r in again.collect()} == want
