"""Line dedup, Jaccard join, decontamination, toxicity and the pipeline against brute force, planted cases and held-out labels."""

import collections
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexdrift.llm import components, decontaminate, jaccard_join, line_dedup, toxicity

DATA = "/root/testdata/sf0.01"


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sentence(rng, n, words=3000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_patience_aligns_unique_lines_first():
    assert line_dedup.patience([1, 2, 3, 4], [9, 2, 3, 8, 4]) == [(1, 1), (2, 2), (3, 4)]
    assert line_dedup.patience([1, 1, 2], [1, 2, 1]) == [(0, 0), (2, 1)]
    assert line_dedup.patience([], [1]) == [] and line_dedup.patience([1], [1]) == [(0, 0)]
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        got = line_dedup.patience(a, b)
        assert all(a[p] == b[q] for p, q in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def plain_lines(rows, least=20):
    """(lines, lines removed, text left): every run of lines of ``least`` characters that an earlier document has goes; tries all runs."""
    out = {}
    for i, t in rows:
        b, gone = (t or "").split("\n"), set()
        for o, u in rows:
            if o is None or i is None or o >= i:
                continue
            a = (u or "").split("\n")
            for q in range(len(b)):
                for p in range(len(a)):
                    n = 0
                    while q + n < len(b) and p + n < len(a) and b[q + n] == a[p + n]:
                        n += 1
                    if sum(map(len, b[q : q + n])) >= least:
                        gone.update(range(q, q + n))
        out[i, t or ""] = (len(b), len(gone), "\n".join(x for k, x in enumerate(b) if k not in gone))
    return out


def line_rows():
    rng = random.Random(3)
    pool = [sentence(rng, rng.randrange(1, 9)) for _ in range(30)]
    rows = []
    for i in range(80):
        lines = [rng.choice(pool) if rng.random() < 0.5 else sentence(rng, 5) for _ in range(rng.randrange(1, 9))]
        rows.append((i, "\n".join(lines)))
    return rows + [(90, rows[5][1]), (91, rows[5][1]), (92, None), (93, ""), (94, "\n\n"), (95, "short"), (96, "short")]


def test_line_dedup(spark):
    rows = line_rows()
    df = frame(spark, rows).selectExpr("*", "1 as gone", "'x' as owner", "2 as n_lines", "3 as seq", "4 as __kept")
    out = line_dedup.dedup_lines(df)
    got = {(r.doc_id, dict(rows)[r.doc_id] or ""): (r.n_lines, r.n_removed, r.text) for r in out.collect()}
    assert got == plain_lines(rows)
    assert set(out.columns) == {*df.columns, "n_removed"} and {r.gone for r in out.collect()} == {1}
    kept = line_dedup.dedup_lines(df, counts=False)
    assert kept.columns == df.columns and {r.n_lines for r in kept.collect()} == {2}


def test_a_block_of_a_later_owner_goes_though_each_line_was_elsewhere_first(spark):
    rows = [(1, "alpha line a\nx"), (2, "y\ngamma line b"), (3, "alpha line a\ngamma line b\nown three"), (4, "alpha line a\ngamma line b\nown four")]
    assert removed(spark, rows) == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: "own four"}


def test_moved_blocks_go(spark):
    parts = [f"block {k} first line of it\nblock {k} second" for k in range(6)]
    rows = [(1, "\n".join(parts)), (2, "\n".join([parts[5], "own", parts[0], parts[3], parts[1], parts[0]]))]
    assert removed(spark, rows) == {1: rows[0][1], 2: "own"}


def test_rows_of_one_id_with_different_texts_are_judged_apart(spark):
    rows = [(1, "a line that comes first of all\nb"), (2, "a line that comes first of all\nc"), (2, "keep this second line please\na line that comes first of all"), (2, "keep this second line please\na line that comes first of all"), (None, "a line that comes first of all"), (3, "keep this second line please")]
    got = sorted((str(r.doc_id), r.text, r.n_removed) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert got == sorted([("1", rows[0][1], 0), ("2", "c", 1), ("2", "keep this second line please", 1), ("2", "keep this second line please", 1), ("None", rows[4][1], 0), ("3", "", 1)])


def common_blocks(rows, least=20):
    """Places of lines of runs that stand in an earlier document, by trying every run; and those that patience diff aligns with any earlier document."""
    texts = {i: (t or "").split("\n") for i, t in rows}
    gone, aligned = {i: set() for i in texts}, {i: set() for i in texts}
    for i, b in texts.items():
        for o, a in texts.items():
            if o < i:
                runs = {tuple(a[p:q]) for p in range(len(a)) for q in range(p + 1, len(a) + 1)}
                gone[i] |= {k for p in range(len(b)) for q in range(p + 1, len(b) + 1) if sum(map(len, b[p:q])) >= least and tuple(b[p:q]) in runs for k in range(p, q)}
                aligned[i] |= {k for run in line_dedup.blocks(line_dedup.patience(a, b)) if sum(len(b[k]) for k in run) >= least for k in run}
    return gone, aligned


def removed(spark, rows):
    return {r.doc_id: r.text for r in line_dedup.dedup_lines(frame(spark, rows)).collect()}


def test_a_block_of_short_lines_goes_however_many_documents_share_it(spark):
    verse = "first verse\nsecond\n\nthird verse"
    rows = [(i, f"{verse}\nown line of document {i}") for i in range(130)]
    got = removed(spark, rows)
    assert got == {i: t if i == 0 else f"own line of document {i}" for i, t in rows}


def test_windows_remove_every_common_block(spark):
    rng = random.Random(13)
    pool = ["", *(sentence(rng, rng.randrange(1, 6)) for _ in range(12))]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.7 else sentence(rng, 3) for _ in range(rng.randrange(1, 10))]
        rows.append((i, "\n".join(lines)))
    rows += [(70, rows[5][1]), (71, rows[5][1]), (72, None), (73, "\n\n"), (74, "\n\n"), (75, "short"), (76, "short")]
    gone, aligned = common_blocks(rows)
    assert any(gone.values()) and all(aligned[i] <= gone[i] for i in gone)
    want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]) for i, t in rows}
    assert removed(spark, rows) == want


def test_line_dedup_edges(spark):
    df = frame(spark, [(None, "a" * 30), (None, "a" * 30)])
    assert [r.n_removed for r in line_dedup.dedup_lines(df).collect()] == [0, 0]
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(200, 200 + k) for k in range(1, 30)] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_jaccard(rows, threshold=0.8, n=5):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    label, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            i = len(sets[a] & sets[b])
            if i and i >= threshold * (len(sets[a]) + len(sets[b]) - i) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [768, 5])
def test_jaccard_join(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rng = random.Random(4)
    rows, k = [], 0
    for _ in range(12):
        base = sentence(rng, rng.randrange(20, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 60)):
                w[rng.randrange(len(w))] = "edited"
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(500 + j, rows[0][1]) for j in range(20)] + [(600, None), (601, ""), (602, "one two"), (603, "one two"), (604, "three")]
    df = frame(spark, rows).selectExpr("*", "1 as sig", "2 as bands", "3 as rep")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(df, recall=0.9999).collect()}
    assert got == brute_jaccard(rows)


def test_links_do_not_depend_on_blocks(spark, monkeypatch):
    """One hot group of near copies, some only just similar, and bands that miss some pairs: the same rows however the group is cut."""
    rng = random.Random(6)
    base, rows = sentence(rng, 120).split(), []
    for k in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 7)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        rows.append((k, " ".join(w)))
    found = []
    for block in (5, 384, 10**6):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        found.append(sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.jaccard_join(frame(spark, rows), recall=0.9).collect()))
    assert found[0] == found[1] == found[2]
    links, exact = sum(n for _, _, n in found[0]), sum(n for _, n in brute_jaccard(rows).values())
    assert 0.9 * exact < links < exact


def test_jaccard_edges(spark):
    rows = jaccard_join.jaccard_join(frame(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id is None, r.class_id, r.n_links) for r in rows if r.doc_id is not None) == [(False, 1, 0)] and len(rows) == 3
    assert jaccard_join.jaccard_join(frame(spark, []).limit(0)).count() == 0
    bands, rows = jaccard_join.bands_for(0.8, 0.997)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.997 and bands * rows <= 256


def test_smith_waterman_against_the_plain_recurrence():
    rng = random.Random(6)
    for _ in range(60):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(1, 14))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert decontaminate.smith_waterman(np.array(a, "u4"), np.array(b, "u4"))[0] == max(map(max, h))


@pytest.mark.parametrize("most_bytes", [8 << 20, 300])
def test_leaks(spark, most_bytes):
    rng = random.Random(8)
    items = [(k, sentence(rng, rng.randrange(15, 50)).capitalize()) for k in range(12)]
    docs, planted = [], set()
    for i in range(120):
        words = sentence(rng, rng.randrange(0, 150)).split()
        if i % 4 == 0:
            k = rng.randrange(12)
            leak = items[k][1].replace(" ", ", ", 2).split()
            for _ in range(len(leak) // 8):
                leak[rng.randrange(len(leak))] = "edited"
            if i % 8 == 0:
                del leak[len(leak) // 2]
            at = rng.randrange(len(words) + 1)
            words[at:at] = leak
            planted.add((i, k))
        docs.append((i, " ".join(words)))
    docs += [(200, None), (201, ""), (None, items[0][1])]
    bench = spark.createDataFrame([*items, (50, None), (51, "the of"), (None, "")], "item_id long, text string").selectExpr("*", "1 as score")
    df = frame(spark, docs).selectExpr("*", "1 as item_id", "2 as score")
    rows = decontaminate.find_leaks(df, bench, most_bytes=most_bytes).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == planted | {(None, 0)}
    text = dict(docs)
    for r in rows:
        n = len(decontaminate.words_of(text[r.doc_id]))
        assert 0 <= r.start_word < r.end_word <= n and 0.6 <= r.score <= 1
    kept = decontaminate.without_leaks(df, bench)
    assert kept.count() == len(docs) - len({i for i, _ in planted}) and kept.columns == df.columns
    assert decontaminate.find_leaks(df.limit(0), bench).count() == decontaminate.find_leaks(df, bench.limit(0)).count() == 0


def plain_alignment(item, text):
    """The best local alignment score of two word lists by the plain recurrence, match 2, mismatch and gap -1."""
    above, best = [0] * (len(text) + 1), 0
    for x in item:
        row = [0]
        for j, y in enumerate(text, 1):
            row.append(max(0, above[j - 1] + (2 if x == y else -1), above[j] - 1, row[-1] - 1))
        best, above = max(best, max(row)), row
    return best


def test_whole_query_against_plain_alignment(spark):
    rng = random.Random(14)
    items = [(k, sentence(rng, rng.randrange(10, 30), 200)) for k in range(8)]
    docs = []
    for i in range(60):
        leak = rng.choice(items)[1].split()
        for _ in range(rng.randrange(len(leak) // 3)):
            leak[rng.randrange(len(leak))] = f"w{rng.randrange(200)}"
        docs.append((i, f"{sentence(rng, 8, 200)} {' '.join(leak)} {sentence(rng, 8, 200)}"))
    want = {(i, k): s for i, t in docs for k, item in items if (s := plain_alignment(item.split(), t.split()) / (2 * len(item.split()))) >= 0.6}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(got) > 20


@pytest.mark.parametrize("kind", ["put in", "left out", "replaced", "all"])
def test_no_edit_hides_an_item(spark, kind):
    """Every alignment over the threshold is found, at edit rates up to where none is left, with common words around."""
    rng = random.Random(kind)
    items = [(k, sentence(rng, rng.randrange(8, 40), 60 if k % 2 else 3000)) for k in range(10)]
    docs = []
    for i in range(150):
        rate, leak = rng.random() * 0.8, []
        for w in rng.choice(items)[1].split():
            what = rng.choice(["put in", "left out", "replaced"]) if kind == "all" else kind
            edit = rng.random() < rate
            leak += [w, f"w{rng.randrange(60)}"] if edit and what == "put in" else [f"w{rng.randrange(60)}"] if edit and what == "replaced" else [] if edit else [w]
        docs.append((i, f"{sentence(rng, 8, 60)} {' '.join(leak)} {sentence(rng, 8, 60)}"))
    item = items[0][1].split()
    docs.append((999, " ".join(w + (f" x{k}" if k % 2 else "") for k, w in enumerate(item))))
    want = {(i, k): s for i, t in docs for k, own in items if (s := plain_alignment(own.split(), t.split()) / (2 * len(own.split()))) >= 0.6}
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and len(got) > 20 and (999, 0) in got


def test_short_items_are_found_as_whole_runs(spark):
    bench = spark.createDataFrame([(1, "Who wrote the first long novel?"), (2, "alpha beta"), (3, "gamma"), (4, " "), (5, "who wrote the first long novel")], "item_id long, text string")
    df = frame(spark, [(1, "who wrote the FIRST long novel"), (2, "who wrote the first short novel"), (3, "x alpha, beta y gamma"), (4, "beta alpha")])
    assert {(r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 1, 1.0), (1, 5, 1.0), (3, 2, 1.0), (3, 3, 1.0)}


def test_repetitive_texts_and_items(spark):
    bench = spark.createDataFrame([(1, "very " * 4000), (2, "one two three " * 20)], "item_id long, text string")
    df = frame(spark, [(1, "very " * 6000), (2, "very " * 2000), (3, "one two three " * 5000), (4, "nothing here")])
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(df, bench).collect()} == {(1, 1), (3, 2)}


def test_a_leak_in_most_documents_is_found(spark):
    rng = random.Random(9)
    item = sentence(rng, 30)
    df = frame(spark, [(i, f"{sentence(rng, 20)} {item} {sentence(rng, 5)}") for i in range(60)] + [(100, sentence(rng, 50))])
    assert decontaminate.find_leaks(df, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 60


def test_a_group_of_equally_edited_copies_is_found(spark):
    rng = random.Random(10)
    item = sentence(rng, 41).split()
    df = frame(spark, [(i, " ".join([sentence(rng, 20), *(f"edit{rng.randrange(10**6)}" if k % 6 == 5 else w for k, w in enumerate(item)), sentence(rng, 5)])) for i in range(60)])
    found = decontaminate.find_leaks(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(60)) and all(0.7 < r.score < 0.8 for r in found)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    order = rows.score.rank()
    bad = rows.toxic == 1
    auc = (order[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.95
    assert rows.predicted[~bad].mean() < 0.02 and rows.predicted[bad].mean() > 0.5


def test_toxicity_edges(spark):
    docs = frame(spark, [(1, "you idiot"), (2, None), (3, ""), (None, "x"), (4, "good day")] + [(10 + k, "idiot fool") for k in range(40)] + [(100 + k, "fine day") for k in range(40)]).selectExpr("*", "'a' as toxic", "1 as score", "2 as places")
    labels = spark.createDataFrame([(10 + k, 1) for k in range(40)] + [(100 + k, 0) for k in range(40)] + [(10, 0), (None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(rows) == 85 and rows[1].score > rows[4].score and rows[2].score == rows[3].score
    assert "places" in toxicity.score(docs, model).columns
    split = {r.doc_id: r.held_out for r in toxicity.score_documents(docs, labels).collect()}
    assert split[1] == (zlib.crc32(b"1") % 3 == 1) and split[None] is False
    none = toxicity.score(docs, toxicity.train(docs, labels.limit(0)))
    assert {r.score for r in none.collect()} == {0.5} and toxicity.score(docs.limit(0), model).count() == 0


class PlainFtrl:
    """FTRL-proximal as published, a coordinate at a time, in double precision."""

    def __init__(self, s):
        self.s, self.z, self.n = s, collections.defaultdict(float), collections.defaultdict(float)

    def weight(self, i):
        s, z, l1, l2 = self.s, self.z[i], self.s.l1, self.s.l2
        if i is None:
            l1 = l2 = 0
        if abs(z) <= l1:
            return 0.0
        return -(z - (l1 if z > 0 else -l1)) / ((s.beta + self.n[i] ** 0.5) / s.alpha + l2)

    def learn(self, places, label):
        every = [None, *places]
        w = {i: self.weight(i) for i in every}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in every:
            sigma = ((self.n[i] + g * g) ** 0.5 - self.n[i] ** 0.5) / self.s.alpha
            self.z[i] += g - sigma * w[i]
            self.n[i] += g * g


def test_the_learner_is_ftrl_proximal(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.randrange(1, 40), 60) + (" vile" * (i % 3 == 0))) for i in range(150)]
    settings = toxicity.Settings(l1=0.4, epochs=2)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels, settings)
    order = [r.doc_id for r in frame(spark, rows).orderBy(F.xxhash64("doc_id")).collect()]
    plain = PlainFtrl(settings)
    for _ in range(2):
        for i in order:
            plain.learn(sorted(set(toxicity.features(rows[i][1]).tolist())), int(i % 3 == 0))
    want = {i: w for i in plain.z if i is not None and (w := plain.weight(i))}
    got = dict(zip(model.places.tolist(), model.weights.tolist()))
    assert want and {i for i, w in want.items() if abs(w) > 1e-3} <= set(got) and 0 < len(got) < len(plain.z)
    assert all(abs(got.get(i, 0) - want.get(i, 0)) < 2e-3 for i in {*got, *want}) and abs(model.bias - plain.weight(None)) < 2e-3


def test_repeated_ids_teach_once(spark):
    rows = [(1, "good day")] * 3 + [(1, "vile"), (2, "vile word"), (3, "fine")]
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0), (2, 0)], "doc_id long, toxic int")
    settings = toxicity.Settings(l1=0.0, epochs=1)
    one = min([(1, "good day"), (1, "vile")], key=lambda r: spark.range(1).select(F.xxhash64(F.lit(r[1]))).first()[0])
    a, b = (toxicity.train(frame(spark, r), labels, settings) for r in (rows, [one, *rows[4:]]))
    assert a.places.tolist() == b.places.tolist() and a.weights.tolist() == b.weights.tolist() and a.bias == b.bias
    few = toxicity.smallest_by_hash(spark.range(5000).withColumnRenamed("id", "doc_id"), 100)
    assert [r.doc_id for r in few.collect()] == [r.doc_id for r in spark.range(5000).withColumnRenamed("id", "doc_id").orderBy(F.xxhash64("doc_id")).limit(100).collect()]


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(15)
    long = sentence(rng, 60)
    item = duckdb.sql(f"select text from '{DATA}/benchmark.parquet' limit 1").fetchall()[0][0]
    rows = [(None, long), (None, None), (1, long), (2, long + " tail"), (2, "another text of id two"), (3, None), (4, ""), (5, "\n\n"), (6, f"before {item} after"), (7, "a line that is there twice"), (8, "a line that is there twice\nx"), (8, "a line that is there twice\nx")]
    names = ["gone", "gone_id", "n_lines", "n_removed", "score", "predicted", "class_id", "sig", "h", "item_id", "place"]
    return frame(spark, rows).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.lit(None).cast("long")} | {c: F.lit(f"own {c}") for c in names})


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_bpe"])
def test_each_stage_on_odd_rows(spark, odd_documents, name):
    import corpus_pipeline

    docs, stage = odd_documents, dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, DATA)
    rows = out.collect()
    if name == "byte_bpe":
        assert len(rows) == docs.count()
    else:
        assert out.columns == docs.columns
        own = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert all(r[c] == f"own {c}" for r in rows for c in own)
        left = sorted(str(r.doc_id) for r in rows)
        every = sorted(str(r.doc_id) for r in docs.select("doc_id").collect())
        # the copies of 1 and of 8; the copy of the benchmark item
        gone = {"toxicity": [], "line_dedup": [], "ngram_jaccard_join": ["2", "2"], "benchmark_decontamination": ["6"]}[name]
        assert left == sorted(every) if not gone else collections.Counter(every) - collections.Counter(left) == collections.Counter(gone)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_pipeline_run_equals_its_stages(spark):
    import corpus_pipeline
    from lexdrift.llm.common import written_paths

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    before = set(written_paths(spark))
    out = corpus_pipeline.run(spark, DATA)
    assert len(set(written_paths(spark)) - before) == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, DATA)
        if name != "byte_bpe":
            assert kept.columns == docs.columns
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in docs.select("doc_id").collect()} and len(ids) > 0.7 * docs.count()
        docs = kept
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_jaccard_stage_keeps_one_of_each_group(spark):
    import corpus_pipeline

    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    docs = frame(spark, rows).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, DATA).collect()}
    got = jaccard_join.jaccard_join(docs).collect()
    assert kept == {r.doc_id for r in got if r.class_id == r.doc_id}
