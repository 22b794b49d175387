"""Queries over texts: tokens, vocabulary tiers, phrases, usages, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.functions import slices
from lexdrift.functions.wordlists import CITATIONS, LATIN_PHRASES, STOP_WORDS
from lexdrift.lineage import cut
from lexdrift.operators import phrases, text, usages, vocabulary
from lexdrift.plans import fixtures as fx
from lexdrift.plans.registry import query


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _citations_sql(t: str) -> str:
    for pattern, into in CITATIONS:
        into = into.replace("$", "\\")
        # RE2 looks nowhere ahead: what follows a number is caught and put back.
        if "(?=" in pattern:
            pattern, into = pattern.replace(r"(?=\s|$|\))", r"(\s|$|\))"), into + r"\1"
        t = f"regexp_replace({t}, {quoted(pattern)}, {quoted(into)}, 'gi')"
    return t


def _latin_sql(t: str) -> str:
    for p in sorted(LATIN_PHRASES, key=len, reverse=True):
        words = p.split(" ")
        into = "_".join(f"\\{k + 1}" for k in range(len(words)))
        t = f"regexp_replace({t}, {quoted(chr(92) + 'b' + ' '.join(f'({w})' for w in words) + chr(92) + 'b')}, {quoted(into)}, 'gi')"
    return t


STOP_SQL = "[" + ", ".join(quoted(w) for w in STOP_WORDS) + "]"
SQL_TOKENS = f"select doc_id, year, para_idx, list_filter(regexp_extract_all(lower({_latin_sql(_citations_sql('text'))}), '[a-z_][a-z0-9_]*'), lambda t: len(t) >= 2 and t[1] <> '_' and not list_contains({STOP_SQL}, t)) as tokens from ({fx.SQL_PARAGRAPHS})"
SQL_SENTENCES = f"select * from ({SQL_TOKENS}) where len(tokens) > 0"
SQL_COUNTS = f"select 'y' || year as slice, word, count(*) as cnt from (select year, unnest(tokens) as word from ({SQL_SENTENCES})) group by 1, 2"


def _counts(spark, sf_dir, min_count=1):
    return vocabulary.word_counts(fx.sentences(spark, sf_dir), ["slice"], min_count)


@query(f"select doc_id, year, para_idx, array_to_string(tokens, ' ') as line from ({SQL_SENTENCES})", wholes="year para_idx")
def sentence_lines(spark, sf_dir):
    return text.as_lines(fx.sentences(spark, sf_dir)).drop("slice")


@query(f"select doc_id, para_idx, md5({_citations_sql('text')}) as digest from ({fx.SQL_PARAGRAPHS})", wholes="para_idx")
def normalized_citations(spark, sf_dir):
    return fx.paragraphs(spark, sf_dir).select("doc_id", "para_idx", F.md5(text.normalize_citations(F.col("text")).cast("binary")).alias("digest"))


@query(f"select doc_id, para_idx, text from ({fx.SQL_PARAGRAPHS}) where len(text) >= 50", wholes="para_idx")
def long_paragraphs(spark, sf_dir):
    return fx.paragraphs(spark, sf_dir).where(F.length("text") >= usages.MIN_CHARS).drop("year")


@query(f"select word, sum(cnt)::bigint as cnt from ({SQL_COUNTS}) group by 1")
def token_counts(spark, sf_dir):
    return vocabulary.word_counts(fx.sentences(spark, sf_dir), [])


@query(f"select word, slice as time_slice, cnt as count from ({SQL_COUNTS}) where cnt >= 3")
def word_frequencies(spark, sf_dir):
    return vocabulary.frequency_table(_counts(spark, sf_dir, 3))


@query(f"select word, avg(cnt) as mean_count from ({SQL_COUNTS}) group by 1", "mean_count")
def mean_counts(spark, sf_dir):
    return vocabulary.mean_counts(_counts(spark, sf_dir))


SQL_SPREAD = f"select word, count(distinct slice) as n_slices from ({SQL_COUNTS}) group by 1"


@query(f"select * from ({SQL_SPREAD}) where n_slices >= 3")
def v_global(spark, sf_dir):
    return vocabulary.v_global(_counts(spark, sf_dir), once=True)


@query(f"select * from ({SQL_SPREAD}) where n_slices >= 10")
def v_analysis(spark, sf_dir):
    return vocabulary.v_analysis(_counts(spark, sf_dir), once=True)


@query(f"with c as ({SQL_COUNTS}), h as (select word, count(*) / sum(1.0 / cnt) as hmean from c group by 1 having count(distinct slice) >= 10), t as (select word, hmean, row_number() over (order by round(hmean, 9) desc, word) as rank from h) select * from t where rank <= 500", "hmean", "rank")
def v_anchor(spark, sf_dir):
    return vocabulary.anchors_of_counts(_counts(spark, sf_dir), once=True)


@query(f"with c as ({SQL_COUNTS}), a as (select word from ({SQL_SPREAD}) where n_slices >= 12), h as (select word, count(*) / sum(1.0 / cnt) as hmean from c semi join a using (word) group by 1 having count(*) >= 3), t as (select word, hmean, row_number() over (order by round(hmean, 9) desc, word) as rank from h) select * from t where rank <= 100", "hmean", "rank")
def anchors_of_a_tier(spark, sf_dir):
    counts = cut(_counts(spark, sf_dir), "counts")
    return vocabulary.v_anchor(counts, vocabulary.v_analysis(counts, 3, 12, [], once=True), 100)


@query(f"with w as (select unnest(['court', 'er', 'on', 'nosuchword', 'nt', 'tion']) as word), c as (select word, sum(cnt) as n from ({SQL_COUNTS}) group by 1) select word, coalesce(n, 0) as freq from w left join c using (word)", wholes="freq")
def corpus_frequency(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("court", "er", "on", "nosuchword", "nt", "tion")], "word string")
    return vocabulary.corpus_frequency(_counts(spark, sf_dir), words)


@query(f"with c as ({SQL_COUNTS}) select word from c where slice = 'y2001' intersect select word from c where slice = 'y2002'")
def shared_vocabulary(spark, sf_dir):
    counts = _counts(spark, sf_dir)
    return vocabulary.intersect_vocabularies(counts.where("slice = 'y2001'"), counts.where("slice = 'y2002'"))


def _pieces(words):
    """piece: beginnings of up to four letters and later parts of up to three that three words or more share; ``words`` has each word once."""
    begins = "transform(sequence(1, least(4, length(word))), n -> substring(word, 1, n))"
    inner = "flatten(transform(sequence(2, length(word)), i -> transform(sequence(1, least(3, length(word) - i + 1)), n -> concat('##', substring(word, i, n)))))"
    # Each word names a piece once: what is shuffled are counts of pieces, not pairs of piece and word.
    own = F.expr(f"array_distinct(concat({begins}, if(length(word) > 1, {inner}, array())))")
    return words.where("length(word) > 0").select(F.explode(own).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").select("piece")


@query(
    f"""with recursive w as materialized (select word, n_slices from ({SQL_SPREAD}) where n_slices >= 3),
    p as materialized (select piece from (select word, substr(word, 1, n) as piece from w, unnest([1, 2, 3, 4]) as t(n) where len(word) >= n
        union all select word, '##' || substr(word, i, n) from w, unnest(range(2, len(word) + 1)) as s(i), unnest([1, 2, 3]) as t(n) where i + n - 1 <= len(word)) group by 1 having count(distinct word) >= 3),
    f as materialized (select word, n_slices from w where not contains(word, '_') and len(word) >= 4),
    e as materialized (select f.word, s.i, max(n) as n from f, unnest(range(1, len(f.word) + 1)) as s(i), unnest([1, 2, 3, 4]) as t(n) join p on p.piece = case when s.i = 1 then '' else '##' end || substr(f.word, s.i, t.n) where s.i + t.n - 1 <= len(f.word) group by 1, 2),
    c as (select word, 1 as i, 0 as k from f union all select c.word, c.i + e.n, c.k + 1 from c join e on e.word = c.word and e.i = c.i),
    d as materialized (select c.word, max(case when c.i = len(c.word) + 1 then c.k end) as k from c group by 1)
    select f.word, f.n_slices, coalesce(d.k, 1) as n_subwords from f join d on d.word = f.word where coalesce(d.k, 1) <= 5""",
    wholes="n_subwords")
def v_bert(spark, sf_dir):
    words = cut(vocabulary.v_global(_counts(spark, sf_dir), once=True), "words")
    return vocabulary.v_bert(words, _pieces(words.select("word")))


SQL_PAIRS = f"""s as ({SQL_SENTENCES}), w as (select word, count(*) as n from (select unnest(tokens) as word from s) where word <> 'without' group by 1),
    p as (select list_filter(list_transform(tokens, lambda t, i: {{'t': t, 'i': i}}), lambda x: x.t <> 'without') as p, tokens from s),
    e as (select p[k].t as a, array_to_string(tokens[p[k].i + 1 : p[k + 1].i - 1], ' ') as link, p[k + 1].t as b from p, unnest(range(1, len(p))) as t(k)),
    c as (select a, link, b, count(*) as n_ab from e group by 1, 2, 3)"""


@query(f"with {SQL_PAIRS} select a, link, b, n_ab, (n_ab - 5) / (x.n * y.n) * ((select count(*) from w) + (select count(*) from c)) as score from c join w x on x.word = a join w y on y.word = b where n_ab >= 5 and (n_ab - 5) / (x.n * y.n) * ((select count(*) from w) + (select count(*) from c)) > 10", "score")
def phrase_scores(spark, sf_dir):
    return phrases.score_pairs(fx.sentences(spark, sf_dir), 5, 10.0)


@query()
def phrase_sentences(spark, sf_dir):
    merged, _ = phrases.detect_phrases(fx.sentences(spark, sf_dir), 5, 10.0)
    return text.as_lines(merged).drop("slice")


SQL_RUNS = f"select doc_id, year, para_idx, regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_\\p{{Pc}}]+') as r, string_split_regex(text, '[\\p{{L}}\\p{{M}}\\p{{N}}_\\p{{Pc}}]+') as g from ({fx.SQL_PARAGRAPHS}) where len(text) >= 50"


@query(
    f"with r as ({SQL_RUNS}), u as (select doc_id, para_idx, lower(r[k]) as word, list_sum(list_transform(g[1 : k], lambda x: len(x))) + coalesce(list_sum(list_transform(r[1 : k - 1], lambda x: len(x))), 0) as char_start, len(r[k]) as n from r, unnest(range(1, len(r) + 1)) as t(k) where lower(r[k]) in ('that', 'which', 'licensed', 'par')) select word, doc_id, para_idx, char_start, char_start + n as char_end from u",
    wholes="para_idx char_start char_end")
def usage_index(spark, sf_dir):
    words = spark.createDataFrame([(w,) for w in ("that", "which", "licensed", "par")], "word string")
    return usages.find_usages(fx.paragraphs(spark, sf_dir), words, ["doc_id", "para_idx"])


@query()
def usage_embeddings(spark, sf_dir):
    paras = fx.paragraphs(spark, sf_dir)
    found = usages.sample_per_key(usages.find_usages(paras, spark.createDataFrame([("which",), ("par",)], "word string"), ["doc_id", "para_idx"]), ["word"], ["doc_id", "para_idx", "char_start"], 100)
    out = usages.embed_usages(usages.paragraphs_to_encode(paras, found, ["doc_id", "para_idx"]), found, ["doc_id", "para_idx"], usages.HashEncoder())
    return out.withColumn("emb", F.transform("emb", lambda x: F.round(x.cast("double"), 4)))


@query()
def trained_usage_embeddings(spark, sf_dir):
    """Usages of two words, encoded by vectors trained on all sentences of the table."""
    from lexdrift.operators.train import W2VSettings, train

    paras = fx.paragraphs(spark, sf_dir)
    encoder = usages.VectorEncoder(train(fx.sentences(spark, sf_dir), W2VSettings(vector_size=8, min_count=20, epochs=1)))
    found = usages.find_usages(paras, spark.createDataFrame([("which",), ("par",)], "word string"), ["doc_id", "para_idx"])
    out = usages.embed_usages(usages.paragraphs_to_encode(paras, found, ["doc_id", "para_idx"]), found, ["doc_id", "para_idx"], encoder)
    return out.withColumn("emb", F.transform("emb", lambda x: F.round(x.cast("double"), 4)))


@query("with y as (select min(2000 + substr(source, 4)::integer) as a, max(2000 + substr(source, 4)::integer) as b from documents) select 'w' || s || '_' || (s + 4) as label, s as start_year, s + 4 as end_year, s + 2.0 as mid, s - a + 1 as ord from y, lateral (select unnest(range(a, b - 3)) as s)", "mid", "start_year end_year ord")
def sliding_windows(spark, sf_dir):
    year = 2000 + F.substring("source", 4, 9).cast("int")
    first, last = fx.table(spark, sf_dir, "documents").agg(F.min(year), F.max(year)).first()
    return slices.sliding_windows(spark, first, last)


@query(f"with w as (select s, 'w' || s || '_' || (s + 4) as slice from unnest(range(2000, 2016)) as t(s)) select slice, count(*) as n from ({SQL_SENTENCES}) join w on year between s and s + 4 group by 1")
def windowed_sentences(spark, sf_dir):
    return slices.in_windows(fx.sentences(spark, sf_dir).drop("slice"), 2000, 2019).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@query(f"select 'y' || year as slice, year::double as mid, count(*) as n from ({SQL_SENTENCES}) group by 1, 2", "mid")
def yearly_sentences(spark, sf_dir):
    rows = fx.sentences(spark, sf_dir).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("slice", slices.midpoint(F.col("slice")).alias("mid"), "n")


@query("with c as (select source, count(*) as c from documents group by 1) select source, least(c, greatest(1, round_even(200 * c / (select sum(c) from c), 0))) as n from c", wholes="n")
def proportional_sample_sizes(spark, sf_dir):
    rows = usages.proportional_sample(fx.table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 200)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query()
def weighted_sample(spark, sf_dir):
    return usages.weighted_sample(vocabulary.word_counts(fx.sentences(spark, sf_dir), [], 4), "cnt", ["word"], 100)


@query()
def trained_vectors(spark, sf_dir):
    from lexdrift.operators.train import W2VSettings, train_slices

    rows = slices.in_windows(fx.sentences(spark, sf_dir).drop("slice"), 2000, 2019, 10, 10)
    found = train_slices(rows, W2VSettings(vector_size=8, min_count=20, epochs=1))
    return found.withColumn("vec", F.transform("vec", lambda x: F.round(x.cast("double"), 4)))
