"""The queries of the training-data operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexdrift.llm import byte_bpe, decontaminate, jaccard_join, line_dedup, pivot_topk, prefix_trie, secret_scan, substring_dedup, token_counts, token_files, toxicity, warc, whitening
from lexdrift.llm.common import scratch, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_added", "n_layers", "n_cut")


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "tokens"), end_id=2)
    return token_files.read_token_files(manifest)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    return warc.read_archives(manifest)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), n=5, threshold=0.8)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=13)


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), n_components=32).withColumn("deviation", F.col("deviation").cast("long"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_pivot_topk, op3_benchmark_decontamination, op4_token_binary, op5_toxicity, op6_byte_bpe, op7_warc_revisit, op8_ngram_jaccard_join, op9_line_dedup, op10_substring_dedup, op11_conversation_prefix_trie, op12_embedding_whitening, op13_token_counts)}

ORACLES: dict[str, str] = {
    "op2_pivot_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s)
        select query_id, rank, vec_id, score from r where rank <= 20
    """,
    "op10_substring_dedup": r"""
        with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as words from documents),
        w as (select doc_id, i, array_to_string(words[i : i + 12], ' ') as content from d, unnest(range(1, len(words) - 11)) as t(i)),
        f as (select content, min(doc_id) as first from w group by 1),
        hit as (select doc_id, i from w join f using (content) where first < doc_id),
        gone as (select distinct doc_id, i + k as place from hit, range(13) as t(k)),
        g as (select doc_id, list(place) as places from gone group by 1)
        select doc_id, len(words)::bigint as n_words, coalesce(len(places), 0)::bigint as n_removed,
            sha256(array_to_string(case when places is null then words else [x for x, k in words if not list_contains(places, k)] end, ' ')) as kept_sha256
        from d left join g using (doc_id)
    """,
    "op11_conversation_prefix_trie": """
        with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
        k as (select conv_id, turn, sha256(length(role)::varchar || ':' || role || text) as key, strlen(text) as bytes from t),
        o as (select conv_id, list(struct_pack(key, bytes) order by turn nulls first, key) as own from k group by 1),
        c as (
            select *, xor(4294967295, list_reduce([4294967295] || flatten([[ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0] for x in string_split(conv_id::varchar, '')]),
                lambda a, x: case when xor(a, x) % 2 = 1 then xor(xor(a, x) // 2, 3988292384) else xor(a, x) // 2 end)) % 9 as h
            from o
        ),
        r as (select c.conv_id, coalesce(b.own[1 : c.h], []) || c.own[c.h + 1 :] as path from c left join o b on b.conv_id = c.conv_id - c.conv_id % 5),
        p as (select conv_id, d as depth, len(path) as n, array_to_string([x.key for x in path[1 : d]], ',') as prefix, case when d > 0 then path[d].bytes else 0 end as bytes from r, unnest(range(len(path) + 1)) as s(d)),
        g as (
            select depth, prefix, min(conv_id) as m, count(*) as n_convs, max(bytes) as bytes,
                sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where n = depth), '')) as ends_sha256
            from p group by 1, 2
        ),
        w as (select p.conv_id, p.depth, g.m from p join g using (depth, prefix)),
        e as (select g.*, w.m as parent from g left join w on w.conv_id = g.m and w.depth = g.depth - 1),
        k2 as (select parent as m, depth - 1 as depth, count(*) as n_children from e where depth > 0 group by 1, 2),
        f as (select e.*, coalesce(n_children, 0) as n_children from e left join k2 using (m, depth)),
        u as (select w.depth, w.m, sum((f.n_children = 0)::bigint) as n_leaves, sum((f.n_convs - 1) * f.bytes) as saved from f join w on w.conv_id = f.m and w.depth <= f.depth group by 1, 2)
        select f.m as conv_id, f.depth, f.parent as parent_conv_id, f.n_convs, f.n_children::bigint as n_children, u.n_leaves::bigint as n_leaves, u.saved::bigint as saved_tokens, f.ends_sha256
        from f join u using (depth, m)
    """,
    "op8_ngram_jaccard_join": r"""
        with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+') as words from documents where doc_id is not null),
        s as materialized (
            select distinct doc_id, array_to_string(words[i : i + 4], ' ') as shingle from w, unnest(range(1, greatest(len(words) - 3, 2))) as t(i) where len(words) > 0
        ),
        n as materialized (select doc_id, count(*) as n from s group by 1),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
        e as materialized (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where i >= 0.8 * (a.n + b.n - i) - 1e-9),
        b as materialized (select x, y from e union all select y, x from e),
        r as (select x, x as y from b union select r.x, b.y from r join b on b.x = r.y),
        k as (select x as doc_id, min(y) as class_id from r group by 1),
        l as (select x as doc_id, count(*) as n_links from b group by 1)
        select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0) as n_links, coalesce(n, 0)::integer as n_shingles
        from w left join k using (doc_id) left join l using (doc_id) left join n using (doc_id)
    """,
    "op9_line_dedup": """
        with d as materialized (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents where doc_id is not null),
        s as materialized (select doc_id, i, len(lines[i]) as own, sum(len(lines[i])) over (partition by doc_id order by i) as upto from d, unnest(range(1, len(lines) + 1)) as t(i)),
        v as (
            select a.doc_id, a.i as first, min(b.i) as last from s a join s b on b.doc_id = a.doc_id and b.i >= a.i and b.upto - a.upto + a.own >= 20 group by 1, 2
            union select b.doc_id, max(a.i), b.i from s a join s b on b.doc_id = a.doc_id and b.i >= a.i and b.upto - a.upto + a.own >= 20 group by 1, b.i
        ),
        c as materialized (select doc_id, first, last, array_to_string(lines[first : last], chr(10)) as content from v join d using (doc_id)),
        f as (select content, min(doc_id) as owner from c group by 1),
        g as (select doc_id, list(distinct i) as gone from c join f using (content), unnest(range(first, last + 1)) as t(i) where owner < doc_id group by 1)
        select doc_id, len(lines)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
            sha256(array_to_string(case when gone is null then lines else [x for x, k in lines if not list_contains(gone, k)] end, chr(10))) as kept_sha256
        from d left join g using (doc_id)
    """,
    "op7_warc_revisit": """
        with p as (select page_id, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        m as (select payload_digest, max(page_id) as top from p where payload_bytes >= 1000 group by 1)
        select page_id, payload_bytes, payload_digest,
            case when m.top is null or page_id = m.top then 'response' else 'revisit' end as record_type,
            case when page_id < m.top then m.top end as refers_to
        from p left join m using (payload_digest)
    """,
}
