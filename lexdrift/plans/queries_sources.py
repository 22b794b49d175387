"""Queries over landed metadata and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexdrift.plans import fixtures as fx
from lexdrift.plans.registry import query
from lexdrift.sources import pages, stores, triples

C = f"c as ({fx.SQL_CASES})"


@query(f"with {C} select celex, date, o_orderstatus as court_code, o_orderstatus as resource_type, c_name as judge_rapporteur, null::varchar as ecli from c join customer on o_custkey = c_custkey where judgment")
def decisions(spark, sf_dir):
    found = triples.decisions(fx.triples(spark, sf_dir))
    return found.select("celex", "date", "court_code", "resource_type", "judge_rapporteur", "ecli")


@query(f"with {C} select celex, date from c join customer on o_custkey = c_custkey where judgment and o_orderstatus = 'F' and date between '1996-01-01' and '1997-12-31' and contains(lower(c_name), '00001') order by date, celex limit 50 offset 5")
def decisions_filtered(spark, sf_dir):
    return triples.decisions(fx.triples(spark, sf_dir), court="F", date_from="1996-01-01", date_to="1997-12-31", judge="00001", max_items=50, offset=5).select("celex", "date")


@query(f"with {C} select distinct a.celex as citing_celex, b.celex as cited_celex from c a join c b on b.k = a.k + 1 where a.judgment")
def citation_edges(spark, sf_dir):
    return triples.citations(fx.triples(spark, sf_dir))


@query(f"with {C} select distinct a.celex, b.celex as legislation_celex, case b.k - a.k when 2 then 'interprets' else 'amends' end as link_type from c a join c b on b.k - a.k in (2, 3) where a.judgment")
def legislation_links(spark, sf_dir):
    return triples.legislation_links(fx.triples(spark, sf_dir), include_low=True)


@query(f"with {C} select distinct celex, o_custkey::varchar as joined_celex from c where judgment")
def joined_cases(spark, sf_dir):
    return triples.joined_cases(fx.triples(spark, sf_dir))


@query(f"with {C} select distinct celex, o_orderpriority[1] as subject_code, o_orderpriority as subject_label, 'case_law_directory' as subject_source from c")
def subject_codes(spark, sf_dir):
    return triples.subject_matter(fx.triples(spark, sf_dir))


@query("select distinct o_orderpriority[1] as code, min(o_orderpriority) as label, 'case_law_directory' as source from orders group by 1")
def subject_taxonomy(spark, sf_dir):
    moved = fx.triples(spark, sf_dir).withColumn("s", F.replace("s", F.lit("http://x/"), F.lit("http://publications.europa.eu/resource/authority/")))
    return triples.subject_taxonomy(moved)


@query(f"with {C}, t as (select unnest(['CJ', 'GC', 'CST']) as court, unnest([14, 7, 6]) as n_types), n as (select case substr(celex, 6, 1) when 'C' then 'CJ' when 'T' then 'GC' end as court, count(*) as n_decisions from c group by 1) select court, n_types, coalesce(n_decisions, 0) as n_decisions from t left join n using (court)", wholes="n_types")
def document_types(spark, sf_dir):
    types = triples.doc_type_table(spark)
    found = fx.triples(spark, sf_dir).where("p = 'resource_legal_id_celex'").select(F.substring("o", 6, 2).alias("code"))
    counts = found.join(F.broadcast(types), "code").groupBy("court").agg(F.count(F.lit(1)).alias("n_decisions"))
    return types.groupBy("court").agg(F.count(F.lit(1)).alias("n_types")).join(counts, "court", "left").select("court", "n_types", F.coalesce("n_decisions", F.lit(0)).alias("n_decisions"))


@query("select conv_id, arg_min(text, case role when 'assistant' then 1 when 'user' then 2 end * 100000 + turn) as text from conversations where role in ('assistant', 'user') and turn < 100000 group by 1")
def preferred_role(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min_by("text", "turn").alias("text"))
    return pages.best_language(rows, ["assistant", "user"], "conv_id", "role").select("conv_id", "text")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by 1 limit 100")
def documents_to_fetch(spark, sf_dir):
    return pages.to_fetch(fx.table(spark, sf_dir, "documents"), fx.table(spark, sf_dir, "labels"), "doc_id", 100)


@query("select distinct doc_id::varchar as doc_id from labels")
def landed_ids(spark, sf_dir):
    return stores.existing_ids(fx.table(spark, sf_dir, "labels"), "doc_id")


@query("select year(o_orderdate) as year, count(*) as n from orders where year(o_orderdate) between 1996 and 1998 group by 1", wholes="year")
def orders_by_year(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "orders").withColumn("date", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return stores.in_years(rows, 1996, 1998).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


@query()
def page_paragraphs(spark, sf_dir):
    return pages.parse_pages(fx.table(spark, sf_dir, "pages").withColumnRenamed("page_id", "celex"))


SQL_PARTS = f"select doc_id, t, i, (len(t) + 1) // 2 as half, doc_id % 3 as kind from ({fx.SQL_LINES}), unnest(range(1, len(t) + 1)) as s(i)"


@query(
    f"""with p as ({SQL_PARTS}) select doc_id::varchar as celex, i - 1 as para_idx, doc_id || '_' || case when i > half then 'OP' else 'P' end || lpad(i::varchar, greatest(4, len(i::varchar))::integer, '0') as para_id, i::varchar as para_num,
    case when i > half then 'operative' else 'grounds' end as section, md5(case when kind > 0 and i = half + 1 then 'On those grounds, ' else '' end || t[i]) as digest from p""",
    wholes="para_idx")
def judgment_paragraphs(spark, sf_dir):
    found = pages.parse_pages(fx.judgments(spark, sf_dir))
    return found.select("celex", "para_idx", "para_id", "para_num", "section", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(f"select doc_id::varchar as celex, doc_id % 2 = 0 as summary_only from ({fx.SQL_LINES}) where len(t) > 0")
def judgment_notices(spark, sf_dir):
    """Pages with a notice: every second one is a judgment all the same."""
    notice = F.concat(F.lit("<html><body><div class='listNotice'><p>Summary</p></div></body></html>"), F.when(F.col("celex").cast("long") % 2 != 0, F.col("html")).otherwise(""))
    return pages.flag_summaries(fx.judgments(spark, sf_dir).withColumn("html", notice)).select("celex", "summary_only")


@query("select page_id, false as summary_only from pages")
def page_summaries(spark, sf_dir):
    return pages.flag_summaries(fx.table(spark, sf_dir, "pages")).select("page_id", "summary_only")


@query("select event_type, date_trunc('hour', ts) as window_start, count(*) as n from events group by 1, 2")
def hourly_events(spark, sf_dir):
    from lexdrift.streaming.counts import windowed_counts

    return windowed_counts(fx.table(spark, sf_dir, "events"), "ts", ["event_type"])
