"""Case-law metadata from triples (s, p, o, lang), landed as a table or read from an endpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The vocabulary's predicates and the columns of a decision.
CELEX = "resource_legal_id_celex"
SECTOR = "resource_legal_id_sector"
AGENT_NAME = "agent_name"
LABEL = "prefLabel"
#: column -> (predicate, what of the object is kept): all of it, what follows a marker, or the agent's name.
DECISION_COLUMNS = {
    "date": ("work_date_document", "all"),
    "ecli": ("case-law_ecli", "all"),
    "court_code": ("resource_legal_type", "all"),
    "resource_type": ("work_has_resource-type", "resource-type/"),
    "formation_code": ("case-law_delivered_by_court-formation", "formjug/"),
    "judge_rapporteur": ("case-law_delivered_by_judge", "agent"),
    "advocate_general": ("case-law_delivered_by_advocate-general", "agent"),
    "procedure_type": ("case-law_has_type_procedure_concept_type_procedure", "fd_100/"),
    "orig_country": ("case-law_originates_in_country", "country/"),
    "proc_lang": ("case-law_uses_procedure_language", "language/"),
    "case_year": ("resource_legal_year", "all"),
    "defendant_agent": ("case-law_defended_by_agent", "corporate-body/"),
    "applicant_agent": ("case-law_requested_by_agent", "corporate-body/"),
    "referring_court": ("case-law_delivered_by_court_national", "/"),
    "treaty_basis": ("resource_legal_based_on_concept_treaty", "treaty/"),
    "date_lodged": ("resource_legal_date_request_opinion", "all"),
    "procjur": ("case-law_has_procjur", "procjur/"),
    "published_ecr": ("case-law_published_in_erecueil", "all"),
    "authentic_lang": ("resource_legal_uses_originally_language", "language/"),
    "eea_relevant": ("resource_legal_eea", "all"),
    "natural_celex": ("resource_legal_number_natural_celex", "all"),
}
# Document types of case law, with the court of each.
DOC_TYPES = {
    "CJ": ("Judgment", "CJ"), "CO": ("Order", "CJ"), "CC": ("AG Opinion", "CJ"), "CV": ("Opinion (avis)", "CJ"), "CP": ("View (prise de position)", "CJ"), "CD": ("Decision", "CJ"), "CX": ("Ruling", "CJ"),
    "CS": ("Seizure", "CJ"), "CT": ("Third party proceeding", "CJ"), "CN": ("Communication: new case", "CJ"), "CA": ("Communication: judgment", "CJ"), "CB": ("Communication: order", "CJ"),
    "CU": ("Communication: request for opinion", "CJ"), "CG": ("Communication: opinion", "CJ"),
    "TJ": ("Judgment", "GC"), "TO": ("Order", "GC"), "TC": ("AG Opinion", "GC"), "TT": ("Third party proceeding", "GC"), "TN": ("Communication: new case", "GC"), "TA": ("Communication: judgment", "GC"), "TB": ("Communication: order", "GC"),
    "FJ": ("Judgment", "CST"), "FO": ("Order", "CST"), "FT": ("Third party proceeding", "CST"), "FN": ("Communication: new case", "CST"), "FA": ("Communication: judgment", "CST"), "FB": ("Communication: order", "CST"),
}
JUDGMENTS, ORDERS, OPINIONS, OTHER_JUDICIAL = ["CJ", "TJ", "FJ"], ["CO", "TO", "FO"], ["CC", "TC"], ["CV", "CP", "CD", "CX"]
ALL_JUDICIAL = JUDGMENTS + ORDERS + OPINIONS + OTHER_JUDICIAL
# Subject taxonomies as (source, predicate, sectors), their prefixes, and link types.
SUBJECT_SOURCES = [
    ("eurovoc", "resource_legal_is_about_subject-matter", ["1", "3", "6"]),
    ("case_law_subject", "case-law_is-about_case-law-subject-matter", ["6"]),
    ("case_law_directory", "case-law_is_about_concept_new_case-law", ["6"]),
    ("case_law_directory_old", "case-law_is_about_concept_case-law", ["6"]),
]
TAXONOMIES = [
    ("eurovoc", "http://eurovoc.europa.eu/"),
    ("case_law_directory", "http://publications.europa.eu/resource/authority/fd_578/"),
    ("case_law_directory_old", "http://publications.europa.eu/resource/authority/fd_577/"),
]
LINKS_HIGH = [
    ("interprets", "case-law_interpretes_resource_legal"),
    ("confirms", "case-law_confirms_resource_legal"),
    ("requests_interpretation", "case-law_requests_interpretation_resource_legal"),
    ("requests_annulment", "case-law_requests_annulment_of_resource_legal"),
    ("states_failure", "case-law_states_failure_concerning_resource_legal"),
    ("amends", "case-law_amends_resource_legal"),
    ("declares_valid", "case-law_declares_valid_resource_legal"),
    ("declares_void_preliminary", "case-law_declares_void_by_preliminary_ruling_resource_legal"),
    ("declares_incidentally_valid", "case-law_declares_incidentally_valid_resource_legal"),
]
LINKS_LOW = [
    ("suspends", "case-law_suspends_application_of_resource_legal"),
    ("corrects_judgment", "case-law_corrects_judgement_resource_legal"),
    ("incidentally_declares_void", "case-law_incidentally_declares_void_resource_legal"),
    ("interprets_judgment", "case-law_interpretes_judgement_resource_legal"),
    ("partially_annuls", "case-law_partially_annuls_resource_legal"),
    ("immediately_enforces", "case-law_immediately_enforces_resource_legal"),
    ("reviews_judgment", "case-law_reviews_judgement_resource_legal"),
    ("reexamined_by", "case-law_reexamined_by_case_court"),
]


def doc_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, t, k) for c, (t, k) in DOC_TYPES.items()], "code string, doc_type string, court string")


def is_doc_type(celex: Column, doc_types: list[str] | None = None) -> Column:
    """Sector 6, four digits of a year, and one of the type codes."""
    return celex.rlike("^6[0-9]{4}(" + "|".join(doc_types or JUDGMENTS) + ")")


def after(value: Column, marker: str) -> Column:
    """What follows the last occurrence of ``marker``; all where there is none."""
    return F.substring_index(value, marker, -1)


def objects(triples: DataFrame, predicate: str, name: str) -> DataFrame:
    return triples.where(F.col("p") == predicate).select("s", F.col("o").alias(name))


def works(triples: DataFrame, doc_types: list[str] | None = None, celex: list[str] | None = None, any_type: bool = False) -> DataFrame:
    """s, celex of the works of the given types."""
    rows = objects(triples, CELEX, "celex")
    if not any_type:
        rows = rows.where(is_doc_type(F.col("celex"), doc_types))
    return rows.where(F.col("celex").isin(celex)) if celex is not None else rows


def paged(df: DataFrame, max_items: int | None = None, offset: int = 0) -> DataFrame:
    """A page in the frame's order."""
    out = df.offset(offset) if offset else df
    return out.limit(max_items) if max_items else out


def decisions(triples: DataFrame, doc_types: list[str] | None = None, court: str | None = None, resource_type: str | None = None, formation: str | None = None, judge: str | None = None, advocate_general: str | None = None, date_from: str | None = None, date_to: str | None = None, max_items: int | None = None, offset: int = 0) -> DataFrame:
    """One row a celex: the 22 columns, as text. Predicates are pivoted in one pass over the works' triples, not joined one by one.

    A predicate with several objects keeps the smallest; of works with one
    celex the earliest, then the smallest, stays. A work needs a date.
    """
    base = works(triples, doc_types)
    wanted = {p: c for c, (p, _) in DECISION_COLUMNS.items()}
    names = objects(triples, AGENT_NAME, "agent").withColumnRenamed("s", "o")
    rows = triples.where(F.col("p").isin(list(wanted))).join(base, "s", "left_semi")
    agents = [p for p, k in DECISION_COLUMNS.values() if k == "agent"]
    rows = rows.where(~F.col("p").isin(agents)).select("s", "p", "o").unionByName(rows.where(F.col("p").isin(agents)).join(names, "o").select("s", "p", F.col("agent").alias("o")))
    columns = [F.min(F.when(F.col("p") == p, F.col("o") if k in ("all", "agent") else after(F.col("o"), k))).alias(c) for c, (p, k) in DECISION_COLUMNS.items()]
    out = base.join(rows.groupBy("s").agg(*columns), "s").where(F.col("date").isNotNull())
    for column, value in (("court_code", court), ("resource_type", resource_type)):
        if value:
            out = out.where(F.col(column) == value)
    if formation:
        out = out.where(F.contains("formation_code", F.lit(formation)))
    for column, value in (("judge_rapporteur", judge), ("advocate_general", advocate_general)):
        if value:
            out = out.where(F.contains(F.lower(column), F.lit(value.lower())))
    if date_from:
        out = out.where(F.col("date") >= date_from)
    if date_to:
        out = out.where(F.col("date") <= date_to)
    first = out.groupBy("celex").agg(F.min_by(F.struct("s", *DECISION_COLUMNS), F.struct("date", "s")).alias("d")).select("celex", *[f"d.{c}" for c in DECISION_COLUMNS])
    return paged(first.orderBy("date", "celex"), max_items, offset) if max_items or offset else first


def case_names(triples: DataFrame, doc_types: list[str] | None = None, celex: list[str] | None = None, language: str = "ENG") -> DataFrame:
    """celex, case_name (alternative title, else parties), case_id of the expressions in one language."""
    base = works(triples, doc_types, celex)
    expr = objects(triples, "expression_belongs_to_work", "work")
    expr = expr.join(triples.where((F.col("p") == "expression_uses_language") & (after(F.col("o"), "/") == language)).select("s"), "s", "left_semi")
    about = triples.where(F.col("p").isin("expression_title_alternative", "expression_case-law_parties", "expression_case-law_identifier_case")).groupBy("s").agg(
        *[F.min(F.when(F.col("p") == p, F.col("o"))).alias(n) for p, n in (("expression_title_alternative", "title"), ("expression_case-law_parties", "parties"), ("expression_case-law_identifier_case", "case_id"))])
    rows = expr.join(about, "s", "left").join(base.withColumnRenamed("s", "work"), "work")
    return rows.groupBy("celex").agg(F.min_by(F.struct(F.coalesce("title", "parties").alias("case_name"), "case_id"), "s").alias("d")).select("celex", "d.case_name", "d.case_id")


def linked(triples: DataFrame, predicates: list[tuple[str, str]], target: str, doc_types: list[str] | None = None, celex: list[str] | None = None, to_celex: bool = True) -> DataFrame:
    """celex, ``target``, link of works and what they link to: another work's celex, or the last part of the object's address.

    All predicates are met in one scan, through a small table of them.
    """
    spark = triples.sparkSession
    kinds = F.broadcast(spark.createDataFrame([(p, n) for n, p in predicates], "p string, link string"))
    rows = triples.join(kinds, "p").join(works(triples, doc_types, celex), "s").select("celex", "o", "link")
    if to_celex:
        rows = rows.join(objects(triples, CELEX, target).withColumnRenamed("s", "o"), "o")
    else:
        rows = rows.withColumn(target, after(F.col("o"), "/"))
    return rows.select("celex", target, "link").distinct()


def citations(triples: DataFrame, doc_types: list[str] | None = None, celex: list[str] | None = None) -> DataFrame:
    return linked(triples, [("cites", "work_cites_work")], "cited_celex", doc_types, celex).select(F.col("celex").alias("citing_celex"), "cited_celex")


def joined_cases(triples: DataFrame, **which) -> DataFrame:
    return linked(triples, [("joins", "case-law_joins_case_court")], "joined_celex", to_celex=False, **which).drop("link")


def appeals(triples: DataFrame, **which) -> DataFrame:
    return linked(triples, [("appeal", "case-law_subject_to_appeal_in_case_court")], "appeal_celex", to_celex=False, **which).drop("link")


def annulled_acts(triples: DataFrame, **which) -> DataFrame:
    return linked(triples, [("annuls", "case-law_declares_void_resource_legal")], "annulled_celex", **which).drop("link")


def ag_opinions(triples: DataFrame, **which) -> DataFrame:
    return linked(triples, [("opinion", "case-law_has_conclusions_opinion_advocate-general")], "ag_opinion_celex", **which).drop("link")


def legislation_links(triples: DataFrame, include_low: bool = False, **which) -> DataFrame:
    return linked(triples, LINKS_HIGH + (LINKS_LOW if include_low else []), "legislation_celex", **which).withColumnRenamed("link", "link_type")


def academic_citations(triples: DataFrame, celex: list[str] | None = None) -> DataFrame:
    base = works(triples, celex=celex, any_type=True).join(triples.where((F.col("p") == SECTOR) & (F.col("o") == "6")).select("s"), "s", "left_semi")
    return base.join(objects(triples, "case-law_article_journal_related", "citation_text"), "s").select("celex", "citation_text").distinct()


def subject_matter(triples: DataFrame, celex: list[str] | None = None) -> DataFrame:
    """celex, subject_code, subject_label (English, may be null), subject_source."""
    spark = triples.sparkSession
    kinds = F.broadcast(spark.createDataFrame([(p, n, s) for n, p, s in SUBJECT_SOURCES], "p string, subject_source string, sectors array<string>"))
    base = works(triples, celex=celex, any_type=True).join(objects(triples, SECTOR, "sector"), "s")
    labels = triples.where((F.col("p") == LABEL) & (F.col("lang") == "en")).select(F.col("s").alias("o"), F.col("o").alias("subject_label"))
    rows = triples.select("s", "p", "o").join(kinds, "p").join(base, "s").where(F.array_contains("sectors", F.col("sector"))).join(labels, "o", "left")
    return rows.select("celex", after(F.col("o"), "/").alias("subject_code"), "subject_label", "subject_source").distinct()


def subject_taxonomy(triples: DataFrame) -> DataFrame:
    """code, label, source of each taxonomy's concepts; the smallest label of a code."""
    labels = triples.where((F.col("p") == LABEL) & (F.col("lang") == "en"))
    source = F.coalesce(*[F.when(F.startswith(F.col("s"), F.lit(prefix)), F.lit(n)) for n, prefix in TAXONOMIES])
    code = F.coalesce(*[F.when(F.startswith(F.col("s"), F.lit(prefix)), F.substring(F.col("s"), F.lit(len(prefix) + 1), F.length("s"))) for _, prefix in TAXONOMIES])
    return labels.select(code.alias("code"), F.col("o").alias("label"), source.alias("source")).where("source is not null").groupBy("code", "source").agg(F.min("label").alias("label")).select("code", "label", "source")


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")
