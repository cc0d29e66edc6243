"""Evidence of comparison models: its families, what is missing, inconsistencies, context, gaps and explanations.

A model is a row with its keys (``by``) and its fields as maps and arrays; its providers are rows of
their own. Evidence rows have ``seq``, their place in the model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import analysis as an
from quotemill.operators import models as md

#: Categories that are commercial and technical for the consistency of a provider, and for the context.
COMMERCIAL, TECHNICAL = ("commercial_information", "commercial_conditions"), ("technical_information",)
COMPARABLE = ("commercial_information", "technical_information", "commercial_conditions")
CONTEXT_COMMERCIAL = ("commercial_information", "commercial_conditions", "delivery_times")
CONTEXT_TECHNICAL = ("technical_information", "certifications", "warranties")
#: Sections of an explanation, in order.
SECTIONS = ("analysis_summary", "evidence_used", "strength", "weakness", "risk", "consistency", "context_influence", "missing_information", "limitation")
#: Actions that are suggested where information is missing, and where nothing else is.
ASK_MORE = "Solicitar documentación complementaria para cubrir vacíos detectados"
COMPLETE_CONTEXT = "Completar contexto requerido: %s"
DEFAULT_ACTIONS = ("Completar documentación de cotizaciones", "Verificar consistencia de evidencias")
_ROW = "array<struct<section:int,place:int,part:int,i:int,source:string,key:string,value:string,keep:boolean>>"


def key_of(c: Column) -> Column:
    return F.lower(tx.strip(c))


def _rows(section: int, place: Column, part: int, source: str, entries: Column, blank: bool = False) -> Column:
    """Evidence rows of an array of (key, value); rows without a value go unless ``blank``."""
    made = F.transform(
        entries,
        lambda e, i: F.struct(F.lit(section).alias("section"), place.cast("int").alias("place"), F.lit(part).alias("part"), i.alias("i"), F.lit(source).alias("source"), e["key"].alias("key"), e["value"].alias("value"), (F.lit(True) if blank else tx.nonblank(e["value"])).alias("keep")),
    )
    return F.coalesce(F.filter(made, lambda x: x["keep"] & tx.nonblank(x["key"])).cast(_ROW), F.array().cast(_ROW))


def _fields(m: str) -> Column:
    return F.array_sort(F.map_entries(m))


def _same(values: str) -> Column:
    return F.transform(values, lambda v: F.struct(v.alias("key"), v.alias("value")))


def collect(models: DataFrame, providers: DataFrame, by: list[str]) -> DataFrame:
    """Evidence of models (commercial, technical, context, metadata, references: maps; specifications: array; columns: array of
    attribute and source) and of their providers (provider_id, place, commercial, technical: maps; specifications: array)."""
    none = F.lit(0)
    own = F.concat(
        _rows(0, none, 0, "commercial_information.fields", _fields("commercial")),
        _rows(1, none, 0, "technical_information.fields", _fields("technical")),
        _rows(2, none, 0, "technical_information.specifications", _same("specifications")),
        _rows(3, none, 0, "inherited_context", _fields("context")),
        _rows(4, none, 0, "metadata", _fields("metadata")),
        _rows(5, none, 0, "motor_internal_references", _fields("references")),
        F.coalesce(F.transform("columns", lambda c, i: F.struct(F.lit(6).alias("section"), none.cast("int").alias("place"), none.cast("int").alias("part"), i.alias("i"), F.concat(F.lit("dynamic_columns."), F.coalesce(c["source"], F.lit(""))).alias("source"), c["attribute"].alias("key"), F.lit("").alias("value"), tx.nonblank(c["attribute"]).alias("keep"))).cast(_ROW), F.array().cast(_ROW)),
    )
    place = F.col("place")
    theirs = F.concat(
        _rows(7, place, 0, "provider_organization.commercial_information.fields", _fields("commercial")),
        _rows(7, place, 1, "provider_organization.technical_information.fields", _fields("technical")),
        _rows(7, place, 2, "provider_organization.technical_information.specifications", _same("specifications")),
    )
    every = models.select(*by, F.lit(None).cast("string").alias("provider_id"), F.explode(own).alias("x")).unionByName(providers.select(*by, "provider_id", F.explode(theirs).alias("x")))
    fixed = F.col("x.source").endswith(".specifications")
    category = F.when(fixed, "technical_information").otherwise(an.evidence_category(F.col("x.key"), F.col("x.source")))
    order = Window.partitionBy(*by).orderBy("x.section", "x.place", "x.part", "x.i")
    return every.where("x.keep").select(*by, "provider_id", F.row_number().over(order).cast("long").alias("seq"), F.col("x.source").alias("source"), F.col("x.key").alias("key"), F.col("x.value").alias("value"), category.alias("category"))


def missing(evidence: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """Cell values that rows (provider_id, prepared) lack, then categories that a model has no evidence of; numbered anew in each model."""
    cells = rows.where("not prepared").select(*by, F.lit(0).alias("_o"), F.coalesce("provider_id", F.lit("")).alias("_k"), F.lit("cell_values").alias("expected_key"), F.lit("commercial_information").alias("category"), "provider_id")
    place = F.array_position(F.array(*map(F.lit, an.CATEGORIES)), F.col("category"))
    gone = an.missing_categories(evidence, by).select(*by, F.lit(1).alias("_o"), F.format_string("%02d", place).alias("_k"), F.col("category").alias("expected_key"), "category", F.lit(None).cast("string").alias("provider_id"))
    order = Window.partitionBy(*by).orderBy("_o", "_k")
    return cells.unionByName(gone).withColumn("n", F.row_number().over(order).cast("long")).drop("_o", "_k")


def _finding(kind: Column | str, criterion: str, subject: Column, *more: Column) -> list[Column]:
    return [(F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), F.lit(criterion).alias("criterion"), subject.alias("subject"), *more]


def coherence(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Keys of which a provider's last commercial and last technical values differ; rows of no provider are one provider's."""
    side = lambda kinds, name: an.last_values(evidence.where(F.col("category").isin(*kinds)).withColumn("_k", key_of(F.col("key"))), [*by, "provider_id", "_k"]).withColumnRenamed("value", name)
    a, b = side(COMMERCIAL, "commercial_value").alias("a"), side(TECHNICAL, "technical_value").alias("b")
    on = F.col("a._k") == F.col("b._k")
    for c in (*by, "provider_id"):
        on &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, on).where("commercial_value <> technical_value").select(*(F.col(f"a.{c}").alias(c) for c in by), F.col("a.provider_id").alias("provider_id"), F.col("a._k").alias("key"), "commercial_value", "technical_value")


def comparability(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Keys of comparable categories that some of a model's providers have and others lack."""
    own = evidence.where(F.col("provider_id").isNotNull() & F.col("category").isin(*COMPARABLE)).withColumn("key", key_of(F.col("key")))
    return an.comparability(own, by)


def inconsistencies(evidence: DataFrame, by: list[str]) -> DataFrame:
    """All findings of consistency (kind, criterion, subject, provider_id)."""
    one = coherence(evidence, by).select(*by, "provider_id", *_finding("contradictory", "commercial_technical_coherence", F.col("key")))
    two = comparability(evidence, by).select(*by, F.lit(None).cast("string").alias("provider_id"), *_finding("relevant_difference", "provider_comparability", F.col("key")))
    against = an.contradictions(evidence, by)
    three = against.select(*by, F.when(F.col("provider_id") != "UNKNOWN", F.col("provider_id")).alias("provider_id"), *_finding(F.col("kind"), "non_contradiction", F.col("key")))
    names = evidence.where(F.col("source").startswith("dynamic_columns")).select(*by, key_of(F.col("key")).alias("_k")).distinct()
    had = evidence.where(F.col("provider_id").isNotNull()).select(*by, key_of(F.col("key")).alias("_k")).distinct()
    four = names.join(had, [*by, "_k"], "left_anti").select(*by, F.lit(None).cast("string").alias("provider_id"), *_finding("incomplete_reference", "column_without_value", F.col("_k")))
    return one.unionByName(two).unionByName(three).unionByName(four)


def assessed(evidence: DataFrame, gone: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Counts of each model and whether its evidence is sufficient."""
    n = lambda df, name: df.groupBy(*by).agg(F.count("*").alias(name))
    bad = found.where(F.col("kind") == "contradictory").groupBy(*by).agg(F.count("*").alias("contradictory"))
    every = n(evidence, "evidence").join(n(gone, "missing"), by, "left").join(n(found, "inconsistencies"), by, "left").join(bad, by, "left").na.fill(0)
    c = F.col
    return every.withColumn("level", an.sufficiency(c("evidence"), c("missing"), c("inconsistencies"), c("contradictory")))


def risks(gone: DataFrame, found: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """(risk_category, description, provider_id) of what is missing, inconsistent or not sufficient."""
    one = gone.select(*by, "provider_id", F.lit("documentation").alias("risk_category"), F.concat(F.lit("missing:"), F.col("expected_key")).alias("description"))
    two = found.select(*by, "provider_id", md.inconsistency_risk(F.col("kind"), F.col("criterion")).alias("risk_category"), F.concat_ws(":", "kind", "criterion", "subject").alias("description"))
    three = levels.where("level <> 'sufficient'").select(*by, F.lit(None).cast("string").alias("provider_id"), F.lit("information").alias("risk_category"), F.concat(F.lit("sufficiency:"), F.col("level")).alias("description"))
    return one.unionByName(two).unionByName(three)


def elements(requirements: DataFrame, by: list[str]) -> DataFrame:
    """Typed context elements of requirements (description; commercial, technical, inherited: maps); blank values go."""
    typed = lambda m, kind: F.transform(_fields(m), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), (F.lit(kind) if kind else md.element_type(e["key"])).alias("element_type")))
    text = F.array(F.struct(F.lit("description").alias("key"), F.col("description").alias("value"), F.lit("objective").alias("element_type")))
    none = F.lit(None).cast("array<struct<key:string,value:string,element_type:string>>")
    parts = [text, typed("commercial", "commercial_requirement"), typed("technical", "technical_requirement"), typed("inherited", None)]
    every = F.concat(*(F.coalesce(p.cast("array<struct<key:string,value:string,element_type:string>>"), none, F.array().cast("array<struct<key:string,value:string,element_type:string>>")) for p in parts))
    return requirements.select(*by, F.posexplode(every).alias("n", "x")).select(*by, "n", "x.*").where(tx.nonblank(F.col("value")))


def matches(context: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Which evidence (seq) each element (n) has: an equal or containing key, or an equal value, in the categories of its type.

    Keys are compared once for each distinct pair in a model; equal values are an equi-join.
    """
    e = context.select(*by, "n", "element_type", F.col("value").alias("_v"), key_of(F.col("key")).alias("_k"))
    v = evidence.select(*by, "seq", "provider_id", "category", F.col("value").alias("_ev"), key_of(F.col("key")).alias("_ek"))
    keys = v.select(*by, "_ek").distinct()
    near = e.select(*by, "_k").distinct().join(keys, by).where(F.contains("_k", "_ek") | F.contains("_ek", "_k"))
    by_key = e.join(near, [*by, "_k"]).join(v, [*by, "_ek"]).select(*by, "n", "element_type", "seq", "provider_id", "category")
    by_value = e.join(v.withColumnRenamed("_ev", "_v"), [*by, "_v"]).select(*by, "n", "element_type", "seq", "provider_id", "category")
    kind, category = F.col("element_type"), F.col("category")
    fits = F.when(kind.isin("commercial_requirement", "objective"), category.isin(*CONTEXT_COMMERCIAL)).when(kind == "technical_requirement", category.isin(*CONTEXT_TECHNICAL)).when(kind == "general_requirement", F.lit(True)).otherwise(category.isin(*CONTEXT_COMMERCIAL, *CONTEXT_TECHNICAL, "requirement_context"))
    return by_key.unionByName(by_value).where(fits).distinct()


def associations(context: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """A row for each element that has evidence: its type, the number of records, the first one and the providers."""
    sums = matched.groupBy(*by, "n").agg(F.count("*").alias("evidence_count"), F.min("seq").alias("first_seq"), F.array_join(F.array_sort(F.collect_set("provider_id")), ",").alias("providers"))
    kind = F.when(F.col("element_type") == "limitation", "limitation").otherwise("alignment")
    return context.join(sums, [*by, "n"]).select(*by, "n", "key", "element_type", kind.alias("association_type"), "evidence_count", "first_seq", "providers")


def gaps(requirements: DataFrame, context: DataFrame, linked: DataFrame, matched: DataFrame, evidence: DataFrame, at_risk: DataFrame, by: list[str]) -> DataFrame:
    """(gap_type, subject): elements without evidence (limitations aside), evidence without an element (metadata aside), models without any context, and differences among the risks."""
    seen = linked.select(*by, key_of(F.col("key")).alias("_k")).distinct()
    one = context.where("element_type <> 'limitation'").withColumn("_k", key_of(F.col("key"))).join(seen, [*by, "_k"], "left_anti").select(*by, F.lit("requirement_without_evidence").alias("gap_type"), F.col("key").alias("subject"))
    two = evidence.where("category <> 'metadata'").join(matched.select(*by, "seq").distinct(), [*by, "seq"], "left_anti").select(*by, F.lit("evidence_without_context").alias("gap_type"), F.col("key").alias("subject"))
    bare = requirements.where(~tx.nonblank(F.col("description"))).join(context.select(*by).distinct(), by, "left_anti")
    three = bare.select(*by, F.lit("insufficient_context_data").alias("gap_type"), F.lit("requirement_context").alias("subject"))
    four = at_risk.where(F.col("description").startswith("relevant_difference:")).select(*by, F.lit("quotation_requirement_difference").alias("gap_type"), F.col("risk_category").alias("subject"))
    return one.unionByName(two).unionByName(three).unionByName(four)


def explanations(evidence: DataFrame, gone: DataFrame, found: DataFrame, levels: DataFrame, at_risk: DataFrame, linked: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Segments of the nine sections (section, template, subject, provider_id)."""
    nobody = F.lit(None).cast("string").alias("provider_id")

    def part(df: DataFrame, section: str, template: str, subject: Column, provider: Column = nobody) -> DataFrame:
        return df.select(*by, F.lit(section).alias("section"), F.lit(template).alias("template"), subject.alias("subject"), provider.alias("provider_id"))

    c = F.col
    limits = open_.where(c("gap_type").isin("insufficient_context_data", "quotation_requirement_difference"))
    return reduce(
        DataFrame.unionByName,
        [
            part(levels, "analysis_summary", "analysis_summary", F.lit("model_analysis_summary")),
            part(evidence, "evidence_used", "evidence_used", c("key"), c("provider_id")),
            part(evidence.where("value <> ''"), "strength", "evidence_present", c("key"), c("provider_id")),
            part(gone, "weakness", "missing_evidence", c("expected_key"), c("provider_id")),
            part(found, "weakness", "inconsistency_detected", c("criterion")),
            part(at_risk, "risk", "risk_identified", c("risk_category"), c("provider_id")),
            part(levels, "consistency", "consistency_sufficiency", F.lit("sufficiency_assessment")),
            part(found, "consistency", "consistency_inconsistency", c("criterion")),
            part(linked, "context_influence", "context_association", c("key")),
            part(gone, "missing_information", "missing_evidence_information", c("expected_key"), c("provider_id")),
            part(open_, "missing_information", "contextual_gap", c("subject")),
            part(levels.where("level <> 'sufficient'"), "limitation", "insufficient_consistency", F.lit("consistency_sufficiency")),
            part(limits, "limitation", "context_limitation", c("subject")),
        ],
    )


def counters(segments: DataFrame, by: list[str]) -> DataFrame:
    """Segments of each provider by what they count as; risks count twice, as segments and as the risks themselves."""
    n = lambda section: F.sum((F.col("section") == section).cast("long"))
    named = segments.where(F.col("provider_id").isNotNull())
    return named.groupBy(*by, "provider_id").agg(n("evidence_used").alias("evidence"), n("strength").alias("strengths"), n("weakness").alias("weaknesses"), (2 * n("risk")).alias("risks"), n("missing_information").alias("missing"))


def actions(scenarios: DataFrame, gone: DataFrame, open_: DataFrame, by: list[str]) -> DataFrame:
    """Suggested actions of each model, in order: context to complete, documents to ask for; two default ones where information is insufficient and there are no others."""
    context = open_.where("gap_type = 'insufficient_context_data'").select(*by, F.lit(0).alias("_o"), F.format_string(COMPLETE_CONTEXT, "subject").alias("action"))
    lacking = gone.select(*by).unionByName(open_.select(*by)).distinct().select(*by, F.lit(1).alias("_o"), F.lit(ASK_MORE).alias("action"))
    own = context.unionByName(lacking)
    bare = scenarios.where("scenario = 'insufficient_information'").join(own.select(*by).distinct(), by, "left_anti")
    default = bare.select(*by, F.posexplode(F.array(*map(F.lit, DEFAULT_ACTIONS))).alias("_o", "action"))
    every = own.unionByName(default).distinct()
    return every.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy("_o", "action")).cast("long")).drop("_o")


def alternatives(scores: DataFrame, scenarios: DataFrame, by: list[str]) -> DataFrame:
    """The equivalent providers of models without a clear winner, with what tells them apart."""
    top = scenarios.where("scenario = 'equivalent_alternatives'").select(*by, F.col("score").alias("_top"))
    near = scores.join(top, by).where(F.col("_top") - F.col("score") <= an.EQUIVALENT_GAP)
    return near.select(*by, "provider_id", "score", F.format_string("Evidencias: %d, Riesgos: %d", "evidence", "risks").alias("difference"))


def result_lists(segments: DataFrame, at_risk: DataFrame, by: list[str]) -> DataFrame:
    """Strengths, weaknesses, risks and limitations of each model, each once and in order."""
    of = lambda section: F.array_sort(F.collect_set(F.when(F.col("section") == section, F.col("subject"))))
    lists = segments.groupBy(*by).agg(of("strength").alias("strengths"), of("weakness").alias("weaknesses"), of("limitation").alias("limitations"))
    risky = at_risk.groupBy(*by).agg(F.array_sort(F.collect_set("description")).alias("risks"))
    return lists.join(risky, by, "left")
