"""Analysis of evidence: categories, consistency, sufficiency, risk, context, scores and recommendation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Keywords of the evidence categories, in the order in which they are tried.
KEYWORDS = (
    ("delivery_times", ("entrega", "delivery", "plazo", "tiempo", "lead_time")),
    ("warranties", ("garantia", "garantía", "warranty", "garant")),
    ("certifications", ("certificacion", "certificación", "certification", "iso", "norma")),
    ("observations", ("observacion", "observación", "observation", "nota", "comentario")),
    ("restrictions", ("restriccion", "restricción", "restriction", "exclusion", "limite", "límite")),
    ("commercial_conditions", ("condicion", "condición", "condition", "pago", "payment", "moneda", "currency", "precio", "price", "total")),
)
#: Sources that decide before and after the keywords.
CONTEXT_SOURCES = ("inherited_context", "requirement_context")
METADATA_SOURCES = ("metadata", "motor_internal_references", "model_metadata")
TECHNICAL_SOURCES = ("technical_information", "technical_information.fields", "technical_information.specifications")
COMMERCIAL_SOURCES = ("commercial_information", "commercial_information.fields")
CATEGORIES = ("commercial_information", "technical_information", "commercial_conditions", "delivery_times", "warranties", "certifications", "observations", "restrictions", "requirement_context", "metadata")
#: Thresholds of sufficiency, scenarios and confidence.
MAX_MISSING, MAX_INCONSISTENCIES = 50, 100
WINNER_GAP, EQUIVALENT_GAP, MIN_EVIDENCE, MAX_MISSING_RATIO = 2.0, 1.0, 1, 0.6
HIGH_COVERAGE, MEDIUM_COVERAGE, HIGH_RISKS, HIGH_GAPS, HIGH_INCONSISTENCIES = 0.8, 0.5, 2, 1, 1


def evidence_category(key: Column, source: Column) -> Column:
    k, s = F.lower(F.trim(key)), F.lower(F.trim(source))
    out = F.when(s.isin(*CONTEXT_SOURCES), "requirement_context").when(s.isin(*METADATA_SOURCES), "metadata")
    for name, words in KEYWORDS:
        out = out.when(k.rlike("|".join(words)), name)
    dynamic, organized = s.startswith("dynamic_columns"), s.startswith("provider_organization")
    return (
        out.when(s.isin(*TECHNICAL_SOURCES), "technical_information").when(s.isin(*COMMERCIAL_SOURCES), "commercial_information")
        .when(dynamic & F.contains(k, F.lit("technical")), "technical_information").when(dynamic, "commercial_information")
        .when(organized & F.contains(s, F.lit("technical")), "technical_information").when(organized, "commercial_information").otherwise("metadata")
    )


def missing_categories(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Categories that a model has no evidence of."""
    every = evidence.select(*by).distinct().withColumn("category", F.explode(F.array(*map(F.lit, CATEGORIES))))
    return every.join(evidence.select(*by, "category").distinct(), [*by, "category"], "left_anti")


def last_values(evidence: DataFrame, by: list[str]) -> DataFrame:
    """The last value of each key."""
    return evidence.groupBy(*by).agg(F.max_by("value", "seq").alias("value"))


def comparability(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Keys that some of a model's providers have and others lack; models of one provider have none."""
    providers = evidence.groupBy(*by).agg(F.countDistinct("provider_id").alias("providers"))
    keys = evidence.groupBy(*by, "key").agg(F.countDistinct("provider_id").alias("present"))
    return keys.join(providers, by).where("providers >= 2 and present < providers")


def contradictions(evidence: DataFrame, by: list[str]) -> DataFrame:
    """Keys of a provider with several values in one category, or with several categories."""
    seen = evidence.groupBy(*by, F.coalesce("provider_id", F.lit("UNKNOWN")).alias("provider_id"), "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.countDistinct("category").alias("n_categories"))
    kind = F.when(F.col("n_categories") > 1, "incompatible").when(F.col("n_values") > 1, "contradictory")
    return seen.where("n >= 2").withColumn("kind", kind).where("kind is not null").drop("n")


def sufficiency(evidence: Column, missing: Column, inconsistencies: Column, contradictory: Column) -> Column:
    blocked = (missing > MAX_MISSING) | (inconsistencies > MAX_INCONSISTENCIES)
    return F.when((evidence == 0) | (contradictory > 0), "insufficient").when(blocked | (missing > 0) | (inconsistencies > 0), "partial").otherwise("sufficient")


def provider_scores(counters: DataFrame) -> DataFrame:
    """Score of each provider: evidence and strengths less weaknesses, risks and missing; null providers are UNKNOWN."""
    names = ["evidence", "strengths", "weaknesses", "risks", "missing"]
    summed = counters.groupBy("process_id", F.coalesce("provider_id", F.lit("UNKNOWN")).alias("provider_id")).agg(*(F.sum(n).cast("long").alias(n) for n in names))
    return summed.withColumn("score", (F.col("evidence") + F.col("strengths") - F.col("weaknesses") - F.col("risks") - F.col("missing")).cast("double"))


def scenario(scores: DataFrame) -> DataFrame:
    """The decision of each process: by the gap between its first two providers, after the guards."""
    order = Window.partitionBy("process_id").orderBy(F.desc("score"), "provider_id")
    ranked = scores.withColumn("rank", F.row_number().over(order)).withColumn("next_score", F.lead("score").over(order))
    totals = Window.partitionBy("process_id")
    ranked = ranked.withColumn("total_evidence", F.sum("evidence").over(totals)).withColumn("total_missing", F.sum("missing").over(totals))
    gap = F.col("score") - F.col("next_score")
    poor = (F.col("total_evidence") < MIN_EVIDENCE) | (F.col("evidence") < MIN_EVIDENCE) | (F.col("total_missing") > MAX_MISSING_RATIO * (F.col("total_evidence") + F.col("total_missing")))
    kind = F.when(poor, "insufficient_information").when(F.col("next_score").isNull() | (gap >= WINNER_GAP), "clear_winner").when(gap <= EQUIVALENT_GAP, "equivalent_alternatives").otherwise("clear_winner")
    return ranked.where("rank = 1").select("process_id", F.col("provider_id").alias("first_provider"), "score", gap.alias("gap"), kind.alias("scenario"))


def confidence(coverage: Column, sufficient: Column, risks: Column, gaps: Column, inconsistencies: Column) -> Column:
    high = sufficient & (coverage >= HIGH_COVERAGE) & (risks <= HIGH_RISKS) & (gaps <= HIGH_GAPS) & (inconsistencies <= HIGH_INCONSISTENCIES)
    return F.when(high, "high").when(sufficient & (coverage >= MEDIUM_COVERAGE), "medium").otherwise("low")


def context_matches(elements: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """Context elements with evidence of an equal key, a key that holds the other, or an equal value; always within ``by``.

    Keys are compared once for each distinct pair; equal values are an equi-join.
    """
    e = elements.select(*by, F.col("key").alias("element"), F.col("value").alias("_v"))
    v = evidence.select(*by, "key", F.col("value").alias("_v"))
    near = e.select(*by, "element").distinct().join(v.select(*by, "key").distinct(), by).where(F.contains("element", "key") | F.contains("key", "element"))
    same = e.join(v, [*by, "_v"]).select(*by, "element", "key")
    return near.select(*by, "element", "key").unionByName(same).distinct()
