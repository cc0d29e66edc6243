"""Comparison models: structures, lookups, traceability, quality checks, risks, recommendations and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import analysis as an
from quotemill.operators.places import numbered_id, place

#: Attributes that name a field of the document, and words that type a context element.
ATTRIBUTES = {
    "provider": ("provider", "proveedor", "provider_name"),
    "currency": ("currency", "moneda"),
    "total": ("total", "total_amount", "monto", "importe"),
    "payment_terms": ("payment_terms", "pago", "condiciones"),
    "quantity": ("quantity", "cantidad"),
    "unit_price": ("unit_price", "precio", "precio_unitario"),
    "description": ("description", "descripcion", "item"),
    "file_name": ("document", "documento", "file_name"),
}
ELEMENT_WORDS = (("commercial_requirement", "comercial|precio|pago"), ("technical_requirement", "tecnico|technical|especific"), ("limitation", "limit|restric"))
FALLBACK_PROVIDER = "PROVEEDOR-1"


def with_id(rows: DataFrame, name: str, prefix: str, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with numbered ids in each lane ``by``."""
    return place(rows, by, order, "_place").withColumn(name, numbered_id(prefix, "_place")).drop("_place")


def seeded_concepts(concepts: DataFrame, items: DataFrame) -> DataFrame:
    """Concepts, and the items of documents that have none as concepts."""
    bare = items.join(concepts.select("document_id").distinct(), "document_id", "left_anti")
    names = ["document_id", "pos", "description"]
    return concepts.select(*names, F.lit(False).alias("seeded")).unionByName(bare.select(*names, F.lit(True).alias("seeded")))


def document_snapshot(concepts: DataFrame) -> DataFrame:
    """Concepts of each document and the types among them (of which there are a few)."""
    return concepts.groupBy("process_id", "document_id").agg(F.count("*").alias("concepts"), F.array_join(F.array_sort(F.collect_set("concept_type")), ",").alias("types"))


def structures(groups: DataFrame) -> DataFrame:
    """A table for each comparable group."""
    return with_id(groups.select("process_id", "group_id"), "table_id", "CTS", ["process_id"], ["group_id"])


def document_providers(documents: DataFrame) -> DataFrame:
    """Providers of each process by document, repeats kept; a process that names none has the fallback."""
    named = documents.where(tx.nonblank(F.col("provider_id")))
    bare = documents.select("process_id").distinct().join(named.select("process_id").distinct(), "process_id", "left_anti")
    return place(named, ["process_id"], ["document_id"]).select("process_id", "position", "provider_id").unionByName(bare.select("process_id", F.lit(1).cast("long").alias("position"), F.lit(FALLBACK_PROVIDER).alias("provider_id")))


def looked_up(rows: DataFrame, tables: DataFrame, on: list[str]) -> DataFrame:
    """Rows with whether their structure is there: one join serves the rows that are built and the incidents."""
    known = tables.select(*on).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, on, "left").withColumn("outcome", F.when(F.col("_known"), "built").otherwise("missing_structure")).drop("_known")


def inject_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The source map beside the rows; of entries of one provider the first counts, blank ones don't."""
    first = F.row_number().over(Window.partitionBy("provider_id").orderBy("position"))
    kept = sources.where(tx.nonblank(F.col("provider_id"))).withColumn("_n", first).where("_n = 1").select("provider_id", "document_count", (F.col("document_count") > 1).alias("ambiguous"))
    return rows.join(kept, "provider_id", "left")


def cell_value(attribute: Column, document: dict[str, Column], provider_id: Column) -> Column:
    """The document's field that an attribute names; the provider's id stands in for its name."""
    name, out = F.lower(F.trim(attribute)), F.lit("")
    for field, names in ATTRIBUTES.items():
        value = F.coalesce(F.nullif(document[field], F.lit("")), provider_id) if field == "provider" else F.coalesce(document[field], F.lit(""))
        out = F.when(name.isin(*names), value).otherwise(out)
    return out


def traced(tables: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """Tables with the number of their columns and rows, and whether they have both."""
    by = ["process_id", "group_id"]
    n = lambda d, name: d.groupBy(*by).agg(F.count("*").alias(name))
    both = tables.join(n(columns, "columns"), by, "left").join(n(rows, "rows"), by, "left").na.fill(0, ["columns", "rows"])
    return with_id(both.withColumn("integrity", (F.col("columns") > 0) & (F.col("rows") > 0)), "trace_id", "TME", ["process_id"], ["table_id"])


def definitive_models(tables: DataFrame, members: DataFrame) -> DataFrame:
    """Models with the documents of their group, each once and in order."""
    documents = members.groupBy("process_id", "group_id").agg(F.array_sort(F.collect_set("document_id")).alias("documents"))
    return with_id(tables.join(documents, ["process_id", "group_id"]), "model_id", "CMD", ["process_id"], ["table_id"])


def group_findings(rows: DataFrame, key: list[str], checks: dict[tuple[str, str], Column]) -> DataFrame:
    """A finding (category, severity) for each check that a row fails; the rows are read once."""
    found = F.array(*(F.when(c, F.struct(F.lit(name).alias("category"), F.lit(severity).alias("severity"))) for (name, severity), c in checks.items()))
    return rows.select(*key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*key, "x.*")


def repeated(by: list[str], order: list[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1


def set_counts(catalogs: dict[str, DataFrame]) -> DataFrame:
    """Size of each catalog and whether the sizes differ."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("catalog"), "n") for name, d in catalogs.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    whole = every.agg(F.collect_list(F.struct("catalog", "n")).alias("x"), (F.min("n") != F.max("n")).alias("mismatch"))  # a row for each catalog
    return whole.select(F.explode("x").alias("x"), "mismatch").select("x.catalog", "x.n", "mismatch")


def blank_fields(rows: DataFrame, key: list[str], required: list[str]) -> DataFrame:
    """Required fields that a row lacks."""
    gone = F.filter(F.array(*(F.when(~tx.nonblank(F.col(c)), F.lit(c)) for c in required)), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(gone).alias("field"))


def shared_ids(catalogs: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once over all catalogs."""
    every = None
    for name, d in catalogs.items():
        one = d.select("id", F.lit(name).alias("catalog"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("catalog").alias("catalogs")).where("n > 1")


def chain_quality(stages: dict[str, DataFrame]) -> DataFrame:
    """Rows of each process at each stage of the chain, and whether no stage after the first is empty where one before isn't."""
    every = None
    for name, d in stages.items():
        one = d.groupBy("process_id").agg(F.count("*").alias("n")).withColumn("stage", F.lit(name))
        every = one if every is None else every.unionByName(one)
    wide = every.groupBy("process_id").pivot("stage", list(stages)).agg(F.sum("n")).na.fill(0, list(stages))
    whole = F.lit(True)
    for s in stages:
        whole = whole & (F.col(s) > 0)
    return wide.withColumn("complete", whole)


def trace_issues(evidence: DataFrame, key: list[str]) -> DataFrame:
    """Evidence whose reference names another model or group, or no document."""
    checks = {("model_mismatch", "error"): ~F.col("trace_model").eqNullSafe(F.col("model_id")), ("group_mismatch", "error"): ~F.col("trace_group").eqNullSafe(F.col("group_id")), ("no_document", "error"): ~tx.nonblank(F.col("document_id"))}
    return group_findings(evidence, key, checks).drop("severity")


def inconsistency_risk(kind: Column, criterion: Column) -> Column:
    between = criterion.isin("commercial_technical_coherence", "provider_comparability")
    return (
        F.when(kind == "incomplete_reference", "documentation").when(kind == "relevant_difference", "information").when(kind == "inconsistent_attributes", "technical")
        .when(criterion == "commercial_technical_coherence", "commercial").when(criterion == "provider_comparability", "information")
        .when((kind == "incompatible") & between, "commercial").when(kind == "incompatible", "technical").otherwise("consistency")
    )


def risks(missing: DataFrame, inconsistencies: DataFrame, sufficiency: DataFrame) -> DataFrame:
    """(process_id, provider_id, risk_category) of missing categories, inconsistencies and whatever isn't sufficient."""
    one = missing.select("process_id", "provider_id", F.lit("documentation").alias("risk_category"))
    two = inconsistencies.select("process_id", "provider_id", inconsistency_risk(F.col("kind"), F.col("criterion")).alias("risk_category"))
    three = sufficiency.where("level <> 'sufficient'").select("process_id", "provider_id", F.lit("information").alias("risk_category"))
    return one.unionByName(two).unionByName(three)


def element_type(key: Column) -> Column:
    low = F.lower(F.trim(key))
    out = F.lit("general_requirement")
    for name, words in reversed(ELEMENT_WORDS):
        out = F.when(low.rlike(words), name).otherwise(out)
    return out


def coverage(counters: DataFrame, by: list[str]) -> DataFrame:
    """Evidence and gaps, and the share of evidence among both (0 where there is neither)."""
    total = F.col("total_evidence") + F.col("total_missing")
    sums = counters.groupBy(*by).agg(F.sum("evidence").alias("total_evidence"), F.sum("missing").alias("total_missing"))
    return sums.withColumn("ratio", F.when(total > 0, F.col("total_evidence") / total).otherwise(0.0))


def recommendation(scores: DataFrame) -> DataFrame:
    """The scenario of each process with the winner, where one is clear, and the number of equivalent providers, where none is."""
    decided = an.scenario(scores)
    near = scores.join(decided.select("process_id", F.col("score").alias("_top"), "scenario"), "process_id").where((F.col("_top") - F.col("score") <= an.EQUIVALENT_GAP) & (F.col("scenario") == "equivalent_alternatives"))
    alternatives = near.groupBy("process_id").agg(F.count("*").alias("alternatives"))
    winner = F.when(F.col("scenario") == "clear_winner", F.col("first_provider"))
    return decided.join(alternatives, "process_id", "left").select("process_id", "scenario", winner.alias("recommended"), F.coalesce("alternatives", F.lit(0)).alias("alternatives"))


def distinct_in_order(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Values of a group, each once, by where it comes first."""
    firsts = rows.groupBy(*by, value).agg(F.min(order).alias("_first"))
    return place(firsts, by, ["_first", value]).drop("_first")
