"""Quality of models and catalogs: checks (passed or not) and findings (with a severity)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quotemill.functions import text as tx

#: Types of groups, fields that catalogs, models and traces must have, components and phases of both pipelines.
GROUP_TYPES = ("material", "service")
CATALOG_FIELDS = ("catalog_id", "process_id", "model_id", "document_id", "source_context_association_catalog_id")
MODEL_FIELDS = ("comparative_model_id", "group_id", "group_type", "primary_item", "equivalent_concepts", "traceability", "related_context")
TRACE_FIELDS = ("source_context_association_catalog_id", "source_comparable_group_catalog_id", "document_reference", "canonical_reference", "equivalence_ids", "concept_ids", "normalized_concept_ids")
CLASSIFICATION_COMPONENTS = ("concept_analysis_engine", "material_classification_engine", "service_classification_engine", "concept_normalization_engine", "equivalence_detection_engine", "comparable_group_builder", "context_association_engine", "comparative_domain_model_builder")
COMPARISON_COMPONENTS = ("comparative_structure_engine", "dynamic_column_builder", "dynamic_row_builder", "provider_organization_engine", "group_integrity_engine", "traceability_metadata_engine", "comparative_model_builder", "comparative_validation_framework")
COMPARISON_PHASES = ("estructura_comparativa", "construccion_columnas", "construccion_filas", "organizacion_proveedores", "integridad_grupos", "trazabilidad_metadatos", "modelo_comparativo", "validacion_comparativa")
DEFINITIVE_TRACE = ("document_evidence", "comparable_group", "domain_catalog_id", "source_structure_catalog_id", "source_column_catalog_id", "source_row_catalog_id", "source_provider_catalog_id", "lineage")
REPORT_FIELDS = ("report_id", "process_id", "model_id", "document_id", "traceability")
INTERNAL_REFERENCES = ("enriched_catalog_id", "structure_catalog_id", "integrity_report_id")


def present(df: DataFrame, name: str) -> Column:
    """Whether a field has a value: not null, not blank, not empty."""
    kind = df.schema[name].dataType.typeName()
    c = F.col(name)
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind in ("array", "map") else c.isNotNull() if kind == "struct" else tx.nonblank(c.cast("string"))


def checks(rows: DataFrame, target: str, validator: str, tests: dict[str, Column], severities: dict[str, str] | None = None) -> DataFrame:
    """A row for each test of each row: validator, check_name, target_id, passed and the severity where it failed."""
    severities = severities or {}
    made = F.array(*(F.struct(F.lit(n).alias("check_name"), F.coalesce(t, F.lit(False)).alias("passed"), F.lit(severities.get(n, "error")).alias("s")) for n, t in tests.items()))
    out = rows.select(F.col(target).cast("string").alias("target_id"), F.explode(made).alias("x"))
    return out.select(F.lit(validator).alias("validator"), "x.check_name", "target_id", "x.passed", F.when(~F.col("x.passed"), F.col("x.s")).alias("severity"))


def unique_ids(rows: DataFrame, validator: str, target: str, names: list[str]) -> DataFrame:
    """Whether each kind of id occurs once over all rows, blank ones aside."""
    sums = rows.agg(*(F.count(F.when(present(rows, n), F.col(n))).alias(f"n_{n}") for n in names), *(F.countDistinct(F.when(present(rows, n), F.col(n))).alias(f"d_{n}") for n in names)).withColumn("_t", F.lit(target))
    return checks(sums, "_t", validator, {f"{n}_unique": F.col(f"n_{n}") == F.col(f"d_{n}") for n in names})


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def pipeline_checks(spark: SparkSession, validator: str, target: str, snapshot: list[dict], components: tuple[str, ...], phases: tuple[str, ...], ready_phase: str, required: bool = False) -> DataFrame:
    """Checks of a pipeline's snapshot (stages with phase, component_name and component_ready): a few rows that the driver has."""
    rows = []
    add = lambda name, on, ok, severity=None: rows.append((validator, name, on, bool(ok), None if ok else severity))
    if not snapshot:
        add("pipeline_snapshot_provided", target, not required, "warning")
    else:
        ready = {s.get("component_name") for s in snapshot if s.get("component_ready") is True}
        seen = [s["phase"] for s in snapshot if s.get("phase")]
        for c in components:
            add(f"pipeline_component_{c}", c, c in ready, "warning")
        for p in phases:
            add(f"pipeline_phase_{p}", p, p in seen)
        first = next((s for s in snapshot if s.get("phase") == ready_phase), {})
        add("stage_ready", ready_phase, first.get("component_ready") is True)
        if phases:
            add("no_duplicate_pipeline_phases", target, len(seen) == len(set(seen)))
    return spark.createDataFrame(rows, "validator string, check_name string, target_id string, passed boolean, severity string")


def classification_quality(models: DataFrame, catalog: DataFrame, snapshot: list[dict], require_context: bool = True) -> DataFrame:
    """The five validators of a classification: consistency, integrity, uniqueness, traceability and pipeline.

    ``models``: MODEL_FIELDS, internal_model_id, and ``traceability`` as a struct of TRACE_FIELDS, group_id,
    original_preserved and context_preserved; ``related_context``: its description. ``catalog``: one row of
    CATALOG_FIELDS, output_contract and source_data_preserved.
    """
    t = lambda name: F.col(f"traceability.{name}")
    flat = models.select("*", *(t(n).alias(f"_{n}") for n in TRACE_FIELDS))
    fields = {f"model_field_{n}": present(models, n) for n in MODEL_FIELDS}
    traces = {f"traceability_{n}": present(flat, f"_{n}") for n in TRACE_FIELDS}
    return _union([
        checks(catalog, "catalog_id", "model_consistency", {"output_contract": F.col("output_contract")}),
        checks(models, "comparative_model_id", "model_consistency", {"group_type_valid": F.col("group_type").isin(*GROUP_TYPES), "group_id_traceability_match": t("group_id").eqNullSafe(F.col("group_id")), "related_context_present": tx.nonblank(F.col("related_context"))}, {"related_context_present": "warning" if require_context else "none"}),
        checks(catalog, "catalog_id", "data_integrity", {f"catalog_field_{n}": present(catalog, n) for n in CATALOG_FIELDS} | {"source_data_preserved": F.col("source_data_preserved")}),
        checks(models, "comparative_model_id", "data_integrity", fields),
        unique_ids(models, "identifier_uniqueness", "catalog", ["comparative_model_id", "internal_model_id", "group_id"]),
        checks(flat, "comparative_model_id", "traceability_chain", traces | {"original_preserved": t("original_preserved"), "context_preserved": t("context_preserved")}, dict.fromkeys(traces, "warning")),
        pipeline_checks(models.sparkSession, "pipeline_flow", "catalog", snapshot, CLASSIFICATION_COMPONENTS, (), "modelo_dominio"),
    ])


def comparison_quality(settings: dict, models: DataFrame, report: DataFrame, snapshot: list[dict]) -> DataFrame:
    """The six validators of a comparison: architecture, model consistency, report integrity, uniqueness, traceability and pipeline.

    ``models``: definitive_model_id, comparative_table_id, group_id, the other required fields, and ``traceability`` as a
    struct of DEFINITIVE_TRACE (comparable_group: its id; document_evidence: a struct). ``report``: one row.
    """
    spark = models.sparkSession
    names = [s["component_name"] for s in snapshot if s.get("component_name")]
    limits = all(settings.get(k, 0) > 0 for k in ("max_tables_per_process", "max_groups_per_process", "max_providers_per_process"))
    own = {"modular_components_defined": len(COMPARISON_COMPONENTS) >= 8, "scalability_limits_configured": limits, "centralized_configuration_enabled": settings.get("enabled", True), "non_destructive_audit": settings.get("preserve_catalog_immutability", True), "extension_points_prepared": settings.get("module_certification_prepared", True)}
    own |= {"single_responsibility_components": len(names) == len(set(names))} if snapshot else {}
    severity = {"scalability_limits_configured": "error", "single_responsibility_components": "warning"}
    architecture = spark.createDataFrame([("architectural_compliance", n, "catalog", bool(ok), None if ok else severity.get(n)) for n, ok in own.items()], "validator string, check_name string, target_id string, passed boolean, severity string")
    t = lambda name: F.col(f"traceability.{name}")
    flat = models.select("*", *(t(n).alias(f"_{n}") for n in DEFINITIVE_TRACE))
    required = [c for c in models.columns if c not in ("traceability",)]
    trace = {f"traceability_{n}": present(flat, f"_{n}") for n in DEFINITIVE_TRACE}
    return _union([
        architecture,
        checks(models, "definitive_model_id", "definitive_model_consistency", {f"model_field_{n}": present(models, n) for n in required} | {"group_id_traceability_match": t("comparable_group").eqNullSafe(F.col("group_id"))}),
        checks(report, "report_id", "validation_report_integrity", {f"validation_report_{n}": present(report, n) for n in REPORT_FIELDS} | {"validation_check_sets_present": F.col("check_sets") > 0, "quality_framework_prepared": F.col("prepared"), "definitive_catalog_preserved": F.col("preserved")}),
        unique_ids(models, "identifier_uniqueness", "catalog", ["definitive_model_id", "comparative_table_id", "group_id"]),
        checks(flat, "definitive_model_id", "traceability_chain", trace, dict.fromkeys(trace, "warning")),
        pipeline_checks(spark, "pipeline_flow", "catalog", snapshot, COMPARISON_COMPONENTS, COMPARISON_PHASES, "validacion_comparativa"),
    ])


def validate_models(models: DataFrame, columns: DataFrame, rows: DataFrame, providers: DataFrame, required: list[str]) -> DataFrame:
    """Findings (model_id, validator, severity, subject) of the six validators of definitive models.

    ``models``: model_id, group_id, table_id, ``required`` fields, document_id and trace_group of the trace, and references
    (map); ``columns``: model_id, column_id; ``rows``: model_id, row_id, column_references; ``providers``: model_id,
    provider_id, row_id, column_references. ``n`` orders the rows of the last three in their model.
    """
    found = lambda df, validator, severity, subject: df.select("model_id", F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))

    def broken(tests: dict[str, Column], validator: str, severity: str) -> DataFrame:
        bad = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in tests.items())))
        return found(models.select("model_id", F.explode(bad).alias("x")), validator, severity, F.col("x"))

    arrays = {n for n in required if models.schema[n].dataType.typeName() in ("array", "map")}
    blank = {n: ~present(models, n) for n in required}
    refs = lambda df, name: df.select("model_id", F.col(name).alias("of"), F.explode("column_references").alias("column_id"))
    known = columns.select("model_id", "column_id").where(tx.nonblank(F.col("column_id"))).distinct()
    row_refs = refs(rows, "row_id")
    pair = lambda *c: F.concat_ws(":", *c)
    again = lambda df, key: df.withColumn("_again", F.row_number().over(Window.partitionBy("model_id", key).orderBy("n")) > 1).where("_again").where(tx.nonblank(F.col(key)))
    known_rows = rows.select("model_id", "row_id").distinct()
    named = providers.withColumn("_key", F.lower(tx.strip(F.col("provider_id"))))
    everywhere = models.select("model_id", F.explode(F.array(*(F.struct(F.lit(n).alias("kind"), F.col(n).cast("string").alias("id")) for n in ("model_id", "table_id", "group_id")))).alias("x")).select("model_id", "x.*")
    repeated = everywhere.withColumn("_n", F.row_number().over(Window.partitionBy("kind", "id").orderBy("model_id"))).where("_n > 1")
    return _union([
        broken({n: ~present(models, n) for n in ("model_id", "group_id", "table_id")}, "structure", "error"),
        broken({n: c for n, c in blank.items() if n not in arrays}, "completeness", "error"),
        broken({n: F.coalesce(c, F.lit(True)) for n, c in blank.items() if n in arrays}, "completeness", "warning"),
        found(row_refs.join(known, ["model_id", "column_id"], "left_anti"), "integrity", "error", pair("of", "column_id")),
        found(known.join(row_refs.select("model_id", "column_id").distinct(), ["model_id", "column_id"], "left_anti"), "integrity", "warning", F.col("column_id")),
        found(providers.where(tx.nonblank(F.col("row_id"))).join(known_rows, ["model_id", "row_id"], "left_anti"), "integrity", "error", pair("provider_id", "row_id")),
        found(refs(providers, "provider_id").join(known, ["model_id", "column_id"], "left_anti"), "integrity", "error", pair("of", "column_id")),
        found(again(columns, "column_id"), "consistency", "error", F.col("column_id")),
        found(again(rows, "row_id"), "consistency", "error", F.col("row_id")),
        found(again(named, "_key"), "consistency", "error", F.col("provider_id")),
        broken({"document": ~tx.nonblank(F.col("document_id"))}, "traceability", "error"),
        broken({"group": ~tx.nonblank(F.col("trace_group"))} | {n: ~tx.nonblank(F.col("references")[n]) for n in INTERNAL_REFERENCES}, "traceability", "warning"),
        found(repeated, "uniqueness", "error", pair("kind", "id")),
    ])


def verdicts(models: DataFrame, findings: DataFrame) -> DataFrame:
    """Whether each model is valid: no finding of it is an error."""
    bad = findings.groupBy("model_id").agg(F.sum((F.col("severity") == "error").cast("long")).alias("errors"), F.sum((F.col("severity") == "warning").cast("long")).alias("warnings"))
    return models.select("model_id").join(bad, "model_id", "left").na.fill(0, ["errors", "warnings"]).withColumn("valid", F.col("errors") == 0)
