"""Queries of rules over tables of cases, whose results are written beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import analysis as an
from quotemill.operators import documents as dc
from quotemill.operators import models as md
from quotemill.operators import opslog as ops
from quotemill.plans.registry import query
from quotemill.sources.fixtures import cases, values

_SNIFF = [
    ("text/plain", "a.pdf", "text"), ("text/markdown", None, "text"), ("TEXT/HTML", "x.docx", "text"), ("application/pdf", "a.txt", "pdf"), ("application/msword", None, "docx"),
    ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "", "docx"), ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "", "xlsx"), ("application/vnd.ms-excel", "b", "xlsx"), ("image/png", "c.pdf", "image"), ("image/svg+xml", None, "image"),
    (None, "A.PDF", "pdf"), ("", "b.Docx", "docx"), ("", "b.doc", "docx"), (None, "c.xls", "xlsx"), (None, "c.XLSX", "xlsx"), ("", "d.png", "image"), ("", "d.jpeg", "image"), ("", "d.webp", "image"), (None, "e.txt", "text"), (None, "f.zip", "pdf"), (None, None, "pdf"), ("application/octet-stream", "g.jpg", "image"), ("", ".txt.bin", "pdf"),
]


def _numbered(rows):
    return [(i, *r) for i, r in enumerate(rows)]


def _expected(rows, *names):
    """The case's number and the last columns."""
    return values(["n", *names], [(i, *r[-len(names) :]) for i, r in enumerate(rows)])


@query(_expected(_SNIFF, "format"))
def format_sniff_cases(spark, d):
    return cases(spark, "n int, content_type string, file_name string, want string", _numbered(_SNIFF)).select("n", tx.sniff_format(F.col("content_type"), F.col("file_name")).alias("format"))


_REFERENCES = [(["r1", "r2"], ["m"], ["x"], ["d"], "r1,r2"), ([], ["m1", "m2"], ["x"], ["d"], "m1,m2"), (None, None, ["x1"], ["d"], "x1"), (None, [], None, ["d1", "d2"], "d1,d2"), ([], [], [], [], "")]


@query(_expected(_REFERENCES, "reference"))
def evidence_fallback_cases(spark, d):
    rows = cases(spark, "n int, explicit array<string>, metadata array<string>, nested array<string>, ids array<string>, want string", _numbered(_REFERENCES))
    return rows.select("n", F.array_join(dc.first_references([F.col(c) for c in ("explicit", "metadata", "nested", "ids")]), ",").alias("reference"))


_ADAPTERS = [("pdf", "resolved"), ("word", "resolved"), ("image", "resolved"), ("excel", "disabled"), ("text", "unregistered"), (None, "unregistered"), ("PDF", "unregistered")]


@query(_expected(_ADAPTERS, "adapter"))
def adapter_resolution_cases(spark, d):
    return cases(spark, "n int, format string, want string", _numbered(_ADAPTERS)).select("n", dc.adapter(F.col("format"), ("pdf", "word", "image")).alias("adapter"))


_RECOGNISED = [
    ("%PDF-1.7", None, "a.pdf", "application/pdf", "pdf", 0.98), ("PK\x03\x04", None, "a.xlsx", None, "word", 0.98), ("D0CF11E0A1", "excel", "a.xls", None, "word", 0.98), ("89504E47", "pdf", None, None, "image", 0.98), ("xx", "pdf", "a.png", "image/png", "pdf", 0.95),
    ("", None, "A.XLSX", "application/pdf", "excel", 0.9), (None, None, "scan.tiff", None, "image", 0.9), (None, None, "none", "IMAGE/JPEG", "image", 0.85), (None, None, "a.bin", "application/msword", "word", 0.85), (None, None, None, "text/x", None, None), (None, None, None, None, None, None),
]


@query(_expected(_RECOGNISED, "format", "confidence"))
def recognition_cases(spark, d):
    rows = cases(spark, "n int, signature string, declared string, file_name string, mime string, want string, sure double", _numbered(_RECOGNISED))
    best = ops.recognized(F.col("signature"), F.col("declared"), F.col("file_name"), F.col("mime"))
    return rows.select("n", best["format"].alias("format"), best["confidence"].alias("confidence"))


_RULES = [
    (False, 10, True, False, False, False, "pdf", "", "", "passed"), (True, 10, True, False, False, False, "pdf", "corrupt", "", "failed"), (False, 0, True, False, False, False, "word", "empty,invalid_size", "", "failed"), (False, 50_000_000, True, False, False, False, "excel", "", "", "passed"), (False, 50_000_001, True, False, False, False, "excel", "invalid_size", "", "failed"),
    (False, 9, False, True, True, False, "image", "inaccessible,incomplete,inconsistent", "", "failed"), (False, 9, True, False, False, True, "pdf", "", "illegible", "warning"), (False, 9, True, False, False, True, "other", "unsupported_format", "illegible", "failed"),
]


@query(_expected(_RULES, "incidents", "warnings", "status"))
def validation_cases(spark, d):
    rows = cases(spark, "n int, corrupt boolean, size long, accessible boolean, incomplete boolean, inconsistent boolean, illegible boolean, format string, i string, w string, s string", _numbered(_RULES))
    doc = {k: F.col(k) for k in ("corrupt", "size", "accessible", "incomplete", "inconsistent", "illegible", "format")}
    broken, warned = ops.incidents(doc), ops.warnings(doc)
    return rows.select("n", F.array_join(broken, ",").alias("incidents"), F.array_join(warned, ",").alias("warnings"), ops.validation_status(F.size(broken), F.size(warned)).alias("status"))


_CATEGORIES = [
    ("Plazo_Entrega", "commercial_information", "delivery_times"), ("lead_time", "x", "delivery_times"), ("garantía", "dynamic_columns", "warranties"), ("entrega", "metadata", "metadata"), ("precio", "inherited_context", "requirement_context"), ("ISO 9001", "provider_organization", "certifications"), ("norma", "", "certifications"),
    ("nota", "commercial_information", "observations"), ("límite", "x", "restrictions"), ("forma de pago", "x", "commercial_conditions"), ("total", "technical_information", "commercial_conditions"), ("color", "technical_information.fields", "technical_information"), ("color", "commercial_information.fields", "commercial_information"), ("technical_color", "dynamic_columns.x", "technical_information"),
    ("color", "dynamic_columns.x", "commercial_information"), ("peso", "provider_organization.technical_information.fields", "technical_information"), ("peso", "provider_organization.commercial_information.fields", "commercial_information"), ("peso", "elsewhere", "metadata"), ("peso", "Motor_Internal_References", "metadata"),
]


@query(_expected(_CATEGORIES, "category"))
def evidence_category_cases(spark, d):
    return cases(spark, "n int, key string, source string, want string", _numbered(_CATEGORIES)).select("n", an.evidence_category(F.col("key"), F.col("source")).alias("category"))


_CELLS = [(a, v) for v, names in (("ACME", ("Proveedor", " provider ", "provider_name")), ("USD", ("moneda", "CURRENCY")), ("10.50", ("total", "monto", "importe", "total_amount")), ("30 dias", ("pago", "condiciones", "payment_terms")), ("3", ("cantidad", "quantity")), ("2.00", ("precio", "unit_price", "precio_unitario")), ("Tubo", ("item", "descripcion", "description")), ("a.pdf", ("documento", "file_name", "document")), ("", ("color", "group_type", ""))) for a in names]


@query(_expected(_CELLS, "value"))
def cell_value_cases(spark, d):
    document = {k: F.lit(v) for k, v in {"provider": "ACME", "currency": "USD", "total": "10.50", "payment_terms": "30 dias", "quantity": "3", "unit_price": "2.00", "description": "Tubo", "file_name": "a.pdf"}.items()}
    return cases(spark, "n int, attribute string, want string", _numbered(_CELLS)).select("n", md.cell_value(F.col("attribute"), document, F.lit("P1")).alias("value"))


_ELEMENTS = [("condicion_comercial", "commercial_requirement"), ("Precio_max", "commercial_requirement"), ("forma pago", "commercial_requirement"), ("especificacion", "technical_requirement"), ("detalle Tecnico", "technical_requirement"), ("technical sheet", "technical_requirement"), ("limite_plazo", "limitation"), ("restriccion", "limitation"), ("precio limite", "commercial_requirement"), ("marca", "general_requirement"), ("", "general_requirement")]


@query(_expected(_ELEMENTS, "element_type"))
def context_element_cases(spark, d):
    return cases(spark, "n int, key string, want string", _numbered(_ELEMENTS)).select("n", md.element_type(F.col("key")).alias("element_type"))


_TRACES = [("M", "G", "M", "G", "d", ""), ("M", "G", "N", "G", "d", "model_mismatch"), ("M", "G", None, "G", "d", "model_mismatch"), ("M", "G", "M", "H", " ", "group_mismatch,no_document"), ("M", "G", "M", "G", None, "no_document")]


@query("SELECT n, unnest(string_split(c, ',')) AS category FROM (" + values(["n", "c"], [(i, r[-1]) for i, r in enumerate(_TRACES) if r[-1]]) + ")")
def integrity_cases(spark, d):
    rows = cases(spark, "n int, model_id string, group_id string, trace_model string, trace_group string, document_id string, want string", _numbered(_TRACES))
    return md.trace_issues(rows, ["n"])


_ERRORS = [
    ("Required_Field_Missing", "timeout", "validation", "warning", "terminal_failure"), ("", "Timeout in connection", "temporary", "warning", "retry"), ("x", "documento sin evidencia", "documental", "warning", "terminal_failure"), ("", "nada", "system_internal", "critical", "terminal_failure"), ("operation_not_executed", "", "processing", "error", "retry"), ("api_not_initialized", "valid", "communication", "error", "retry"),
    (None, "fallo de conexion", "communication", "error", "retry"), (None, "campo mal", "validation", "warning", "terminal_failure"), (None, "daño irrecuperable", "permanent", "critical", "terminal_failure"), (None, "pipeline roto", "processing", "error", "retry"), (None, None, "system_internal", "critical", "terminal_failure"),
]


@query("WITH e AS (" + _expected(_ERRORS, "category", "severity", "decision") + ") SELECT n, attempt, category, severity, CASE WHEN decision = 'retry' AND attempt > 3 THEN 'cancel' ELSE decision END AS decision FROM e, (SELECT unnest([1, 3, 4]) AS attempt)")
def fault_cases(spark, d):
    rows = cases(spark, "n int, code string, description string, c string, s string, w string", _numbered(_ERRORS)).withColumn("attempt", F.explode(F.array(F.lit(1), F.lit(3), F.lit(4))))
    category = ops.error_category(F.col("code"), F.col("description"))
    return rows.select("n", "attempt", category.alias("category"), ops.severity(category).alias("severity"), ops.recovery(category, F.col("attempt")).alias("decision"))


_PHASES = [
    ("start_analysis", None, "solicitud_recibida", True), ("start_analysis", "solicitud_aceptada", "procesamiento_iniciado", True), ("start_analysis", "solicitud_aceptada", "resultado_generado", False), ("query_status", "solicitud_aceptada", "resultado_entregado", True), ("query_result", "solicitud_aceptada", "resultado_entregado", False), ("validate_request", "solicitud_aceptada", "proceso_finalizado", True),
    ("cancel_analysis", "solicitud_recibida", "error_controlado", True), ("start_analysis", "resultado_generado", "error_controlado", True), ("start_analysis", "proceso_finalizado", "solicitud_recibida", False), ("other", None, "solicitud_recibida", False),
]


@query(_expected(_PHASES, "valid"))
def phase_cases(spark, d):
    return cases(spark, "n int, operation string, before string, after string, want boolean", _numbered(_PHASES)).select("n", ops.valid_phase(F.col("operation"), F.col("before"), F.col("after")).alias("valid"))


_ENQUEUED = [("p1", "ecg", "accepted"), ("p2", "web", "rejected_source"), ("p1", "ecg", "already_queued"), ("p3", "ecg", "accepted"), ("p4", "ecg", "queue_full"), ("p3", "ecg", "already_queued")]


@query(values(["n", "outcome"], [(i, r[-1]) for i, r in enumerate(_ENQUEUED)]))
def enqueue_cases(spark, d):
    return ops.enqueue(cases(spark, "n int, process_id string, source string, want string", _numbered(_ENQUEUED)), "process_id", ["n"], depth=2).select("n", "outcome")


_RESPONSES = [("p1", "request", "a", ""), ("p1", "response", "a", ""), ("p2", "response", "a", "inconsistent_response"), ("", "request", "a", "missing_id"), ("p3", "request", None, "")]


@query(values(["n", "issues"], [(i, r[-1]) for i, r in enumerate(_RESPONSES)]))
def response_audit_cases(spark, d):
    rows = cases(spark, "n int, process_id string, direction string, payload string, want string", _numbered(_RESPONSES))
    return ops.audit_responses(rows, ["n"]).select("n", F.array_join("issues", ",").alias("issues"))
