"""Operations log: states, queue, events and metrics, and the rules over document metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.places import place

#: Categories by error code, and by words of the description in the order in which they are tried.
ERROR_CODES = {"structural_validation_failed": "validation", "required_field_missing": "validation", "invalid_field_type": "validation", "contract_version_unsupported": "validation", "process_not_found": "system_internal", "operation_not_executed": "processing", "api_not_initialized": "communication", "coordinator_required": "communication", "pio_orchestration_required": "communication"}
ERROR_WORDS = (("documental", "document|documento|evidencia"), ("temporary", "timeout|temporal|temporary|retry"), ("communication", "comunic|communication|connection|conexion"), ("validation", "valid|contract|campo|field"), ("permanent", "permanent|irrecuperable"), ("processing", "procesa|processing|pipeline"))
RECOVERABLE = ("communication", "processing", "temporary")
#: Formats by extension, media type and signature, and the confidence of each way.
EXTENSIONS = {".pdf": "pdf", ".docx": "word", ".doc": "word", ".xlsx": "excel", ".xls": "excel", ".png": "image", ".jpg": "image", ".jpeg": "image", ".tiff": "image", ".bmp": "image"}
MEDIA = {"application/pdf": "pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "word", "application/msword": "word", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "excel", "application/vnd.ms-excel": "excel", "image/png": "image", "image/jpeg": "image", "image/tiff": "image", "image/bmp": "image"}
SIGNATURES = {"%PDF": "pdf", "PK": "word", "D0CF11E0": "word", "89504E47": "image", "FFD8FF": "image"}
MAGIC, DECLARED, EXTENSION, MIME, LEAST = 0.98, 0.95, 0.90, 0.85, 0.5
MAX_BYTES = 50_000_000
RULES = ("corrupt", "empty", "inaccessible", "incomplete", "inconsistent", "invalid_size", "unsupported_format")
#: Severity of each category of error.
SEVERITIES = {"validation": "warning", "documental": "warning", "communication": "error", "processing": "error", "temporary": "warning", "permanent": "critical", "system_internal": "critical"}


def _lookup(c: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[c]


def error_category(code: Column, description: Column) -> Column:
    text = F.lower(F.coalesce(description, F.lit("")))
    by_words = F.lit("system_internal")
    for name, words in reversed(ERROR_WORDS):
        by_words = F.when(text.rlike(words), name).otherwise(by_words)
    return F.coalesce(_lookup(F.lower(F.trim(F.coalesce(code, F.lit("")))), ERROR_CODES), by_words)


def recognized(signature: Column, declared: Column, file_name: Column, mime: Column) -> Column:
    """The format of the greatest confidence (ties: signature, declared, extension, media type); null below the least."""
    by_magic = F.lit(None).cast("string")
    for sign, fmt in reversed(SIGNATURES.items()):
        by_magic = F.when(signature.startswith(sign), fmt).otherwise(by_magic)
    ext = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"(\.[A-Za-z0-9]+)$", 1))
    found = [(MAGIC, by_magic), (DECLARED, declared), (EXTENSION, _lookup(ext, EXTENSIONS)), (MIME, _lookup(F.lower(mime), MEDIA))]
    best = F.array_max(F.filter(F.array(*(F.when(f.isNotNull(), F.struct(F.lit(c).alias("confidence"), F.lit(-i).alias("i"), f.alias("format"))) for i, (c, f) in enumerate(found))), lambda x: x.isNotNull()))
    return F.when(best["confidence"] >= LEAST, best)


def incidents(doc: dict[str, Column]) -> Column:
    """Names of the validation rules that a document breaks."""
    size = doc["size"]
    broken = {"corrupt": doc["corrupt"], "empty": size == 0, "inaccessible": ~doc["accessible"], "incomplete": doc["incomplete"], "inconsistent": doc["inconsistent"], "invalid_size": (size < 1) | (size > MAX_BYTES), "unsupported_format": ~doc["format"].isin("pdf", "word", "excel", "image")}
    return F.filter(F.array(*(F.when(broken[r], F.lit(r)) for r in RULES)), lambda x: x.isNotNull())


def warnings(doc: dict[str, Column]) -> Column:
    """Names of the validation rules that only warn."""
    return F.filter(F.array(F.when(doc["illegible"], F.lit("illegible"))), lambda x: x.isNotNull())


def severity(category: Column) -> Column:
    return F.coalesce(_lookup(category, SEVERITIES), F.lit("error"))


def validation_status(n_incidents: Column, n_warnings: Column) -> Column:
    return F.when(n_incidents > 0, "failed").when(n_warnings > 0, "warning").otherwise("passed")


def newest(events: DataFrame, key: str, n: int) -> DataFrame:
    """The newest ``n`` events of each key."""
    return events.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("_n") <= n).drop("_n")


def latest_state(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("transitions"))


def illegal_transitions(events: DataFrame, key: str, flow: list[str]) -> DataFrame:
    """Changes of state that don't go one step on in ``flow``; a first event must be its first state."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, flow)), F.col("event_type")), F.lit(0))
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    steps = events.withColumn("to_step", place.cast("long")).withColumn("from_step", F.coalesce(F.lag("to_step").over(order), F.lit(0).cast("long")))
    return steps.where("to_step <> from_step + 1")


def active_duplicates(queue: DataFrame, key: str) -> DataFrame:
    """Items to refuse: their process has an earlier one."""
    return queue.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("ts", "event_id"))).where("_n > 1").drop("_n")


#: The source that may enqueue, and the depth of the queue.
QUEUE_SOURCE, QUEUE_DEPTH = "ecg", 10_000


def enqueue(requests: DataFrame, key: str, order: list[str], depth: int = QUEUE_DEPTH) -> DataFrame:
    """What becomes of each request to enqueue: its source must be the right one, its process may wait once, and the queue takes ``depth``."""
    fit = F.col("source") == QUEUE_SOURCE
    first = F.row_number().over(Window.partitionBy(key, fit).orderBy(*order)) == 1
    # Only accepted ones take a place: the first of each process, in order.
    taken = place(requests.withColumn("_new", fit & first).withColumn("_lane", F.col("_new")), ["_lane"], order, "_place")
    full = F.col("_new") & (F.col("_place") > depth)
    return taken.withColumn("outcome", F.when(~fit, "rejected_source").when(~F.col("_new"), "already_queued").when(full, "queue_full").otherwise("accepted")).drop("_new", "_lane", "_place")


def audit_responses(messages: DataFrame, order: list[str]) -> DataFrame:
    """Issues of messages (process_id, direction): no process, or a response to what was never requested before."""
    before = F.max((F.col("direction") == "request").cast("int")).over(Window.partitionBy("process_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    bare = F.trim(F.coalesce("process_id", F.lit(""))) == ""
    issues = F.array(F.when(bare, "missing_id"), F.when(~bare & (F.col("direction") == "response") & (F.coalesce(before, F.lit(0)) == 0), "inconsistent_response"))
    return messages.withColumn("issues", F.array_compact(issues))


def running_usage(events: DataFrame, key: str, amount: Column) -> DataFrame:
    order = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("usage", F.sum(amount).over(order))


def fifo_positions(queue: DataFrame, lane: str, order: list[str]) -> DataFrame:
    """Place of each pending item in its lane, first in first out."""
    return place(queue, [lane], order)


#: Retries of a recoverable failure, depth of a congested queue, keys that may be null, operations that may repeat.
MAX_RETRIES, CONGESTED = 3, 100
NULLABLE = ("controlled_error", "analysis_result", "comparative_tables", "traceability")
REPEATABLE = ("query_analysis_status", "query_analysis_result")
#: Phases of each operation, in order.
FLOWS = {
    "start_analysis": ("solicitud_recibida", "validacion_iniciada", "solicitud_aceptada", "procesamiento_iniciado", "invocacion_motor_preparada", "procesamiento_en_ejecucion", "resultado_generado", "resultado_entregado", "proceso_finalizado"),
    "query_status": ("solicitud_recibida", "validacion_iniciada", "solicitud_aceptada", "resultado_entregado", "proceso_finalizado"),
    "query_result": ("solicitud_recibida", "validacion_iniciada", "solicitud_aceptada", "resultado_generado", "resultado_entregado", "proceso_finalizado"),
    "validate_request": ("solicitud_recibida", "validacion_iniciada", "solicitud_aceptada", "proceso_finalizado"),
    "cancel_analysis": ("solicitud_recibida", "error_controlado", "proceso_finalizado"),
}


def recovery(category: Column, attempt: Column) -> Column:
    """RETRY while a recoverable failure has retries left, then CANCEL; other failures are final."""
    recoverable = category.isin(*RECOVERABLE)
    return F.when(recoverable & (attempt <= MAX_RETRIES), "retry").when(recoverable, "cancel").otherwise("terminal_failure")


def next_phase(operation: Column, phase: Column) -> Column:
    """The phase after ``phase``; the first one after null; null after the last one and for unknown ones."""
    out = F.lit(None).cast("string")
    for name, flow in FLOWS.items():
        steps = F.create_map(*[F.lit(x) for pair in zip(flow, flow[1:], strict=False) for x in pair])
        out = F.when(operation == name, F.when(phase.isNull(), flow[0]).otherwise(steps[phase])).otherwise(out)
    return out


def valid_phase(operation: Column, before: Column, after: Column) -> Column:
    """Whether a change of phase is in order; a controlled error always is."""
    return (after == "error_controlado") | F.coalesce(next_phase(operation, before) == after, F.lit(False))


def queue_hints(depth: Column, pending: Column, active: Column, workers: int) -> Column:
    return F.filter(F.array(F.when(depth >= CONGESTED, "congested"), F.when((active >= workers) & (pending > 0), "workers_busy")), lambda x: x.isNotNull())


def audit(requests: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    """Issues of requests (process_id, operation and ``fields``): an empty payload, null fields, a repeated operation."""
    empty = F.lit(True)
    for f in fields:
        empty = empty & F.col(f).isNull()
    again = F.row_number().over(Window.partitionBy("process_id", "operation").orderBy(*order)) > 1
    nulls = [F.when(F.col(f).isNull() & ~empty, F.lit(f"invalid_structure:{f}")) for f in fields if f not in NULLABLE]
    issues = F.array(F.when(empty, "incomplete_message"), F.when(again & ~F.col("operation").isin(*REPEATABLE), "duplicate_message"), *nulls)
    return requests.withColumn("issues", F.filter(issues, lambda x: x.isNotNull()))


def capacity_mode(concurrent: Column, most: int) -> Column:
    return F.when(concurrent >= most, "horizontal_prepared").when(concurrent >= max(1, most // 2), "vertical_prepared").otherwise("single_node")
