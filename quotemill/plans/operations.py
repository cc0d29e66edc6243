"""Queries of the operations log: failures, phases, audits, metrics, positions and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from quotemill.operators import opslog as ops
from quotemill.plans.registry import query
from quotemill.sources import quotations as src
from quotemill.streaming import queue as st


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'terminal_failure' WHEN event_id % 6 + 1 <= 3 THEN 'retry' ELSE 'cancel' END AS decision FROM events")
def failure_recovery(spark, d):
    category = F.element_at(F.array(*map(F.lit, ("communication", "processing", "temporary", "validation"))), (F.col("event_id") % 4 + 1).cast("int"))
    return src.table(spark, d, "events").select("event_id", ops.recovery(category, F.col("event_id") % 6 + 1).alias("decision"))


@query("SELECT event_type AS category, CASE WHEN value > 50 THEN 'failed' ELSE 'cancelled' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def error_counts(spark, d):
    status = F.when(F.col("value") > 50, "failed").otherwise("cancelled")
    return src.table(spark, d, "events").groupBy(F.col("event_type").alias("category"), status.alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS process_id, count(*) AS n FROM events GROUP BY 1")
def event_counts(spark, d):
    return src.table(spark, d, "events").groupBy(F.col("user_id").alias("process_id")).agg(F.count("*").alias("n"))


@query("SELECT event_type AS metric, sum(event_id % 7)::BIGINT AS total FROM events GROUP BY 1")
def metrics_counters(spark, d):
    return src.table(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.sum(F.col("event_id") % 7).alias("total"))


@query("SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_durations(spark, d):
    return src.table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "event_type", "value")


@query("SELECT user_id, list_filter([CASE WHEN count(*) >= 100 THEN 'congested' END, CASE WHEN count(*) FILTER (WHERE event_type = 'click') >= 10 AND count(*) FILTER (WHERE event_type = 'view') > 0 THEN 'workers_busy' END], lambda x: x IS NOT NULL) AS hints FROM events GROUP BY 1")
def congestion_hints(spark, d):
    n = lambda kind: F.sum((F.col("event_type") == kind).cast("long"))
    q = src.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("depth"), n("click").alias("active"), n("view").alias("pending"))
    return q.select("user_id", ops.queue_hints(F.col("depth"), F.col("pending"), F.col("active"), 10).alias("hints"))


@query("""WITH q AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'query_analysis_status' ELSE event_type END AS operation, row_number() OVER (PARTITION BY user_id, CASE WHEN event_type = 'view' THEN 'query_analysis_status' ELSE event_type END ORDER BY ts, event_id) > 1 AS again, event_id % 5 = 0 OR event_id % 9 = 0 AS no_document, event_id % 9 = 0 AS no_content FROM events)
SELECT event_id, list_filter([CASE WHEN no_document AND no_content THEN 'incomplete_message' END, CASE WHEN again AND operation <> 'query_analysis_status' THEN 'duplicate_message' END, CASE WHEN no_document AND NOT no_content THEN 'invalid_structure:document' END], lambda x: x IS NOT NULL) AS issues FROM q""")
def request_audit(spark, d):
    k = F.col("event_id")
    operation = F.when(F.col("event_type") == "view", "query_analysis_status").otherwise(F.col("event_type"))
    content = F.when(k % 9 != 0, "x")
    q = src.table(spark, d, "events").select("event_id", "ts", F.col("user_id").alias("process_id"), operation.alias("operation"), F.when(k % 5 != 0, content).alias("document"), content.alias("content"), F.lit(None).cast("string").alias("traceability"))
    return ops.audit(q, ["document", "content", "traceability"], ["ts", "event_id"]).select("event_id", "issues")


_STEPS = [(op, a, b) for op, flow in ops.FLOWS.items() for a, b in zip((None, *flow), (*flow, None), strict=True)]
_VALUES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _STEPS)


@query(f"WITH f(operation, phase, following) AS (VALUES {_VALUES}), p AS (SELECT event_id, {list(ops.FLOWS)}[event_id % 5 + 1] AS operation, {[*ops.FLOWS['start_analysis']]}[event_id % 9 + 1] AS phase FROM events) SELECT event_id, p.operation, p.phase, f.following AS next_phase, coalesce(f.following = 'proceso_finalizado', false) AS may_end FROM p LEFT JOIN f ON p.operation = f.operation AND p.phase = f.phase")
def phase_automaton(spark, d):
    at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("event_id") % n + 1).cast("int"))
    e = src.table(spark, d, "events").select("event_id", at(list(ops.FLOWS), 5).alias("operation"), at(ops.FLOWS["start_analysis"], 9).alias("phase"))
    return e.select("event_id", "operation", "phase", ops.next_phase(F.col("operation"), F.col("phase")).alias("next_phase"), ops.valid_phase(F.col("operation"), F.col("phase"), F.lit("proceso_finalizado")).alias("may_end"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 day', ts)) // 1000000 AS started, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_counts(spark, d):
    schema = src.table(spark, d, "events").schema
    at = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='quotemill-stream-')}"
    out = f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    counts = st.event_counts(events, "1 day", "1 day")
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}-rows")).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{out}-rows").select(F.unix_timestamp("window.start").alias("started"), "event_type", "n")
