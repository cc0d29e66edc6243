"""Queries of the document operators: decoding, tables of texts, canonical items and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import documents as dc
from quotemill.operators import entities as en
from quotemill.plans.registry import query
from quotemill.sources import quotations as src

_CLEAN = r"trim(regexp_replace(regexp_replace(text, '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || chr(11) || chr(12) || chr(13) || ' ')"


@query(f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'doc-' || (doc_id + 1) ELSE 'D' || doc_id END AS document_id, ['decoded', 'decoded', 'decode_error', 'empty'][doc_id % 4 + 1] AS status, 'text' AS format, md5(CASE WHEN doc_id % 4 < 2 AND {_CLEAN} <> '' THEN {_CLEAN} ELSE 'label ' || lang || chr(10) || doc_id || '.txt' END) AS digest FROM documents")
def evidence_resolve(spark, d):
    k = F.col("doc_id") % 4
    percent = F.concat(F.lit("data:text/plain,"), F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20")))
    url = F.when(k == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))).when(k == 1, percent).when(k == 2, "data:text/plain;base64,***").otherwise("")
    docs = src.table(spark, d, "documents").select(F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("D"), F.col("doc_id").cast("string"))).alias("document_id"), F.concat(F.lit("label "), F.col("lang")).alias("document_label"), F.lit("text/plain").alias("content_type"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_name"), url.alias("content_data_url"))
    return dc.resolve_evidence(docs).select(F.col("pos").alias("doc_id"), "document_id", "status", "format", F.md5("text").alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def text_decode(spark, d):
    narrow = F.col("text").rlike(r"^[\x00-\xFF]*$")
    content = F.when((F.col("doc_id") % 2 == 1) & narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    return src.table(spark, d, "documents").select("doc_id", F.md5(tx.decode_text(content)).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '(' || p_name || ')' || chr(10) || p_type || chr(10) || p_brand END AS text FROM part")
def pdf_literal_scan(spark, d):
    drawn = F.concat(F.lit("BT [("), F.col("p_type"), F.lit(") -3 ("), F.col("p_brand"), F.lit(")] TJ (\\("), F.col("p_name"), F.lit("\\)) Tj ET"))
    plain = F.concat(F.lit("\x01\x02"), F.col("p_name"), F.lit("\x03ab\x04"))
    raw = F.encode(F.when(F.col("p_partkey") % 3 == 0, plain).otherwise(drawn), "ISO-8859-1")
    return src.table(spark, d, "part").select("p_partkey", dc.pdf_literals(raw).alias("text"))


_SHOWN = "trim(regexp_replace(html, '<[^>]*>|\\s+', ' ', 'g'))"


@query(f"SELECT page_id, (length(html) - length(replace(html, '<img', ''))) // 4 AS images, length({_SHOWN})::INT AS text_length, (length(html) - length(replace(html, '<img', ''))) // 4 > 0 AND length({_SHOWN}) < 20 AS ocr_required FROM pages")
def ocr_needed(spark, d):
    images = F.regexp_count("html", F.lit("<img")).cast("long")
    size = F.length(F.trim(F.regexp_replace("html", "<[^>]*>|\\s+", " ")))
    return src.table(spark, d, "pages").select("page_id", images.alias("images"), size.alias("text_length"), dc.needs_ocr(size, images).alias("ocr_required"))


_HEADER = " + ".join(f"contains(lower(array_to_string(rows[1], ' ')), '{m}')::INT" for m in tx.HEADER_MARKERS) + " >= 2"
_ROWS = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
c AS (SELECT doc_id, n, CASE WHEN contains(line, '|') THEN list_filter(list_transform(string_split(line, '|'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') ELSE string_split_regex(trim(line, ' ' || chr(9) || chr(13)), '\\s{{2,}}') END AS cells, contains(line, '|') AS bars, regexp_matches(line, '[0-9]') AS digit FROM l),
k AS (SELECT doc_id, n, CASE WHEN bars THEN cells ELSE cells[1:4] END AS cells FROM c WHERE (bars AND len(cells) >= 2) OR (NOT bars AND len(cells) >= 3 AND digit)),
r AS (SELECT doc_id, list(cells ORDER BY n) AS rows FROM k GROUP BY 1), h AS (SELECT doc_id, rows, {_HEADER} AS headed FROM r)"""


@query(_ROWS + " SELECT doc_id, headed, (len(rows) + CASE WHEN headed THEN 0 ELSE 1 END)::BIGINT AS n_rows, md5(array_to_string(list_transform(rows, lambda x: array_to_string(x, '|')), chr(10))) AS digest FROM h")
def text_tables(spark, d):
    docs = src.table(spark, d, "documents").select("doc_id", dc.text_rows(F.col("text")).alias("rows")).where(F.size("rows") > 0)
    return docs.select("doc_id", dc.headed(F.col("rows")).alias("headed"), F.size(dc.with_header(F.col("rows"))).cast("long").alias("n_rows"), F.md5(F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n")).alias("digest"))


@query(_ROWS + ", b AS (SELECT doc_id, unnest(CASE WHEN headed THEN rows[2:] ELSE rows END) AS cells, generate_subscripts(CASE WHEN headed THEN rows[2:] ELSE rows END, 1) - 1 AS n FROM h) SELECT doc_id, 'table-text-1-row-' || n AS item_id, cells[1] AS description, coalesce(cells[2], '') AS quantity, coalesce(cells[3], '') AS unit_price, coalesce(cells[4], '') AS unit FROM b")
def table_to_items(spark, d):
    return dc.table_items(src.table(spark, d, "documents").select("doc_id", dc.text_rows(F.col("text")).alias("rows")), "rows")


@query("WITH " + src.ITEMS_SQL + ", x AS (SELECT 'Q' || pos // 100000000 AS document_id, description, CASE WHEN quantity = '' THEN '1' ELSE quantity END AS q, CASE WHEN size % 3 = 0 THEN '' ELSE unit END AS u, price_cents FROM items) SELECT document_id, 2 * count(*) AS strict_items, count(DISTINCT (description, q, u, price_cents)) AS items FROM x GROUP BY 1")
def canonical_items(spark, d):
    names = ["document_id", "description", "quantity", "unit_price", "unit"]
    named = tx.text_items(src.quotation_texts(spark, d), ["document_id"])
    tables = en.items_table(named.withColumn("n", F.regexp_extract("item_id", "(\\d+)$", 1).cast("int")), ["document_id"], "n")
    decoded = dc.table_items(tables, "rows").select(names)
    both = lambda strict: dc.canonical_items(decoded, named.select(names), names, strict).groupBy("document_id")
    return both(True).agg(F.count("*").alias("strict_items")).join(both(False).agg(F.count("*").alias("items")), "document_id")


@query("SELECT o_orderkey AS document_id, o_orderpriority AS content FROM orders WHERE o_orderkey % 5 IN (0, 2, 3) UNION ALL SELECT o_orderkey, o_orderstatus FROM orders")
def canonical_conditions(spark, d):
    o = src.table(spark, d, "orders").withColumnRenamed("o_orderkey", "document_id")
    kind = F.element_at(F.array(*map(F.lit, ("condition", "title", "footer", "terms", "technical"))), (F.col("document_id") % 5 + 1).cast("int"))
    return dc.conditions(o.select("document_id", kind.alias("element_type"), F.col("o_orderpriority").alias("content")), o.select("document_id", F.col("o_orderstatus").alias("content")))


@query("SELECT doc_id AS document_id, 'empty' AS content, 'incident' AS observation_type FROM documents WHERE n_chars < 200 UNION ALL SELECT doc_id, 'prepared', 'technical_observation' FROM documents UNION ALL SELECT doc_id, source, 'metadata' FROM documents")
def canonical_observations(spark, d):
    t = src.table(spark, d, "documents").withColumnRenamed("doc_id", "document_id")
    return dc.observations(t.where("n_chars < 200").select("document_id", F.lit("empty").alias("content")), t.select("document_id", F.lit("prepared").alias("content")), t.select("document_id", F.col("source").alias("content")))


@query("SELECT c_custkey, 'commercial_segment' AS name, c_mktsegment AS value FROM customer WHERE c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 'technical_nation', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, 'raw_text', c_name FROM customer WHERE c_custkey % 3 = 2")
def prefix_projection(spark, d):
    k = F.col("c_custkey") % 3
    entry = lambda name, value: F.create_map(F.lit(name), value)
    none = F.expr("cast(map() as map<string, string>)")
    fields = F.map_concat(F.when(k > 0, entry("commercial_segment", F.col("c_mktsegment"))).otherwise(none), F.when(k < 2, entry("technical_nation", F.col("c_nationkey").cast("string"))).otherwise(none), entry("provider_x", F.lit("y")))
    c = src.table(spark, d, "customer").select("c_custkey", "c_name", fields.alias("m"))
    both = F.map_concat(dc.prefixed(F.col("m"), "commercial_"), dc.prefixed(F.col("m"), "technical_", {"raw_text": F.col("c_name")}))
    return c.select("c_custkey", F.explode(both).alias("name", "value"))


_TAGS = {"tables": "<table", "headers": "<h1", "footers": "<footer", "lists": "<li", "images": "<img"}


@query("WITH s AS (SELECT page_id, " + ", ".join(f"((length(html) - length(replace(html, '{t}', ''))) // {len(t)})::BIGINT AS {s}" for s, t in _TAGS.items()) + ", length(html)::BIGINT AS text, 0::BIGINT AS structural, 1::BIGINT AS metadata FROM pages) SELECT page_id, section, found, CASE WHEN found > 0 THEN 'extracted' ELSE 'prepared' END AS note FROM (UNPIVOT s ON text, tables, headers, footers, lists, images, structural, metadata INTO NAME section VALUE found)")
def extract_sections(spark, d):
    found = {s: F.regexp_count("html", F.lit(t)) for s, t in _TAGS.items()} | {"text": F.length("html"), "metadata": F.lit(1)}
    return dc.sections(src.table(spark, d, "pages"), "page_id", found)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'reference' WHEN doc_id % 3 = 0 THEN 'metadata' ELSE 'D' || doc_id END AS reference FROM documents")
def evidence_fallback(spark, d):
    k = F.col("doc_id")
    empty = F.array().cast("array<string>")
    sources = [F.when(k % 2 == 0, F.array(F.lit("reference"))), F.when(k % 3 == 0, F.array(F.lit("metadata"))).otherwise(empty), F.array(F.concat(F.lit("D"), k.cast("string")))]
    return src.table(spark, d, "documents").select("doc_id", F.explode(dc.first_references(sources)).alias("reference"))


@query("SELECT p_partkey, ['resolved', 'resolved', 'disabled', 'resolved', 'unregistered', 'unregistered'][p_partkey % 6 + 1] AS adapter FROM part")
def adapter_resolution(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, ("pdf", "word", "excel", "image", "text", None))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return src.table(spark, d, "part").select("p_partkey", dc.adapter(fmt, ("pdf", "word", "image")).alias("adapter"))


@query("SELECT doc_id, CASE WHEN n_chars < 50 THEN 'low' WHEN lang = 'de' THEN 'acceptable' ELSE 'high' END AS quality_level FROM documents")
def document_quality_level(spark, d):
    return src.table(spark, d, "documents").select("doc_id", dc.quality_level((F.col("n_chars") < 50).cast("int"), F.coalesce((F.col("lang") == "de").cast("int"), F.lit(0))).alias("quality_level"))


@query("SELECT doc_id, unnest(['document_id', 'model_id', 'format']) AS query_key, unnest(['D' || doc_id, 'M' || doc_id, 'pdf']) AS query_value FROM documents UNION ALL SELECT doc_id, 'provider_name', source FROM documents WHERE trim(source) <> ''")
def knowledge_index_entries(spark, d):
    k = F.col("doc_id").cast("string")
    return dc.index_entries(src.table(spark, d, "documents"), "doc_id", {"document_id": F.concat(F.lit("D"), k), "model_id": F.concat(F.lit("M"), k), "provider_name": F.col("source"), "format": F.lit("pdf"), "project": F.lit(" ")})


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS accepted FROM events")
def knowledge_index_insert(spark, d):
    stored = src.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return dc.insert_unique(stored, src.table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "accepted")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def result_registry(spark, d):
    return dc.last_write(src.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("WITH " + src.ITEMS_SQL + " SELECT DISTINCT process_id, document_id, 'REQ ' || o_orderpriority AS requirement FROM items JOIN (SELECT strftime(o_orderdate, '%Y-%m') AS p, min(o_orderpriority) AS o_orderpriority FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON p = process_id WHERE provider_id LIKE '%4'")
def context_integration(spark, d):
    models = src.items(spark, d).select("process_id", "document_id").distinct()
    wanted = src.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("process_id")).agg(F.concat(F.lit("REQ "), F.min("o_orderpriority")).alias("requirement"))
    of = wanted.select("process_id", F.explode(F.array(*(F.concat("process_id", F.lit(f"/N{n}")) for n in (4, 14, 24)))).alias("document_id"), "requirement")
    return dc.integrate_context(models, of)
