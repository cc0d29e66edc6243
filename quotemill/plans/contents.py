"""Queries of document contents: quotation texts, PDF pages, extraction and the entities of the internal model."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import documents as dc
from quotemill.operators import entities as en
from quotemill.plans.registry import query
from quotemill.sources import pdf
from quotemill.sources import quotations as src

_TEXTS = "WITH " + src.ITEMS_SQL + f""", priced AS (SELECT *, CASE WHEN quantity = '' THEN '1' ELSE quantity END AS qty, CASE WHEN size % 3 = 0 THEN '' ELSE unit END AS u, (price_cents // 100)::VARCHAR || '.' || lpad((price_cents % 100)::VARCHAR, 2, '0') AS price FROM items),
lined AS (SELECT *, CASE WHEN size % 3 = 0 THEN description || ' x' || qty || ' ' || price WHEN unit <> '' THEN description || '    ' || qty || ' ' || unit || '    ' || price ELSE description || '    ' || qty || '    ' || price END AS line FROM priced),
q AS (SELECT 'Q' || o_orderkey AS document_id, o_orderkey, o_custkey, o_totalprice, o_orderpriority, pos, line, l.description, qty, u, price, 'item-' || (row_number() OVER w + 5) AS id, row_number() OVER w AS n, {[*src.CURRENCIES]}[o_orderkey % 3 + 1] AS currency FROM lined l JOIN orders ON pos // 100000000 = o_orderkey WINDOW w AS (PARTITION BY o_orderkey ORDER BY pos, line))"""


@query(_TEXTS + " SELECT DISTINCT document_id, 'Señor ' || o_custkey AS provider, currency, printf('%.2f', o_totalprice) AS total, o_orderpriority AS payment FROM q")
def quotation_heads(spark, d):
    t = F.col("text")
    return src.quotation_texts(spark, d).select("document_id", tx.provider(t, F.lit(None), F.lit(None)).alias("provider"), tx.currency(t).alias("currency"), tx.total(t).alias("total"), tx.payment_terms(t).alias("payment"))


@query(_TEXTS + " SELECT document_id, id AS item_id, description, qty AS quantity, u AS unit, price AS unit_price FROM q")
def extract_items(spark, d):
    return tx.text_items(src.quotation_texts(spark, d), ["document_id"])


def _with_pdf(spark, d):
    """Orders as PDF files of two pages: one of text lines and a table, one of an image alone."""
    o = src.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    k = F.col("o_orderkey").cast("string")
    draw = F.concat(F.lit("BT 12 TL 72 700 Td (Orden \\("), k, F.lit("\\)) Tj T* (Prioridad) Tj 200 0 Td ("), F.col("o_orderpriority"), F.lit(") Tj ET BT 1 0 0 1 72 660 Tm (Estado) Tj ET BT 1 0 0 1 272 660 Tm [("), F.col("o_orderstatus"), F.lit(") -300 (fin)] TJ ET"))
    stream = lambda c: F.concat(F.lit("<< /Length "), F.length(c).cast("string"), F.lit(" >>\nstream\n"), c, F.lit("\nendstream"))
    raw = F.concat(
        F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >>\nendobj\n3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Resources << /XObject << /I 7 0 R >> >> >>\nendobj\n4 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Contents 5 0 R >>\nendobj\n5 0 obj\n"),
        stream(draw),
        F.lit("\nendobj\n7 0 obj\n<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /Length 1 >>\nstream\nx\nendstream\nendobj\n%%EOF"),
    )
    return o.select(k.alias("document_id"), F.encode(raw, "ISO-8859-1").alias("content"))


_PDF = "WITH o AS (SELECT o_orderkey::VARCHAR AS k, o_orderpriority AS p, o_orderstatus AS s FROM orders), t AS (SELECT k, 'Orden (' || k || ')' || chr(10) || 'Prioridad ' || p || chr(10) || 'Estado ' || s || ' fin' AS text FROM o)"


@query(_PDF + " SELECT k AS document_id, 1 AS page_number, 595.0::DOUBLE AS width, text, 0 AS images, false AS requires_ocr, 1 AS n_tables FROM t UNION ALL SELECT k, 2, 612.0, '', 1, true, 0 FROM t")
def pdf_pages(spark, d):
    return pdf.pdf_pages(_with_pdf(spark, d)).select("document_id", "page_number", "width", "text", "images", "requires_ocr", F.size("tables").alias("n_tables"))


@query(_PDF + " SELECT k AS document_id, 2 AS page_count, '[Página 1]' || chr(10) || text AS full_text, 1::BIGINT AS images, 1::BIGINT AS tables, true AS ocr_required FROM t")
def pdf_documents(spark, d):
    return pdf.pdf_documents(pdf.pdf_pages(_with_pdf(spark, d))).drop("errors")


def _resolved(spark, d):
    t = F.col("text")
    q = src.quotation_texts(spark, d)
    line = F.transform(dc.text_rows(t), lambda r: F.array_join(r, "|"))
    return q.select("process_id", "document_id", "order_id", "o_custkey", "text", tx.provider(t, F.lit(None), F.lit(None)).alias("provider_name"), tx.currency(t).alias("currency"), tx.total(t).alias("total_amount"), tx.payment_terms(t).alias("payment_terms"), F.lit("text").alias("format"), F.concat("document_id", F.lit(".txt")).alias("file_name"), F.col("document_id").alias("document_label"), line.alias("tables"))


@query(_TEXTS + " SELECT DISTINCT document_id, 'Señor ' || o_custkey AS provider_name, document_id AS provider_id, currency AS commercial_currency, printf('%.2f', o_totalprice) AS commercial_total_amount, o_orderpriority AS commercial_payment_terms, 'text' AS format_type, document_id || '.txt' AS file_name, document_id AS document_label, 'evidence_center' AS source FROM q")
def adapter_metadata(spark, d):
    return en.adapter_metadata(_resolved(spark, d)).drop("text_content")


@query(_TEXTS + ", h AS (SELECT document_id, any_value(CASE WHEN o_orderkey % 2 = 0 THEN 'RAZÓN SOCIAL: ' ELSE 'Cotización de ' END || 'Señor ' || o_custkey || '. ' || chr(10) || 'Moneda: ' || currency || chr(10) || 'MONTO TOTAL: ' || printf('%.2f', o_totalprice) || chr(10) || 'Condición de pago: ' || o_orderpriority || chr(10) || 'Descripción  Cantidad  Precio') AS head, sum(length(line) + 1) AS body, count(*) AS n, any_value('Señor ' || o_custkey) AS provider_name, any_value(currency) AS currency FROM q GROUP BY 1) SELECT document_id, provider_name, currency, (length(head) + body)::INT AS text_length, n::INT AS items_count FROM h")
def document_summaries(spark, d):
    items = tx.text_items(src.quotation_texts(spark, d), ["document_id"]).groupBy("document_id").agg(F.collect_list("item_id").alias("items"))
    return en.summaries(_resolved(spark, d).join(items, "document_id", "left")).select("document_id", "provider_name", "currency", "text_length", "items_count")


@query(_TEXTS + " SELECT document_id, 'table-items-1' AS table_id, 'Descripción|Cantidad|Precio unitario|Unidad' || chr(10) || string_agg(description || '|' || qty || '|' || price || '|' || u, chr(10) ORDER BY n) AS rows FROM q GROUP BY 1")
def items_to_table(spark, d):
    items = tx.text_items(src.quotation_texts(spark, d), ["document_id"]).withColumn("n", F.regexp_extract("item_id", "(\\d+)$", 1).cast("int"))
    return en.items_table(items, ["document_id"], "n").select("document_id", "table_id", F.array_join(F.transform("rows", lambda x: F.array_join(x, "|")), "\n").alias("rows"))


@query("""WITH e AS (SELECT page_id, regexp_extract_all(html, '<h1[^>]*>([^<]*)', 1) AS headers, regexp_extract_all(html, '<li[^>]*>([^<]*)', 1) AS lists, regexp_extract_all(html, '<img[^>]*src="([^"]*)', 1) AS images, url FROM pages)
SELECT page_id, md5(url) AS text_digest, len(headers) + len(lists) + len(images) AS n_elements, coalesce(list_aggregate(list_transform(headers, lambda x: 'headers:' || x) || list_transform(lists, lambda x: 'lists:' || x) || list_transform(images, lambda x: 'images:' || x), 'string_agg', '|'), '') AS elements,
  (5 + CASE WHEN len(headers) = 0 THEN 1 ELSE 0 END + CASE WHEN len(lists) = 0 THEN 1 ELSE 0 END + CASE WHEN len(images) = 0 THEN 1 ELSE 0 END - 1)::INT AS n_notes FROM e""")
def extraction_results(spark, d):
    p = src.table(spark, d, "pages")
    every = lambda pattern: F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
    found = {"text": F.array("url"), "headers": every("<h1[^>]*>([^<]*)"), "lists": every("<li[^>]*>([^<]*)"), "images": every('<img[^>]*src="([^"]*)')}
    got = en.extracted(p, "page_id", found)
    return got.select("page_id", F.md5("extracted_text").alias("text_digest"), F.size("elements").cast("long").alias("n_elements"), F.array_join("elements", "|").alias("elements"), F.size("observations").alias("n_notes"))


@query(_TEXTS + """, f AS (SELECT DISTINCT document_id, o_orderkey, o_custkey, currency, o_orderpriority, o_totalprice FROM q)
SELECT document_id, 'document' AS entity, 'doc-' || document_id AS entity_id, unnest(['model_id', 'schema_version']) AS name, unnest(['M' || o_orderkey, '1.0']) AS value FROM f
UNION ALL SELECT document_id, 'provider', 'provider-' || o_custkey, 'name', 'Señor ' || o_custkey FROM f
UNION ALL SELECT document_id, 'commercial_information', 'commercial-' || document_id, unnest(['currency', 'total_amount', 'payment_terms']), unnest([currency, printf('%.2f', o_totalprice), o_orderpriority]) FROM f
UNION ALL SELECT document_id, 'technical_information', 'technical-' || document_id, unnest(['lines', 'specification']), unnest(['text', 'spec']) FROM f
UNION ALL SELECT document_id, 'metadata', 'metadata-' || document_id, 'file_name', document_id || '.txt' FROM f
UNION ALL SELECT document_id, 'requirement_context', 'requirement-' || document_id, 'codigo', 'REQ' FROM f
UNION ALL SELECT document_id, 'original_references', 'original-ref-' || document_id, unnest(['adapter_name', 'format_type']), unnest(['text_adapter', 'text']) FROM f
UNION ALL SELECT document_id, 'items', 'item-' || id, 'content', description FROM q
UNION ALL SELECT document_id, 'commercial_conditions', 'condition-c1', 'content', 'Pago ' || o_orderpriority FROM f
UNION ALL SELECT document_id, 'observations', 'observation-o1', 'content', 'Revisar' FROM f""")
def entity_builders(spark, d):
    r = _resolved(spark, d)
    items = tx.text_items(r, ["document_id"]).groupBy("document_id").agg(F.collect_list(F.struct(F.col("item_id").alias("id"), F.col("description").alias("content"))).alias("items"))
    one = lambda i, c: F.array(F.struct(F.lit(i).alias("id"), c.alias("content")))
    fields = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v)))
    c = F.col
    docs = r.join(items, "document_id", "left").select(
        "document_id", "process_id", F.concat(F.lit("M"), c("order_id").cast("string")).alias("model_id"), c("o_custkey").alias("provider_id"), "provider_name", fields(currency=c("currency"), total_amount=c("total_amount"), payment_terms=c("payment_terms")).alias("commercial"), fields(lines=F.lit("text")).alias("technical"), F.array(F.lit("spec"), F.lit(" ")).alias("specifications"),
        "items", one("c1", F.concat(F.lit("Pago "), c("payment_terms"))).alias("conditions"), one("o1", F.lit("Revisar")).alias("observations"), fields(file_name=c("file_name"), blank=F.lit("")).alias("metadata"), fields(codigo=F.lit("REQ")).alias("requirement"), "format", F.lit("text_adapter").alias("adapter"),
    )
    return en.entities(docs)
