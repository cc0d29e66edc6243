"""The registered queries of the core operators, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import analysis as an
from quotemill.operators import concepts as co
from quotemill.operators import models as md
from quotemill.operators import opslog as ops
from quotemill.operators import tables as tb
from quotemill.session import ship
from quotemill.plans.stages import Stages
from quotemill.sources import quotations as src

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _register() -> None:
    from quotemill.plans import cases, contents, documents, evidence, models, operations, quality  # noqa: F401  they add their queries to this module's


def queries() -> dict:
    _register()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _register()
    return dict(_SQL)


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(trim({x}))), '[^\\w\\s./-]', ' ', 'g'), '\\s+', ' ', 'g'))"


_DETECT = src.ITEMS_SQL + ", " + src.DOCUMENTS_SQL + """, concepts AS (
  SELECT process_id, document_id, provider_id, 1 AS detector, 0 AS part, pos, CASE WHEN quantity <> '' OR unit <> '' THEN 'partida' ELSE 'item' END AS kind, description, NULL AS field FROM items WHERE trim(description) <> ''
  UNION ALL SELECT process_id, document_id, provider_id, 2, 0, pos, 'technical_element', specification, NULL FROM items WHERE trim(specification) <> ''
  UNION ALL SELECT process_id, document_id, provider_id, 2, 1, pos, 'technical_element', size::VARCHAR, 'size' FROM items
  UNION ALL SELECT process_id, document_id, provider_id, 3, 0, pos, 'commercial_element', 'Moneda: ' || currency, 'currency' FROM documents_of
  UNION ALL SELECT process_id, document_id, provider_id, 3, 1, pos, 'commercial_element', 'Monto total: ' || total_amount, 'total_amount' FROM documents_of
  UNION ALL SELECT process_id, document_id, provider_id, 3, 2, pos, 'commercial_element', 'Condiciones de pago: ' || payment_terms, 'payment_terms' FROM documents_of
  UNION ALL SELECT process_id, document_id, provider_id, 4, 0, pos, 'commercial_condition', condition, 'entrega' FROM documents_of
  UNION ALL SELECT process_id, document_id, provider_id, 5, 0, pos, 'observation', observation, NULL FROM documents_of WHERE observation <> '')"""
_NORMALIZED = _DETECT + f""", normalized AS (
  SELECT process_id, document_id, provider_id, detector, part, pos, CASE kind WHEN 'item' THEN 'material' WHEN 'partida' THEN 'partida' WHEN 'technical_element' THEN 'technical_element' WHEN 'observation' THEN 'service' ELSE 'commercial_element' END AS concept_type,
    description AS original_value, {_norm_sql("description")} AS normalized_value FROM concepts WHERE kind <> 'commercial_element')"""
_GROUPS = _NORMALIZED + """, grouped AS (
  SELECT process_id, normalized_value, concept_type, count(*) AS members_count, min(pos) AS first_member, count(DISTINCT document_id) AS document_count
  FROM normalized WHERE detector = 1 AND normalized_value <> '' GROUP BY ALL HAVING count(DISTINCT document_id) >= 2),
groups AS (SELECT *, 'GC-' || lpad((row_number() OVER (PARTITION BY process_id ORDER BY first_member, concept_type))::VARCHAR, 6, '0') AS group_id, 'material' AS group_type FROM grouped)"""


# Text and sources


@query("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'image' WHEN 4 THEN 'text' WHEN 5 THEN 'text' ELSE 'pdf' END AS format FROM documents")
def format_sniff(spark, d):
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".DOC", ".xlsx", ".webp", ".txt", ".bin", ".zip"))), (F.col("doc_id") % 7 + 1).cast("int"))
    mime = F.when(F.col("doc_id") % 7 == 5, "text/markdown").otherwise("")
    return src.table(spark, d, "documents").select("doc_id", tx.sniff_format(mime, F.concat(F.lit("file"), ext)).alias("format"))


@query("SELECT doc_id, length(text)::BIGINT AS n, text AS decoded FROM documents")
def data_url_round_trip(spark, d):
    url = F.concat(F.lit("data:text/plain;base64,"), F.base64(F.encode("text", "UTF-8")))
    back = F.decode(tx.decode_data_url(url), "UTF-8")
    return src.table(spark, d, "documents").select("doc_id", F.length(back).cast("long").alias("n"), back.alias("decoded"))


@query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(replace(html, chr(0), ' '), '[ \t]*\n[ \t]*', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(9) || chr(13) || ' '))::BIGINT AS n FROM pages")
def clean_text(spark, d):
    return src.table(spark, d, "pages").select("page_id", F.length(tx.clean_text(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(strip_accents(lower(trim(text, chr(10) || chr(9) || chr(13) || ' '))), '[^\\p{L}\\p{N}_\\s./-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_text_any(spark, d):
    ship(spark)  # the Python workers import the function by name
    return src.table(spark, d, "documents").select("doc_id", F.md5(tx.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT DISTINCT p_name, p_type, {_norm_sql('p_name')} AS name, {_norm_sql('p_type')} AS kind FROM part")
def normalize_text_ascii(spark, d):
    return src.table(spark, d, "part").select("p_name", "p_type", tx.normalize_ascii(F.col("p_name")).alias("name"), tx.normalize_ascii(F.col("p_type")).alias("kind")).distinct()


@query("WITH " + src.LINES_SQL + " SELECT i.document_id, i.pos, description, CASE WHEN quantity = '' THEN '1' ELSE quantity END AS quantity, CASE WHEN size % 3 = 0 THEN '' ELSE unit END AS unit, (price_cents // 100)::VARCHAR || '.' || lpad((price_cents % 100)::VARCHAR, 2, '0') AS unit_price FROM items i")
def line_item_parse(spark, d):
    return src.item_lines(spark, d).select("document_id", "pos", tx.item_fields(F.col("line")).alias("x")).where("x is not null").select("document_id", "pos", "x.*")


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) FILTER (WHERE " + " + ".join(f"contains(lower(line), '{m}')::INT" for m in tx.HEADER_MARKERS) + " >= 2)::BIGINT AS headers, count(*)::BIGINT AS lines FROM l GROUP BY doc_id")
def header_lines(spark, d):
    lines = src.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(tx.looks_like_header(F.col("line")).cast("long")).alias("headers"), F.count("*").alias("lines"))


@query("SELECT o_orderkey, o_orderpriority AS priority, ['PEN', 'USD', 'EUR', '', 'USD'][o_orderkey % 5 + 1] AS currency, CASE WHEN o_orderkey % 2 = 0 THEN printf('%.2f', o_totalprice) ELSE '' END AS total, CASE o_orderkey % 3 WHEN 0 THEN o_orderpriority ELSE '' END AS payment, 'Clerk ' || o_custkey AS provider FROM orders")
def quotation_fields(spark, d):
    o = src.table(spark, d, "orders")
    money = F.element_at(F.array(*map(F.lit, ("S/100", "USD 5", "12 eur", "sin moneda", "5$9"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    text = F.concat(F.lit("Proveedor: Clerk "), F.col("o_custkey").cast("string"), F.lit(". \nMonto "), money, F.lit("\n"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Importe total: "), F.format_string("%.2f", "o_totalprice"))).otherwise(""), F.lit("\n"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Forma de pago: "), F.col("o_orderpriority"))).otherwise(""))
    t = F.col("_t")
    return o.select("o_orderkey", "o_orderpriority", text.alias("_t")).select("o_orderkey", F.col("o_orderpriority").alias("priority"), tx.currency(t).alias("currency"), tx.total(t).alias("total"), tx.payment_terms(t).alias("payment"), tx.provider(t, F.lit(""), F.lit("")).alias("provider"))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS cells FROM l WHERE contains(line, '|')) SELECT doc_id, count(*)::BIGINT AS rows, sum(len(cells))::BIGINT AS cells, max(len(cells))::BIGINT AS widest FROM c WHERE len(cells) >= 2 GROUP BY 1")
def pipe_tables(spark, d):
    lines = src.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.contains("line", F.lit("|")))
    cells = lines.select("doc_id", F.size(F.filter(F.transform(F.split("line", "\\|", -1), F.trim), lambda x: x != "")).alias("n")).where("n >= 2")
    return cells.groupBy("doc_id").agg(F.count("*").alias("rows"), F.sum("n").cast("long").alias("cells"), F.max("n").cast("long").alias("widest"))


# Concepts


@query("WITH " + _DETECT + " SELECT document_id, kind, description, pos, row_number() OVER (PARTITION BY process_id, document_id ORDER BY detector, part, pos, kind, description) AS sequence FROM concepts")
def concept_extract(spark, d):
    return co.numbered(Stages(spark, d).concepts).select("document_id", "kind", "description", "pos", "sequence")


@query("WITH " + _DETECT + " SELECT kind, count(*) AS n, count(DISTINCT document_id) AS documents FROM concepts GROUP BY 1")
def concept_kind(spark, d):
    return Stages(spark, d).concepts.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query("WITH " + _DETECT + " SELECT document_id, pos, kind, description FROM concepts WHERE kind IN ('item', 'partida')")
def material_filter(spark, d):
    return Stages(spark, d).concepts.where(F.col("kind").isin(*co.MATERIAL_KINDS)).select("document_id", "pos", "kind", "description")


@query("WITH " + _DETECT + " SELECT document_id, pos, kind, description FROM concepts WHERE kind IN ('commercial_condition', 'observation', 'technical_element')")
def service_filter(spark, d):
    return Stages(spark, d).concepts.where(F.col("kind").isin(*co.SERVICE_KINDS)).select("document_id", "pos", "kind", "description")


@query("WITH " + _NORMALIZED + " SELECT document_id, pos, concept_type, original_value, normalized_value FROM normalized")
def normalized_concepts(spark, d):
    return Stages(spark, d).normalized.select("document_id", "pos", "concept_type", "original_value", "normalized_value")


@query("WITH " + _NORMALIZED + " SELECT process_id, document_id, concept_type, normalized_value, min(pos) AS pos FROM normalized GROUP BY ALL")
def collective_union_distinct(spark, d):
    return co.union_distinct(Stages(spark, d).normalized, ["process_id", "document_id", "concept_type", "normalized_value"], ["pos"]).select("process_id", "document_id", "concept_type", "normalized_value", "pos")


_PAIR = "WITH " + _NORMALIZED + ", r AS (SELECT *, pos // 100000000 AS origin FROM normalized WHERE detector = 1 AND normalized_value <> '') SELECT a.process_id AS process_id, a.pos AS a, b.pos AS b, a.normalized_value AS value FROM r a JOIN r b ON a.process_id = b.process_id AND a.pos < b.pos AND a.document_id <> b.document_id AND "


@query(_PAIR + "a.normalized_value = b.normalized_value AND a.concept_type = b.concept_type")
def equiv_exact_pairs(spark, d):
    return co.equivalence_pairs(Stages(spark, d).item_concepts, "exact")


@query(_PAIR + "a.normalized_value = b.normalized_value AND a.concept_type <> b.concept_type")
def equiv_cross_type_pairs(spark, d):
    return co.equivalence_pairs(Stages(spark, d).item_concepts, "cross_type")


@query(_PAIR + "a.origin = b.origin AND a.normalized_value <> b.normalized_value")
def equiv_shared_origin(spark, d):
    return co.equivalence_pairs(Stages(spark, d).item_concepts, "shared_origin")


@query("WITH " + _GROUPS + " SELECT process_id, group_id, group_type, normalized_value, concept_type, members_count, document_count, first_member FROM groups")
def comparable_groups(spark, d):
    return Stages(spark, d).groups.select("process_id", "group_id", "group_type", "normalized_value", "concept_type", "members_count", "document_count", "first_member")


@query("WITH " + _GROUPS + " SELECT process_id, normalized_value, concept_type, members_count FROM groups WHERE members_count >= 3")
def group_min_members(spark, d):
    return co.comparable_groups(Stages(spark, d).item_concepts, 3).select("process_id", "normalized_value", "concept_type", "members_count")


@query("WITH " + _GROUPS + ", ctx AS (SELECT process_id, 'CTX-' || process_id AS context_id, count(DISTINCT document_id) AS documents FROM items GROUP BY 1) SELECT process_id, group_id, context_id, documents FROM groups JOIN ctx USING (process_id)")
def context_association(spark, d):
    s = Stages(spark, d)
    context = s.items.groupBy("process_id").agg(F.countDistinct("document_id").alias("documents")).withColumn("context_id", F.concat(F.lit("CTX-"), F.col("process_id")))
    return s.groups.join(context, "process_id").select("process_id", "group_id", "context_id", "documents")


@query("WITH " + _GROUPS + " SELECT g.process_id, g.group_id, 'CDM-' || lpad((row_number() OVER (PARTITION BY g.process_id ORDER BY g.group_id))::VARCHAR, 6, '0') AS model_id, i.description AS primary_item, g.members_count FROM groups g JOIN items i ON g.first_member = i.pos")
def domain_model_join(spark, d):
    s = Stages(spark, d)
    items = s.items.select(F.col("pos").alias("first_member"), F.col("description").alias("primary_item"))
    return md.with_id(s.groups.join(items, "first_member"), "model_id", "CDM", ["process_id"], ["group_id"]).select("process_id", "group_id", "model_id", "primary_item", "members_count")


# Comparison tables

_ATTRIBUTES = _GROUPS + """, members AS (SELECT n.process_id, group_id, n.pos FROM normalized n JOIN groups g USING (process_id, normalized_value, concept_type) WHERE detector = 1),
attributes AS (
  SELECT process_id, group_id, 1 AS source_ord, unnest(['group_type', 'members_count']) AS name FROM groups
  UNION ALL SELECT process_id, group_id, 2, 'concept_type' FROM groups
  UNION ALL SELECT DISTINCT m.process_id, group_id, 3, specification FROM members m JOIN items i USING (pos)
  UNION ALL SELECT process_id, group_id, 4, 'GROUP_TYPE' FROM groups
  UNION ALL SELECT g.process_id, group_id, 5, description FROM groups g JOIN items i ON g.first_member = i.pos),
columns AS (SELECT * FROM attributes QUALIFY row_number() OVER (PARTITION BY process_id, group_id, lower(name) ORDER BY source_ord, name) = 1)"""


@query("WITH " + _ATTRIBUTES + " SELECT process_id, group_id, name, row_number() OVER (PARTITION BY process_id, group_id ORDER BY source_ord, name) AS logical_position, 'DCC-' || lpad((row_number() OVER (PARTITION BY process_id ORDER BY group_id, source_ord, name))::VARCHAR, 6, '0') AS column_id FROM columns")
def dynamic_columns(spark, d):
    return Stages(spark, d).columns.select("process_id", "group_id", "name", "logical_position", "column_id")


_ROWS = _GROUPS + ", providers AS (SELECT DISTINCT process_id, provider_id FROM items), trows AS (SELECT process_id, group_id, provider_id, 'DCR-' || lpad((row_number() OVER (PARTITION BY process_id ORDER BY group_id, provider_id))::VARCHAR, 6, '0') AS row_id FROM groups JOIN providers USING (process_id))"


@query("WITH " + _ROWS + " SELECT process_id, group_id, count(*) AS rows, min(row_id) AS first_row, max(row_id) AS last_row FROM trows GROUP BY 1, 2")
def dynamic_rows_cross(spark, d):
    return Stages(spark, d).rows.groupBy("process_id", "group_id").agg(F.count("*").alias("rows"), F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"))


_CELLS = _GROUPS + ", cells AS (SELECT n.process_id, group_id, i.document_id, min(price_cents) AS value FROM normalized n JOIN groups g USING (process_id, normalized_value, concept_type) JOIN items i ON i.pos = n.pos WHERE detector = 1 GROUP BY ALL), map AS (SELECT process_id, provider_id, count(DISTINCT document_id) AS document_count, min(document_id) AS first_document FROM items GROUP BY 1, 2), totals AS (SELECT process_id, provider_id, sum(price_cents)::BIGINT AS value FROM items GROUP BY 1, 2)"


@query("WITH " + _CELLS + " SELECT g.process_id, g.group_id, m.provider_id, m.first_document AS document_id, coalesce(c.value, CASE WHEN m.document_count = 1 THEN t.value END) AS value, c.value IS NULL AND m.document_count > 1 AS ambiguous FROM groups g JOIN map m USING (process_id) JOIN totals t USING (process_id, provider_id) LEFT JOIN cells c ON c.process_id = g.process_id AND c.group_id = g.group_id AND c.document_id = m.first_document")
def cell_fill_left_join(spark, d):
    s = Stages(spark, d)
    sources = tb.source_map(s.items)
    rows = s.groups.select("process_id", "group_id").join(sources.select("process_id", "provider_id", F.col("first_document").alias("document_id")), "process_id")
    cells = s.members.join(s.items.select("pos", "price_cents"), "pos").groupBy("process_id", "group_id", "document_id").agg(F.min("price_cents").alias("value"))
    totals = s.items.groupBy("process_id", "provider_id").agg(F.sum("price_cents").alias("value")).join(sources.select("process_id", "provider_id", "document_count"), ["process_id", "provider_id"])
    return tb.fill_cells(rows, cells, totals)


@query("WITH " + src.ITEMS_SQL + " SELECT process_id, provider_id, max(price_cents) AS price, max(length(specification))::BIGINT AS spec, count(*) FILTER (WHERE unit <> '') AS units FROM items GROUP BY 1, 2")
def matrix_pivot(spark, d):
    i = src.items(spark, d).groupBy("process_id", "provider_id").agg(F.max("price_cents").alias("price"), F.max(F.length("specification")).cast("long").alias("spec"), F.sum((F.col("unit") != "").cast("long")).alias("units"))
    long = i.unpivot(["process_id", "provider_id"], ["price", "spec", "units"], "name", "value")
    return tb.matrix(long, ["process_id", "provider_id"], ["price", "spec", "units"])


@query("WITH " + src.ITEMS_SQL + ", r AS (SELECT process_id, 'T' AS group_id, CASE WHEN pos % 2 = 0 THEN lower(provider_id) ELSE provider_id END AS provider_id, pos AS row_id FROM items), p AS (SELECT *, row_number() OVER (PARTITION BY process_id, group_id ORDER BY provider_id, row_id) AS logical_position FROM r) SELECT process_id, provider_id, row_id, logical_position FROM p QUALIFY row_number() OVER (PARTITION BY process_id, group_id, lower(trim(provider_id)) ORDER BY provider_id, row_id) = 1")
def provider_dedup_sort(spark, d):
    rows = src.items(spark, d).select("process_id", F.lit("T").alias("group_id"), F.when(F.col("pos") % 2 == 0, F.lower("provider_id")).otherwise(F.col("provider_id")).alias("provider_id"), F.col("pos").alias("row_id"))
    return tb.organized_providers(rows).select("process_id", "provider_id", "row_id", "logical_position")


@query("SELECT s_nationkey::VARCHAR AS provider_id, count(*) AS document_count, min(s_name) AS first_document, count(*) > 1 AS duplicate_document_source, 'P' AS process_id FROM supplier GROUP BY 1")
def provider_source_map(spark, d):
    s = src.table(spark, d, "supplier").select(F.lit("P").alias("process_id"), F.col("s_nationkey").cast("string").alias("provider_id"), F.col("s_name").alias("document_id"))
    return tb.source_map(s)


# Integrity


@query("SELECT l_orderkey, l_partkey, l_linenumber, 'duplicate_column' AS finding FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) > 1")
def integrity_duplicates(spark, d):
    return tb.duplicates(src.table(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber"], "duplicate_column").select("l_orderkey", "l_partkey", "l_linenumber", "finding")


@query("SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def dangling_refs_anti(spark, d):
    known = src.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return tb.dangling(src.table(spark, d, "events").select("user_id").distinct(), known, ["user_id"])


@query("SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders")
def orphan_columns_except(spark, d):
    return tb.orphans(src.table(spark, d, "customer").select(F.col("c_custkey").alias("key")), src.table(spark, d, "orders").select(F.col("o_custkey").alias("key")), ["key"])


@query("WITH a AS (SELECT DISTINCT doc_id AS k FROM documents), b AS (SELECT DISTINCT doc_id AS k FROM labels), c AS (SELECT DISTINCT page_id AS k FROM pages), e AS (SELECT DISTINCT conv_id AS k FROM conversations), u AS (SELECT k FROM a UNION SELECT k FROM b UNION SELECT k FROM c UNION SELECT k FROM e) SELECT k, k NOT IN (SELECT k FROM a) AS missing_documents, k NOT IN (SELECT k FROM b) AS missing_labels, k NOT IN (SELECT k FROM c) AS missing_pages, k NOT IN (SELECT k FROM e) AS missing_conversations FROM u")
def catalog_full_outer(spark, d):
    named = {"documents": "doc_id", "labels": "doc_id", "pages": "page_id", "conversations": "conv_id"}
    return tb.catalog_coverage({n: src.table(spark, d, n).select(F.col(k).alias("k")) for n, k in named.items()}, ["k"])


@query("SELECT o_orderkey, CASE WHEN count(*) FILTER (WHERE l_tax > 0.07) + count(*) FILTER (WHERE l_discount > 0.09) > 0 THEN 'invalid' ELSE 'valid' END AS status FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def validation_report(spark, d):
    bad = src.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum((F.col("l_tax") > 0.07).cast("int")).alias("a"), F.sum((F.col("l_discount") > 0.09).cast("int")).alias("b"))
    o = src.table(spark, d, "orders").select("o_orderkey")
    return o.join(bad, o.o_orderkey == bad.l_orderkey, "left").select("o_orderkey", tb.severity([F.col("a"), F.col("b")]).alias("status"))


# Evidence and analysis

_EVIDENCE = src.ITEMS_SQL + """, raw AS (
  SELECT process_id, provider_id, pos, 0 AS k, 'precio' AS key, 'commercial_information' AS source, price_cents::VARCHAR AS value FROM items
  UNION ALL SELECT process_id, provider_id, pos, 1, 'unidad', 'technical_information.fields', unit FROM items
  UNION ALL SELECT process_id, provider_id, pos, 2, 'specification', 'technical_information', specification FROM items
  UNION ALL SELECT process_id, provider_id, pos, 3, 'plazo_entrega', 'commercial_information.fields', priority FROM items),
evidence AS (SELECT process_id, provider_id, key, value, pos * 10 + k AS seq, CASE key WHEN 'precio' THEN 'commercial_conditions' WHEN 'plazo_entrega' THEN 'delivery_times' ELSE 'technical_information' END AS category FROM raw WHERE trim(value) <> '')"""


def _evidence(spark, d) -> DataFrame:
    parts = (("precio", "commercial_information", F.col("price_cents").cast("string")), ("unidad", "technical_information.fields", F.col("unit")), ("specification", "technical_information", F.col("specification")), ("plazo_entrega", "commercial_information.fields", F.col("priority")))
    long = src.items(spark, d).select("process_id", "provider_id", "pos", F.posexplode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(s).alias("source"), v.alias("value")) for k, s, v in parts))).alias("k", "x"))
    return long.where(tx.nonblank(F.col("x.value"))).select("process_id", "provider_id", F.col("x.key").alias("key"), F.col("x.value").alias("value"), (F.col("pos") * 10 + F.col("k")).alias("seq"), an.evidence_category(F.col("x.key"), F.col("x.source")).alias("category"))


@query("WITH " + _EVIDENCE + " SELECT process_id, provider_id, key, value, seq, category FROM evidence")
def evidence_unpivot(spark, d):
    return _evidence(spark, d)


@query("SELECT p_partkey, ['delivery_times', 'warranties', 'metadata', 'commercial_information', 'technical_information', 'certifications'][p_partkey % 6 + 1] AS category FROM part")
def evidence_category(spark, d):
    case = (F.col("p_partkey") % 6 + 1).cast("int")
    key = F.element_at(F.array(*map(F.lit, ("Plazo_Entrega", "garantia", "entrega", "color", "technical_color", "ISO 9001"))), case)
    source = F.element_at(F.array(*map(F.lit, ("commercial_information", "dynamic_columns", "metadata", "dynamic_columns.x", "dynamic_columns", "provider_organization"))), case)
    return src.table(spark, d, "part").select("p_partkey", an.evidence_category(key, source).alias("category"))


@query("WITH " + _EVIDENCE + f" SELECT p.process_id, p.provider_id, c.category FROM (SELECT DISTINCT process_id, provider_id FROM evidence) p, (SELECT unnest({[*an.CATEGORIES]}) AS category) c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.process_id = p.process_id AND e.provider_id = p.provider_id AND e.category = c.category)")
def missing_categories_anti(spark, d):
    return an.missing_categories(_evidence(spark, d), ["process_id", "provider_id"])


@query("WITH " + _EVIDENCE + " SELECT process_id, provider_id, key, count(DISTINCT value) AS n_values, count(DISTINCT category) AS n_categories, CASE WHEN count(DISTINCT category) > 1 THEN 'incompatible' ELSE 'contradictory' END AS kind FROM evidence GROUP BY 1, 2, 3 HAVING count(*) >= 2 AND (count(DISTINCT value) > 1 OR count(DISTINCT category) > 1)")
def non_contradiction(spark, d):
    return an.contradictions(_evidence(spark, d), ["process_id"])


_COUNTS = _EVIDENCE + """, counted AS (
  SELECT process_id, provider_id, count(*) AS evidence, count(*) FILTER (WHERE key = 'plazo_entrega') AS strengths, count(*) FILTER (WHERE key = 'unidad') AS weaknesses,
    2 * count(*) FILTER (WHERE value LIKE '%URGENT') AS risks, (10 - count(DISTINCT category))::BIGINT AS missing FROM evidence GROUP BY 1, 2)"""


def _counted(spark, d) -> DataFrame:
    """Counters of each provider; risks count twice, from the segments and from the profile."""
    one = lambda c: F.sum(c.cast("long"))
    return _evidence(spark, d).groupBy("process_id", "provider_id").agg(F.count("*").alias("evidence"), one(F.col("key") == "plazo_entrega").alias("strengths"), one(F.col("key") == "unidad").alias("weaknesses"), (2 * one(F.col("value").endswith("URGENT"))).alias("risks"), (10 - F.countDistinct("category")).alias("missing"))


@query("WITH " + _EVIDENCE + " SELECT process_id, category, count(*) AS risks FROM evidence WHERE value LIKE '%URGENT' OR key = 'unidad' GROUP BY 1, 2")
def risk_counts(spark, d):
    return _evidence(spark, d).where(F.col("value").endswith("URGENT") | (F.col("key") == "unidad")).groupBy("process_id", "category").agg(F.count("*").alias("risks"))


_CONTEXT = _EVIDENCE + ", elements AS (SELECT DISTINCT process_id, unnest(['entrega', 'garantia', 'precio_unitario', 'marca']) AS key, '1-URGENT' AS value FROM items), kinds AS (SELECT DISTINCT process_id, key, value FROM evidence)"


def _elements(spark, d) -> DataFrame:
    return src.items(spark, d).select("process_id").distinct().select("process_id", F.explode(F.array(*map(F.lit, ("entrega", "garantia", "precio_unitario", "marca")))).alias("key"), F.lit("1-URGENT").alias("value"))


@query("WITH " + _CONTEXT + " SELECT DISTINCT e.process_id, e.key AS element, k.key AS key FROM elements e JOIN kinds k ON e.process_id = k.process_id AND (contains(e.key, k.key) OR contains(k.key, e.key) OR e.value = k.value)")
def context_theta_match(spark, d):
    return an.context_matches(_elements(spark, d), _evidence(spark, d).select("process_id", "key", "value").distinct(), ["process_id"]).distinct()


@query("WITH " + _COUNTS + " SELECT process_id, provider_id, evidence, strengths, weaknesses, risks, missing, (evidence + strengths - weaknesses - risks - missing)::DOUBLE AS score FROM counted")
def provider_score(spark, d):
    return an.provider_scores(_counted(spark, d))


@query("WITH " + _COUNTS + ", s AS (SELECT *, (evidence + strengths - weaknesses - risks - missing)::DOUBLE AS score, sum(evidence) OVER w AS te, sum(missing) OVER w AS tm FROM counted WINDOW w AS (PARTITION BY process_id)), r AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS nxt FROM s WINDOW o AS (PARTITION BY process_id ORDER BY score DESC, provider_id)) SELECT process_id, provider_id AS first_provider, score, score - nxt AS gap, CASE WHEN te < 1 OR evidence < 1 OR tm > 0.6 * (te + tm) THEN 'insufficient_information' WHEN nxt IS NULL OR score - nxt >= 2 THEN 'clear_winner' WHEN score - nxt <= 1 THEN 'equivalent_alternatives' ELSE 'clear_winner' END AS scenario FROM r WHERE rank = 1")
def scenario_topk_gap(spark, d):
    return an.scenario(an.provider_scores(_counted(spark, d)))


@query("WITH " + _COUNTS + " SELECT process_id, provider_id, CASE WHEN weaknesses <= evidence // 4 AND evidence * 1.0 / (evidence + missing) >= 0.8 AND risks <= 2 AND missing <= 7 THEN 'high' WHEN weaknesses <= evidence // 4 AND evidence * 1.0 / (evidence + missing) >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM counted")
def confidence_level(spark, d):
    c = F.col
    return _counted(spark, d).select("process_id", "provider_id", an.confidence(c("evidence") / (c("evidence") + c("missing")), c("weaknesses") <= F.floor(c("evidence") / 4), c("risks"), F.greatest(c("missing") - 6, F.lit(0)), F.lit(0)).alias("confidence"))


# Validation, recognition and the operations log


@query("SELECT doc_id, list_filter([CASE WHEN doc_id % 11 = 0 THEN 'corrupt' END, CASE WHEN n_chars = 0 THEN 'empty' END, CASE WHEN doc_id % 13 = 0 THEN 'inaccessible' END, CASE WHEN n_chars < 50 THEN 'incomplete' END, CASE WHEN lang = 'es' AND doc_id % 5 = 0 THEN 'inconsistent' END, CASE WHEN n_chars < 1 OR n_chars > 50000000 THEN 'invalid_size' END, CASE WHEN doc_id % 17 = 0 THEN 'unsupported_format' END], lambda x: x IS NOT NULL) AS incidents, CASE WHEN doc_id % 11 = 0 OR n_chars = 0 OR doc_id % 13 = 0 OR n_chars < 50 OR (lang = 'es' AND doc_id % 5 = 0) OR n_chars > 50000000 OR doc_id % 17 = 0 THEN 'failed' WHEN n_chars > 5000 THEN 'warning' ELSE 'passed' END AS status FROM documents")
def validation_rules(spark, d):
    k, n = F.col("doc_id"), F.col("n_chars")
    broken = ops.incidents({"corrupt": k % 11 == 0, "size": n, "accessible": k % 13 != 0, "incomplete": n < 50, "inconsistent": (F.col("lang") == "es") & (k % 5 == 0), "format": F.when(k % 17 == 0, "other").otherwise("pdf")})
    return src.table(spark, d, "documents").select("doc_id", broken.alias("incidents"), ops.validation_status(F.size(broken), (n > 5000).cast("int")).alias("status"))


@query("SELECT p_partkey, ['word', 'pdf', 'excel', 'image', NULL][p_partkey % 5 + 1] AS format, [0.98, 0.95, 0.9, 0.85, NULL][p_partkey % 5 + 1]::DOUBLE AS confidence FROM part")
def recognition_argmax(spark, d):
    k = (F.col("p_partkey") % 5 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*(F.lit(x).cast("string") for x in xs)), k)
    best = ops.recognized(pick("PK34", "xx", "", "", ""), pick(None, "pdf", None, None, None), pick("a.xlsx", "a.png", "A.XLSX", "a.bin", "none"), pick("application/pdf", "image/png", "image/png", "image/png", "text/x"))
    return src.table(spark, d, "part").select("p_partkey", best["format"].alias("format"), best["confidence"].alias("confidence"))


@query("SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def event_trim_latest_n(spark, d):
    return ops.newest(src.table(spark, d, "events"), "user_id", 5).select("event_id", "user_id", "event_type")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS transitions FROM events GROUP BY 1")
def state_latest(spark, d):
    return ops.latest_state(src.table(spark, d, "events"), "user_id")


_FLOW = ["signup", "view", "click", "purchase"]


@query(f"WITH s AS (SELECT event_id, user_id, ts, event_type, coalesce(list_position({_FLOW}, event_type), 0)::BIGINT AS to_step FROM events), l AS (SELECT *, coalesce(lag(to_step) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS from_step FROM s) SELECT event_id, user_id, from_step, to_step FROM l WHERE to_step <> from_step + 1")
def illegal_transitions_lag(spark, d):
    return ops.illegal_transitions(src.table(spark, d, "events"), "user_id", _FLOW).select("event_id", "user_id", "from_step", "to_step")


@query("SELECT event_id, event_type AS lane, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events")
def fifo_position(spark, d):
    return ops.fifo_positions(src.table(spark, d, "events").select("event_id", F.col("event_type").alias("lane"), "ts"), "lane", ["ts", "event_id"]).select("event_id", "lane", "position")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'signup' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1")
def enqueue_duplicates(spark, d):
    return ops.active_duplicates(src.table(spark, d, "events").where("event_type = 'signup'"), "user_id").select("event_id", "user_id")


@query("SELECT event_type AS kind, count(*) AS n, round(coalesce(avg(value), 0), 4) AS mean FROM events GROUP BY 1")
def metrics_avg(spark, d):
    return src.table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"))


@query("SELECT event_id, ['validation', 'temporary', 'documental', 'system_internal', 'processing', 'communication'][event_id % 6 + 1] AS category, event_id % 6 + 1 IN (2, 5, 6) AS recoverable FROM events")
def error_category(spark, d):
    k = (F.col("event_id") % 6 + 1).cast("int")
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), k)
    cat = ops.error_category(pick("Required_Field_Missing", "", "x", "", "", "api_not_initialized"), pick("timeout", "Timeout in connection", "documento sin evidencia", "nada", "pipeline", "valid"))
    return src.table(spark, d, "events").select("event_id", cat.alias("category"), cat.isin(*ops.RECOVERABLE).alias("recoverable"))


@query("SELECT event_id, user_id, sum(CASE event_type WHEN 'signup' THEN 2 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS usage FROM events")
def running_resource_usage(spark, d):
    amount = F.when(F.col("event_type") == "signup", 2).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return ops.running_usage(src.table(spark, d, "events"), "user_id", amount).select("event_id", "user_id", "usage")


@query("SELECT user_id, count(*) AS concurrent, CASE WHEN count(*) >= 10 THEN 'horizontal_prepared' WHEN count(*) >= 5 THEN 'vertical_prepared' ELSE 'single_node' END AS mode FROM events GROUP BY 1")
def capacity_mode(spark, d):
    n = src.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("concurrent"))
    return n.withColumn("mode", ops.capacity_mode(F.col("concurrent"), 10))
