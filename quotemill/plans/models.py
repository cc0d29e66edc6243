"""Queries of the comparison models, their quality checks, recommendations and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from quotemill.operators import analysis as an
from quotemill.operators import concepts as co
from quotemill.operators import models as md
from quotemill.operators import tables as tb
from quotemill.plans import registry as r
from quotemill.plans.registry import query
from quotemill.plans.stages import Stages
from quotemill.sources import quotations as src


@query("WITH " + r._GROUPS + " SELECT n.pos AS node, g.first_member AS component FROM normalized n JOIN groups g USING (process_id, normalized_value, concept_type) WHERE detector = 1")
def union_find_groups(spark, d):
    return co.clusters(Stages(spark, d).item_concepts)


@query("WITH " + src.ITEMS_SQL + " SELECT document_id, pos, description, false AS seeded FROM items WHERE quantity <> '' UNION ALL SELECT document_id, pos, description, true FROM items WHERE document_id NOT IN (SELECT document_id FROM items WHERE quantity <> '')")
def seed_concepts(spark, d):
    items = src.items(spark, d)
    return md.seeded_concepts(items.where("quantity <> ''"), items)


@query("WITH " + r._NORMALIZED + " SELECT process_id, document_id, count(*) AS concepts, string_agg(DISTINCT concept_type, ',' ORDER BY concept_type) AS types FROM normalized GROUP BY 1, 2")
def document_snapshot(spark, d):
    return md.document_snapshot(Stages(spark, d).normalized)


_TABLES = r._GROUPS + ", tables AS (SELECT process_id, group_id, 'CTS-' || lpad((row_number() OVER (PARTITION BY process_id ORDER BY group_id))::VARCHAR, 6, '0') AS table_id FROM groups)"


@query("WITH " + _TABLES + " SELECT process_id, group_id, table_id FROM tables")
def table_structures(spark, d):
    return md.structures(Stages(spark, d).groups)


@query("WITH " + src.ITEMS_SQL + ", docs AS (SELECT DISTINCT process_id, document_id, provider_id FROM items) SELECT process_id, row_number() OVER (PARTITION BY process_id ORDER BY document_id) AS position, provider_id FROM docs WHERE process_id NOT LIKE '%-01' UNION ALL SELECT DISTINCT process_id, 1, 'PROVEEDOR-1' FROM docs WHERE process_id LIKE '%-01'")
def provider_injection(spark, d):
    docs = src.items(spark, d).select("process_id", "document_id", F.when(~F.col("process_id").endswith("-01"), F.col("provider_id")).alias("provider_id")).distinct()
    return md.document_providers(docs)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderkey IS NULL THEN 'missing_structure' ELSE 'built' END AS outcome FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey")
def row_structure_lookup(spark, d):
    tables = src.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return md.looked_up(src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), tables, ["l_orderkey"])


@query("WITH m AS (SELECT s_nationkey, count(*) AS document_count FROM supplier WHERE s_acctbal > 0 GROUP BY 1) SELECT c_custkey, c_nationkey::VARCHAR AS provider_id, document_count, document_count > 1 AS ambiguous FROM customer LEFT JOIN m ON c_nationkey = s_nationkey")
def source_map_injection(spark, d):
    nation = F.col("s_nationkey").cast("string").alias("provider_id")
    sources = src.table(spark, d, "supplier").where("s_acctbal > 0").groupBy(nation).agg(F.count("*").alias("document_count")).withColumn("position", F.lit(1))
    return md.inject_sources(src.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("provider_id")), sources)


@query("SELECT p_partkey, [p_brand, 'USD', p_size::VARCHAR, '', p_name, 'P1', 'x.pdf', ''][p_partkey % 8 + 1] AS value FROM part")
def cell_value_resolution(spark, d):
    k = F.col("p_partkey")
    attribute = F.element_at(F.array(*map(F.lit, ("Proveedor", "moneda", "monto", "pago", "item", "provider", "documento", "color"))), (k % 8 + 1).cast("int"))
    document = {"provider": F.when(k % 8 == 0, F.col("p_brand")), "currency": F.lit("USD"), "total": F.col("p_size").cast("string"), "payment_terms": F.lit(None).cast("string"), "quantity": F.lit("1"), "unit_price": F.lit("2"), "description": F.col("p_name"), "file_name": F.lit("x.pdf")}
    return src.table(spark, d, "part").select("p_partkey", md.cell_value(attribute, document, F.lit("P1")).alias("value"))


_TRACE = _TABLES + r._ATTRIBUTES.removeprefix(r._GROUPS) + r._ROWS.removeprefix(r._GROUPS)


@query("WITH " + _TRACE + ", c AS (SELECT process_id, group_id, count(*) AS columns FROM columns GROUP BY 1, 2), w AS (SELECT process_id, group_id, count(*) AS rows FROM trows GROUP BY 1, 2) SELECT process_id, group_id, table_id, c.columns, w.rows, true AS integrity, 'TME-' || right(table_id, 6) AS trace_id FROM tables JOIN c USING (process_id, group_id) JOIN w USING (process_id, group_id)")
def traceability_enrichment(spark, d):
    s = Stages(spark, d)
    return md.traced(md.structures(s.groups), s.columns, s.rows)


@query("WITH " + _TABLES + " SELECT t.process_id, t.group_id, table_id, 'CMD-' || right(table_id, 6) AS model_id, string_agg(DISTINCT n.document_id, ',' ORDER BY n.document_id) AS documents FROM tables t JOIN groups g ON t.process_id = g.process_id AND t.group_id = g.group_id JOIN normalized n ON n.process_id = g.process_id AND n.normalized_value = g.normalized_value AND n.concept_type = g.concept_type WHERE detector = 1 GROUP BY 1, 2, 3")
def definitive_models(spark, d):
    s = Stages(spark, d)
    return md.definitive_models(md.structures(s.groups), s.members).withColumn("documents", F.array_join("documents", ","))


@query("WITH f AS (SELECT l_orderkey, l_linenumber, l_tax, s_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) > 1 AS dc, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber) > 1 AS dp FROM lineitem LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON l_suppkey = s_suppkey) SELECT l_orderkey, l_linenumber, 'duplicate_column' AS category, 'error' AS severity FROM f WHERE dc UNION ALL SELECT l_orderkey, l_linenumber, 'duplicate_provider', 'error' FROM f WHERE dp UNION ALL SELECT l_orderkey, l_linenumber, 'dangling_provider', 'error' FROM f WHERE s_suppkey IS NULL UNION ALL SELECT l_orderkey, l_linenumber, 'missing_document', 'warning' FROM f WHERE l_tax = 0")
def group_integrity_findings(spark, d):
    rows = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax")
    known = src.table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    joined = rows.join(known, rows.l_suppkey == known.s_suppkey, "left")
    marked = joined.withColumn("dc", md.repeated(["l_orderkey", "l_partkey"], ["l_linenumber"])).withColumn("dp", md.repeated(["l_orderkey", "l_suppkey"], ["l_linenumber"]))
    checks = {("duplicate_column", "error"): F.col("dc"), ("duplicate_provider", "error"): F.col("dp"), ("dangling_provider", "error"): F.col("s_suppkey").isNull(), ("missing_document", "warning"): F.col("l_tax") == 0}
    return md.group_findings(marked, ["l_orderkey", "l_linenumber"], checks)


@query("SELECT catalog, n, true AS mismatch FROM (SELECT 'orders' AS catalog, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier)")
def catalog_set_counts(spark, d):
    return md.set_counts({n: src.table(spark, d, n) for n in ("orders", "customer", "part", "supplier")})


@query("WITH " + src.ITEMS_SQL + " SELECT document_id, pos, 'quantity' AS field FROM items WHERE trim(quantity) = '' UNION ALL SELECT document_id, pos, 'unit' FROM items WHERE trim(unit) = ''")
def completeness_checks(spark, d):
    return md.blank_fields(src.items(spark, d), ["document_id", "pos"], ["quantity", "unit", "description", "specification"])


@query("WITH u AS (SELECT c_custkey AS id, 'c' AS k FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier UNION ALL SELECT p_partkey, 'p' FROM part) SELECT id, count(*) AS n, count(DISTINCT k) AS catalogs FROM u GROUP BY 1 HAVING count(*) > 1")
def global_uniqueness(spark, d):
    named = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
    return md.shared_ids({n: src.table(spark, d, n).select(F.col(k).alias("id")) for n, k in named.items()})


@query("WITH " + _TABLES + " SELECT process_id, (SELECT count(*) FROM concepts c WHERE c.process_id = p.process_id) AS concepts, (SELECT count(*) FROM normalized c WHERE c.process_id = p.process_id) AS normalized, (SELECT count(*) FROM tables c WHERE c.process_id = p.process_id) AS tables, EXISTS (SELECT 1 FROM tables c WHERE c.process_id = p.process_id) AS complete FROM (SELECT DISTINCT process_id FROM items) p")
def trace_chain_quality(spark, d):
    s = Stages(spark, d)
    return md.chain_quality({"concepts": s.concepts, "normalized": s.normalized, "tables": md.structures(s.groups)})


@query("SELECT event_id, 'model_mismatch' AS category FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 'group_mismatch' FROM events WHERE event_id % 11 = 0 UNION ALL SELECT event_id, 'no_document' FROM events WHERE event_id % 13 = 0")
def integrity_evaluation(spark, d):
    k = F.col("event_id")
    evidence = src.table(spark, d, "events").select("event_id", F.lit("M").alias("model_id"), F.lit("G").alias("group_id"), F.when(k % 7 != 0, "M").alias("trace_model"), F.when(k % 11 == 0, "H").otherwise("G").alias("trace_group"), F.when(k % 13 == 0, " ").otherwise("d").alias("document_id"))
    return md.trace_issues(evidence, ["event_id"])


@query("WITH " + r._ATTRIBUTES + " SELECT DISTINCT process_id, name AS key FROM columns c WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.process_id = c.process_id AND i.specification = c.name AND i.unit <> '')")
def columns_without_value(spark, d):
    s = Stages(spark, d)
    keys = s.items.where("unit <> ''").select("process_id", F.col("specification").alias("key"))
    return tb.dangling(s.columns.select("process_id", F.col("name").alias("key")).distinct(), keys, ["process_id", "key"])


_RISKS = r._COUNTS + f""", missed AS (SELECT p.process_id, p.provider_id FROM (SELECT DISTINCT process_id, provider_id FROM evidence) p, (SELECT unnest({[*an.CATEGORIES]}) AS category) c WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.process_id = p.process_id AND e.provider_id = p.provider_id AND e.category = c.category)),
against AS (SELECT process_id, provider_id, CASE WHEN count(DISTINCT category) > 1 THEN 'technical' ELSE 'consistency' END AS risk_category FROM evidence GROUP BY process_id, provider_id, key HAVING count(*) >= 2 AND (count(DISTINCT value) > 1 OR count(DISTINCT category) > 1)),
risks AS (SELECT process_id, provider_id, 'documentation' AS risk_category FROM missed UNION ALL SELECT * FROM against UNION ALL SELECT process_id, provider_id, 'information' FROM counted WHERE evidence = 0 OR risks > 40 OR missing > 0 OR weaknesses > 0)"""


def _risks(spark, d):
    evidence, counted, c = r._evidence(spark, d), r._counted(spark, d), F.col
    against = an.contradictions(evidence, ["process_id"]).withColumn("criterion", F.lit("non_contradiction"))
    level = counted.select("process_id", "provider_id", an.sufficiency(c("evidence"), c("missing"), c("weaknesses"), F.when(c("risks") > 40, 1).otherwise(0)).alias("level"))
    return md.risks(an.missing_categories(evidence, ["process_id", "provider_id"]), against, level)


@query("WITH " + _RISKS + " SELECT process_id, provider_id, risk_category, count(*) AS n FROM risks GROUP BY 1, 2, 3")
def risk_identification(spark, d):
    return _risks(spark, d).groupBy("process_id", "provider_id", "risk_category").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, ['commercial_requirement', 'commercial_requirement', 'technical_requirement', 'limitation', 'general_requirement', 'technical_requirement'][p_partkey % 6 + 1] AS element_type FROM part")
def context_elements(spark, d):
    key = F.element_at(F.array(*map(F.lit, ("condicion_comercial", "Precio_max", "especificacion", "limite_plazo", "marca", "detalle tecnico"))), (F.col("p_partkey") % 6 + 1).cast("int"))
    return src.table(spark, d, "part").select("p_partkey", md.element_type(key).alias("element_type"))


@query("WITH " + r._COUNTS + " SELECT process_id, sum(evidence)::BIGINT AS total_evidence, sum(missing)::BIGINT AS total_missing, sum(evidence) / (sum(evidence) + sum(missing)) AS ratio FROM counted GROUP BY 1")
def coverage_metrics(spark, d):
    return md.coverage(r._counted(spark, d), ["process_id"])


_DECIDED = r._COUNTS + ", s AS (SELECT *, (evidence + strengths - weaknesses - risks - missing)::DOUBLE AS score, sum(evidence) OVER w AS te, sum(missing) OVER w AS tm FROM counted WINDOW w AS (PARTITION BY process_id)), r AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS nxt FROM s WINDOW o AS (PARTITION BY process_id ORDER BY score DESC, provider_id)), decided AS (SELECT process_id, provider_id, score, CASE WHEN te < 1 OR evidence < 1 OR tm > 0.6 * (te + tm) THEN 'insufficient_information' WHEN nxt IS NULL OR score - nxt >= 2 THEN 'clear_winner' ELSE 'equivalent_alternatives' END AS scenario FROM r WHERE rank = 1), profile AS (SELECT d.process_id, scenario, CASE WHEN scenario = 'clear_winner' THEN d.provider_id END AS recommended, CASE WHEN scenario = 'equivalent_alternatives' THEN (SELECT count(*) FROM s WHERE s.process_id = d.process_id AND d.score - s.score <= 1) ELSE 0 END AS alternatives FROM decided d)"


@query("WITH " + _DECIDED + " SELECT process_id, scenario, recommended, alternatives FROM profile")
def recommendation_profile(spark, d):
    return md.recommendation(an.provider_scores(r._counted(spark, d)))


@query("WITH " + r._EVIDENCE + ", f AS (SELECT process_id, value, min(seq) AS first FROM evidence WHERE key = 'specification' GROUP BY 1, 2) SELECT process_id, value, row_number() OVER (PARTITION BY process_id ORDER BY first, value) AS position FROM f")
def limitations_in_order(spark, d):
    return md.distinct_in_order(r._evidence(spark, d).where("key = 'specification'"), ["process_id"], "value", "seq")


@query("WITH " + _DECIDED + _RISKS.removeprefix(r._COUNTS) + ", n AS (SELECT process_id, count(*) AS risks FROM risks GROUP BY 1), c AS (SELECT process_id, sum(evidence)::BIGINT AS total_evidence FROM counted GROUP BY 1) SELECT process_id, scenario, recommended, alternatives, n.risks, total_evidence FROM profile JOIN n USING (process_id) JOIN c USING (process_id)")
def final_results(spark, d):
    counted = r._counted(spark, d)
    profile = md.recommendation(an.provider_scores(counted))
    counts = _risks(spark, d).groupBy("process_id").agg(F.count("*").alias("risks"))
    covered = md.coverage(counted, ["process_id"]).select("process_id", "total_evidence")
    return profile.join(counts, "process_id", "left").join(covered, "process_id", "left").na.fill(0, ["risks"])
