"""Queries of the evidence of models: families, missing evidence, consistency, context, explanations and recommendations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from quotemill.operators import analysis as an
from quotemill.operators import evidence as ev
from quotemill.plans.registry import query
from quotemill.plans.stages import Stages
from quotemill.sources import quotations as src

_CATS = [*an.CATEGORIES]
_EV = (
    "WITH "
    + src.ITEMS_SQL
    + """,
m AS (SELECT process_id, sum(price_cents)::BIGINT::VARCHAR AS total, min(currency) AS currency, min(priority) AS priority, count(*)::VARCHAR AS n, list_sort(list_distinct(list(specification))) AS specs FROM items GROUP BY 1),
p AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY provider_id) AS place FROM (SELECT process_id, provider_id, min(price_cents) AS price, max(size) AS size, max(unit) AS unit, list_sort(list_distinct(list(specification)))[1:2] AS specs FROM items GROUP BY 1, 2)),
raw AS (
  SELECT process_id, NULL::VARCHAR AS provider_id, 0 AS section, 0 AS place, 0 AS part, 0 AS i, 'commercial_information.fields' AS source, 'moneda' AS key, currency AS value, 'commercial_conditions' AS category FROM m
  UNION ALL SELECT process_id, NULL, 0, 0, 0, 1, 'commercial_information.fields', 'monto_total', total, 'commercial_conditions' FROM m
  UNION ALL SELECT process_id, NULL, 1, 0, 0, 0, 'technical_information.fields', 'items', n, 'technical_information' FROM m
  UNION ALL SELECT process_id, NULL, 2, 0, 0, generate_subscripts(specs, 1), 'technical_information.specifications', unnest(specs), unnest(specs), 'technical_information' FROM m
  UNION ALL SELECT process_id, NULL, 3, 0, 0, 0, 'inherited_context', 'limite_plazo', priority, 'requirement_context' FROM m
  UNION ALL SELECT process_id, NULL, 4, 0, 0, 0, 'metadata', 'origen', 'items', 'metadata' FROM m
  UNION ALL SELECT process_id, NULL, 5, 0, 0, 0, 'motor_internal_references', 'catalogo', 'CAT-' || process_id, 'metadata' FROM m
  UNION ALL SELECT process_id, NULL, 6, 0, 0, 0, 'dynamic_columns.', 'group_type', '', 'commercial_information' FROM m
  UNION ALL SELECT process_id, NULL, 6, 0, 0, 1, 'dynamic_columns.commercial', 'technical_size', '', 'technical_information' FROM m
  UNION ALL SELECT process_id, NULL, 6, 0, 0, 2, 'dynamic_columns.', 'plazo_entrega', '', 'delivery_times' FROM m
  UNION ALL SELECT process_id, provider_id, 7, place, 0, 0, 'provider_organization.commercial_information.fields', 'garantia', '12 meses', 'warranties' FROM p WHERE provider_id NOT LIKE '%4'
  UNION ALL SELECT process_id, provider_id, 7, place, 0, 1, 'provider_organization.commercial_information.fields', 'peso', (price % 3)::VARCHAR, 'commercial_information' FROM p
  UNION ALL SELECT process_id, provider_id, 7, place, 0, 2, 'provider_organization.commercial_information.fields', 'precio', price::VARCHAR, 'commercial_conditions' FROM p
  UNION ALL SELECT process_id, provider_id, 7, place, 1, 0, 'provider_organization.technical_information.fields', 'peso', (size % 3)::VARCHAR, 'technical_information' FROM p
  UNION ALL SELECT process_id, provider_id, 7, place, 1, 1, 'provider_organization.technical_information.fields', 'unidad', unit, 'technical_information' FROM p WHERE unit <> ''
  UNION ALL SELECT process_id, provider_id, 7, place, 2, generate_subscripts(specs, 1), 'provider_organization.technical_information.specifications', unnest(specs), unnest(specs), 'technical_information' FROM p),
evidence AS (SELECT process_id, provider_id, row_number() OVER (PARTITION BY process_id ORDER BY section, place, part, i) AS seq, source, key, value, category FROM raw)"""
)
_GONE = (
    _EV
    + f""",
gone AS (SELECT process_id, row_number() OVER (PARTITION BY process_id ORDER BY o, k) AS n, expected_key, category, provider_id FROM (
  SELECT process_id, 0 AS o, provider_id AS k, 'cell_values' AS expected_key, 'commercial_information' AS category, provider_id FROM p WHERE provider_id LIKE '%7'
  UNION ALL SELECT q.process_id, 1, lpad(list_position({_CATS}, c)::VARCHAR, 2, '0'), c, c, NULL FROM (SELECT DISTINCT process_id FROM evidence) q, (SELECT unnest({_CATS}) AS c) WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.process_id = q.process_id AND e.category = c)))"""
)
_FOUND = (
    _GONE
    + """,
ends AS (SELECT process_id, provider_id, CASE WHEN category = 'technical_information' THEN 't' ELSE 'c' END AS side, lower(trim(key)) AS key, arg_max(value, seq) AS value FROM evidence WHERE category IN ('commercial_information', 'commercial_conditions', 'technical_information') GROUP BY ALL),
incoherent AS (SELECT a.process_id, a.provider_id, a.key, a.value AS commercial_value, b.value AS technical_value FROM ends a JOIN ends b ON a.process_id = b.process_id AND a.provider_id IS NOT DISTINCT FROM b.provider_id AND a.key = b.key AND a.side = 'c' AND b.side = 't' WHERE a.value <> b.value),
comparable AS (SELECT process_id, provider_id, lower(trim(key)) AS key FROM evidence WHERE provider_id IS NOT NULL AND category IN ('commercial_information', 'commercial_conditions', 'technical_information')),
apart AS (SELECT process_id, key, count(DISTINCT provider_id) AS present, any_value(providers) AS providers FROM comparable JOIN (SELECT process_id, count(DISTINCT provider_id) AS providers FROM comparable GROUP BY 1) USING (process_id) GROUP BY 1, 2 HAVING any_value(providers) >= 2 AND count(DISTINCT provider_id) < any_value(providers)),
found AS (
  SELECT process_id, provider_id, 'contradictory' AS kind, 'commercial_technical_coherence' AS criterion, key AS subject FROM incoherent
  UNION ALL SELECT process_id, NULL, 'relevant_difference', 'provider_comparability', key FROM apart
  UNION ALL SELECT process_id, provider_id, CASE WHEN count(DISTINCT category) > 1 THEN 'incompatible' ELSE 'contradictory' END, 'non_contradiction', key FROM evidence GROUP BY process_id, provider_id, key HAVING count(*) >= 2 AND (count(DISTINCT value) > 1 OR count(DISTINCT category) > 1)
  UNION ALL SELECT DISTINCT process_id, NULL, 'incomplete_reference', 'column_without_value', key FROM evidence e WHERE starts_with(source, 'dynamic_columns') AND NOT EXISTS (SELECT 1 FROM evidence f WHERE f.process_id = e.process_id AND f.provider_id IS NOT NULL AND lower(f.key) = lower(e.key)))"""
)
_LEVELS = (
    _FOUND
    + """,
sums AS (SELECT process_id, (SELECT count(*) FROM evidence e WHERE e.process_id = m.process_id) AS evidence, (SELECT count(*) FROM gone e WHERE e.process_id = m.process_id) AS missing, (SELECT count(*) FROM found e WHERE e.process_id = m.process_id) AS inconsistencies, (SELECT count(*) FROM found e WHERE e.process_id = m.process_id AND kind = 'contradictory') AS contradictory FROM m),
levels AS (SELECT *, CASE WHEN evidence = 0 OR contradictory > 0 THEN 'insufficient' WHEN missing > 0 OR inconsistencies > 0 THEN 'partial' ELSE 'sufficient' END AS level FROM sums),
risk AS (
  SELECT process_id, provider_id, 'documentation' AS risk_category, 'missing:' || expected_key AS description FROM gone
  UNION ALL SELECT process_id, provider_id, CASE WHEN kind = 'incomplete_reference' THEN 'documentation' WHEN kind = 'relevant_difference' THEN 'information' WHEN criterion = 'commercial_technical_coherence' THEN 'commercial' WHEN kind = 'incompatible' THEN 'technical' ELSE 'consistency' END, kind || ':' || criterion || ':' || subject FROM found
  UNION ALL SELECT process_id, NULL, 'information', 'sufficiency:' || level FROM levels WHERE level <> 'sufficient')"""
)
_LINKED = (
    _LEVELS
    + f""",
elements AS (
  SELECT process_id, 0 AS n, 'description' AS key, 'Compra de ' || process_id AS value, 'objective' AS element_type FROM m WHERE right(process_id, 2) NOT IN ('01', '02')
  UNION ALL SELECT process_id, 1, 'moneda', 'USD', 'commercial_requirement' FROM m WHERE right(process_id, 2) <> '02'
  UNION ALL SELECT process_id, 2, 'precio_maximo', '100', 'commercial_requirement' FROM m WHERE right(process_id, 2) <> '02'
  UNION ALL SELECT process_id, 3, 'peso', '1', 'technical_requirement' FROM m WHERE right(process_id, 2) <> '02'
  UNION ALL SELECT process_id, 4, 'limite_plazo', priority, 'limitation' FROM m WHERE right(process_id, 2) <> '02'
  UNION ALL SELECT process_id, 5, 'marca', 'X', 'general_requirement' FROM m WHERE right(process_id, 2) <> '02'),
matched AS (SELECT DISTINCT e.process_id, e.n, v.seq, v.provider_id FROM elements e JOIN evidence v ON e.process_id = v.process_id AND (contains(lower(e.key), lower(v.key)) OR contains(lower(v.key), lower(e.key)) OR e.value = v.value)
  AND CASE WHEN element_type IN ('objective', 'commercial_requirement') THEN category IN ('commercial_information', 'commercial_conditions', 'delivery_times') WHEN element_type = 'technical_requirement' THEN category IN ('technical_information', 'certifications', 'warranties')
    WHEN element_type = 'general_requirement' THEN true ELSE category IN {tuple([*ev.CONTEXT_COMMERCIAL, *ev.CONTEXT_TECHNICAL, "requirement_context"])} END),
linked AS (SELECT e.process_id, e.n, e.key, e.element_type, CASE WHEN e.element_type = 'limitation' THEN 'limitation' ELSE 'alignment' END AS association_type, count(*) AS evidence_count, min(seq) AS first_seq, coalesce(string_agg(DISTINCT x.provider_id, ',' ORDER BY x.provider_id), '') AS providers FROM elements e JOIN matched x ON e.process_id = x.process_id AND e.n = x.n GROUP BY ALL),
gaps AS (
  SELECT process_id, 'requirement_without_evidence' AS gap_type, key AS subject FROM elements e WHERE element_type <> 'limitation' AND NOT EXISTS (SELECT 1 FROM linked l WHERE l.process_id = e.process_id AND l.key = e.key)
  UNION ALL SELECT process_id, 'evidence_without_context', key FROM evidence e WHERE category <> 'metadata' AND NOT EXISTS (SELECT 1 FROM matched x WHERE x.process_id = e.process_id AND x.seq = e.seq)
  UNION ALL SELECT process_id, 'insufficient_context_data', 'requirement_context' FROM m WHERE right(process_id, 2) = '02'
  UNION ALL SELECT process_id, 'quotation_requirement_difference', risk_category FROM risk WHERE starts_with(description, 'relevant_difference:'))"""
)
_SEGMENTS = (
    _LINKED
    + """,
segments AS (
  SELECT process_id, 'analysis_summary' AS section, 'analysis_summary' AS template, 'model_analysis_summary' AS subject, NULL::VARCHAR AS provider_id FROM levels
  UNION ALL SELECT process_id, 'evidence_used', 'evidence_used', key, provider_id FROM evidence
  UNION ALL SELECT process_id, 'strength', 'evidence_present', key, provider_id FROM evidence WHERE value <> ''
  UNION ALL SELECT process_id, 'weakness', 'missing_evidence', expected_key, provider_id FROM gone
  UNION ALL SELECT process_id, 'weakness', 'inconsistency_detected', criterion, NULL FROM found
  UNION ALL SELECT process_id, 'risk', 'risk_identified', risk_category, provider_id FROM risk
  UNION ALL SELECT process_id, 'consistency', 'consistency_sufficiency', 'sufficiency_assessment', NULL FROM levels
  UNION ALL SELECT process_id, 'consistency', 'consistency_inconsistency', criterion, NULL FROM found
  UNION ALL SELECT process_id, 'context_influence', 'context_association', key, NULL FROM linked
  UNION ALL SELECT process_id, 'missing_information', 'missing_evidence_information', expected_key, provider_id FROM gone
  UNION ALL SELECT process_id, 'missing_information', 'contextual_gap', subject, NULL FROM gaps
  UNION ALL SELECT process_id, 'limitation', 'insufficient_consistency', 'consistency_sufficiency', NULL FROM levels WHERE level <> 'sufficient'
  UNION ALL SELECT process_id, 'limitation', 'context_limitation', subject, NULL FROM gaps WHERE gap_type IN ('insufficient_context_data', 'quotation_requirement_difference')),
counters AS (SELECT process_id, provider_id, count(*) FILTER (WHERE section = 'evidence_used') AS evidence, count(*) FILTER (WHERE section = 'strength') AS strengths, count(*) FILTER (WHERE section = 'weakness') AS weaknesses, 2 * count(*) FILTER (WHERE section = 'risk') AS risks, count(*) FILTER (WHERE section = 'missing_information') AS missing FROM segments WHERE provider_id IS NOT NULL GROUP BY 1, 2),
scores AS (SELECT *, (evidence + strengths - weaknesses - risks - missing)::DOUBLE AS score FROM counters),
ranked AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt, sum(evidence) OVER (PARTITION BY process_id) AS te, sum(missing) OVER (PARTITION BY process_id) AS tm FROM scores WINDOW w AS (PARTITION BY process_id ORDER BY score DESC, provider_id)),
scenarios AS (SELECT process_id, provider_id AS first_provider, score, CASE WHEN te < 1 OR evidence < 1 OR tm > 0.6 * (te + tm) THEN 'insufficient_information' WHEN nxt IS NULL OR score - nxt >= 2 THEN 'clear_winner' WHEN score - nxt <= 1 THEN 'equivalent_alternatives' ELSE 'clear_winner' END AS scenario FROM ranked WHERE rank = 1)"""
)
BY = ["process_id"]


class Models(Stages):
    """Models of the processes, and what follows from their evidence."""

    @cached_property
    def evidence(self):
        text = lambda c: c.cast("string")
        entry = lambda *kv: F.create_map(*kv)
        specs = F.array_sort(F.collect_set("specification"))
        per = self.items.groupBy("process_id").agg(text(F.sum("price_cents")).alias("total"), F.min("currency").alias("currency"), F.min("priority").alias("priority"), text(F.count("*")).alias("n"), specs.alias("specifications"))
        column = lambda a, s: F.struct(F.lit(a).alias("attribute"), F.lit(s).alias("source"))
        models = per.select(
            "process_id",
            entry(F.lit("monto_total"), F.col("total"), F.lit("moneda"), F.col("currency")).alias("commercial"),
            entry(F.lit("items"), F.col("n")).alias("technical"),
            "specifications",
            entry(F.lit("limite_plazo"), F.col("priority"), F.lit("nota"), F.lit(" ")).alias("context"),
            entry(F.lit("origen"), F.lit("items")).alias("metadata"),
            entry(F.lit("catalogo"), F.concat(F.lit("CAT-"), F.col("process_id"))).alias("references"),
            F.array(column("group_type", ""), column("technical_size", "commercial"), column("plazo_entrega", "")).alias("columns"),
        )
        theirs = self.items.groupBy("process_id", "provider_id").agg(F.min("price_cents").alias("price"), F.max("size").alias("size"), F.max("unit").alias("unit"), F.slice(specs, 1, 2).alias("specifications"))
        providers = theirs.select(
            "process_id",
            "provider_id",
            F.row_number().over(an.Window.partitionBy("process_id").orderBy("provider_id")).alias("place"),
            entry(F.lit("precio"), text(F.col("price")), F.lit("peso"), text(F.col("price") % 3), F.lit("garantia"), F.when(F.col("provider_id").endswith("4"), "").otherwise("12 meses")).alias("commercial"),
            entry(F.lit("unidad"), F.col("unit"), F.lit("peso"), text(F.col("size") % 3)).alias("technical"),
            "specifications",
        )
        return self.kept(ev.collect(models, providers, BY), "evidence")

    @cached_property
    def gone(self):
        rows = self.items.select("process_id", "provider_id").distinct().withColumn("prepared", ~F.col("provider_id").endswith("7"))
        return self.kept(ev.missing(self.evidence, rows, BY), "missing")

    @cached_property
    def found(self):
        return self.kept(ev.inconsistencies(self.evidence, BY), "inconsistencies")

    @cached_property
    def levels(self):
        return ev.assessed(self.evidence, self.gone, self.found, BY)

    @cached_property
    def risk(self):
        return self.kept(ev.risks(self.gone, self.found, self.levels, BY), "risks")

    @cached_property
    def requirements(self):
        suffix = F.substring("process_id", -2, 2)
        none = F.expr("cast(map() as map<string, string>)")
        full = lambda *kv: F.when(suffix != "02", F.create_map(*kv)).otherwise(none)
        per = self.items.groupBy("process_id").agg(F.min("priority").alias("priority"))
        return per.select(
            "process_id",
            F.when(suffix.isin("01", "02"), "").otherwise(F.concat(F.lit("Compra de "), F.col("process_id"))).alias("description"),
            full(F.lit("precio_maximo"), F.lit("100"), F.lit("moneda"), F.lit("USD")).alias("commercial"),
            full(F.lit("peso"), F.lit("1")).alias("technical"),
            full(F.lit("marca"), F.lit("X"), F.lit("limite_plazo"), F.col("priority")).alias("inherited"),
        )

    @cached_property
    def elements(self):
        return self.kept(ev.elements(self.requirements, BY), "elements")

    @cached_property
    def matched(self):
        return self.kept(ev.matches(self.elements, self.evidence, BY), "matches")

    @cached_property
    def linked(self):
        return ev.associations(self.elements, self.matched, BY)

    @cached_property
    def gaps(self):
        return self.kept(ev.gaps(self.requirements, self.elements, self.linked, self.matched, self.evidence, self.risk, BY), "gaps")

    @cached_property
    def segments(self):
        return self.kept(ev.explanations(self.evidence, self.gone, self.found, self.levels, self.risk, self.linked, self.gaps, BY), "segments")

    @cached_property
    def scores(self):
        return an.provider_scores(ev.counters(self.segments, BY))

    @cached_property
    def scenarios(self):
        return an.scenario(self.scores)


@query(_EV + " SELECT process_id, provider_id, seq, source, key, value, category FROM evidence")
def evidence_collection(spark, d):
    return Models(spark, d).evidence


@query(_GONE + " SELECT process_id, n, expected_key, category, provider_id FROM gone")
def missing_evidence(spark, d):
    return Models(spark, d).gone.select("process_id", "n", "expected_key", "category", "provider_id")


@query(_FOUND + " SELECT process_id, provider_id, key, commercial_value, technical_value FROM incoherent")
def coherence_same_key(spark, d):
    return ev.coherence(Models(spark, d).evidence, BY)


@query(_FOUND + " SELECT process_id, key, present, providers FROM apart")
def provider_comparability(spark, d):
    return ev.comparability(Models(spark, d).evidence, BY)


@query(_FOUND + " SELECT process_id, provider_id, kind, criterion, subject FROM found")
def inconsistency_findings(spark, d):
    return Models(spark, d).found


@query(_LEVELS + " SELECT process_id, evidence, missing, inconsistencies, contradictory, level FROM levels")
def sufficiency(spark, d):
    return Models(spark, d).levels


@query(_LEVELS + " SELECT process_id, provider_id, risk_category, description FROM risk")
def risk_descriptions(spark, d):
    return Models(spark, d).risk


@query(_LINKED + " SELECT process_id, key, value, element_type FROM elements")
def requirement_elements(spark, d):
    return Models(spark, d).elements.select("process_id", "key", "value", "element_type")


@query(_LINKED + " SELECT process_id, key, element_type, association_type, evidence_count, first_seq, providers FROM linked")
def context_associations(spark, d):
    return Models(spark, d).linked.drop("n")


@query(_LINKED + " SELECT process_id, gap_type, subject FROM gaps")
def context_gaps(spark, d):
    return Models(spark, d).gaps


@query(_SEGMENTS + " SELECT process_id, section, template, subject, provider_id FROM segments")
def explanation_segments(spark, d):
    return Models(spark, d).segments


@query(_SEGMENTS + " SELECT process_id, section, count(*) AS n FROM segments GROUP BY 1, 2")
def section_counts(spark, d):
    return Models(spark, d).segments.groupBy("process_id", "section").agg(F.count("*").alias("n"))


@query(_SEGMENTS + " SELECT process_id, provider_id, evidence, strengths, weaknesses, risks, missing, score FROM scores")
def provider_summaries(spark, d):
    return Models(spark, d).scores


@query(_SEGMENTS + f""", own AS (SELECT process_id, 0 AS o, '{ev.COMPLETE_CONTEXT % "requirement_context"}' AS action FROM gaps WHERE gap_type = 'insufficient_context_data' UNION SELECT process_id, 1, '{ev.ASK_MORE}' FROM (SELECT process_id FROM gone UNION SELECT process_id FROM gaps)),
every AS (SELECT * FROM own UNION SELECT process_id, unnest([0, 1]), unnest({[*ev.DEFAULT_ACTIONS]}) FROM scenarios s WHERE scenario = 'insufficient_information' AND NOT EXISTS (SELECT 1 FROM own w WHERE w.process_id = s.process_id))
SELECT process_id, action, row_number() OVER (PARTITION BY process_id ORDER BY o, action) AS position FROM every""")
def recommendation_actions(spark, d):
    m = Models(spark, d)
    return ev.actions(m.scenarios, m.gone, m.gaps, BY)


@query(_SEGMENTS + " SELECT s.process_id, s.provider_id, s.score, 'Evidencias: ' || s.evidence || ', Riesgos: ' || s.risks AS difference FROM scores s JOIN scenarios t ON s.process_id = t.process_id AND t.scenario = 'equivalent_alternatives' WHERE t.score - s.score <= 1")
def equivalent_alternatives(spark, d):
    m = Models(spark, d)
    return ev.alternatives(m.scores, m.scenarios, BY)


_DISTINCT = "list_sort(list_distinct(list(subject) FILTER (WHERE section = '{}')))"


@query(_SEGMENTS + f", l AS (SELECT process_id, {_DISTINCT.format('strength')} AS strengths, {_DISTINCT.format('weakness')} AS weaknesses, {_DISTINCT.format('limitation')} AS limitations FROM segments GROUP BY 1), k AS (SELECT process_id, list_sort(list_distinct(list(description))) AS risks FROM risk GROUP BY 1) SELECT process_id, array_to_string(strengths, '|') AS strengths, array_to_string(weaknesses, '|') AS weaknesses, array_to_string(limitations, '|') AS limitations, array_to_string(risks, '|') AS risks FROM l LEFT JOIN k USING (process_id)")
def result_lists(spark, d):
    m = Models(spark, d)
    return ev.result_lists(m.segments, m.risk, BY).select("process_id", *(F.array_join(c, "|").alias(c) for c in ("strengths", "weaknesses", "limitations", "risks")))
