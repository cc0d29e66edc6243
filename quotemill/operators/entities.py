"""Extraction of documents and the entities of the internal model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators.documents import SECTIONS, TABLE_HEADER

#: The entities of the internal model and the beginnings of their ids.
ENTITIES = {"document": "doc", "provider": "provider", "commercial_information": "commercial", "technical_information": "technical", "items": "item", "commercial_conditions": "condition", "observations": "observation", "metadata": "metadata", "requirement_context": "requirement", "original_references": "original-ref"}
SCHEMA_VERSION = "1.0"
_ENTITY = ["document_id", "entity", "entity_id", "name", "value"]


def adapter_metadata(docs: DataFrame) -> DataFrame:
    """What an adapter is told of a document: its fields under the names that later stages look for."""
    names = {"text_content": "text", "provider_name": "provider_name", "provider_id": "document_id", "commercial_currency": "currency", "commercial_total_amount": "total_amount", "commercial_payment_terms": "payment_terms", "format_type": "format", "file_name": "file_name", "document_label": "document_label"}
    return docs.select("document_id", *(F.col(c).alias(n) for n, c in names.items()), F.lit("evidence_center").alias("source"))


def summaries(docs: DataFrame) -> DataFrame:
    """Documents in short: lengths and counts in the place of text, items and tables."""
    return docs.select("document_id", "provider_name", "currency", "total_amount", "payment_terms", F.length(F.coalesce("text", F.lit(""))).alias("text_length"), F.coalesce(F.size("items"), F.lit(0)).alias("items_count"), F.coalesce(F.size("tables"), F.lit(0)).alias("tables_count"))


def items_table(items: DataFrame, by: list[str], order: str, table_id: str = "table-items-1") -> DataFrame:
    """A table of each document's items: a header, then a row of four cells an item, in order."""
    cells = F.array(*(F.coalesce(F.col(c), F.lit("")) for c in ("description", "quantity", "unit_price", "unit")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cells.alias("c")))), lambda x: x["c"])
    head = F.array(F.array(F.lit(TABLE_HEADER[0]), F.lit(TABLE_HEADER[1]), F.lit("Precio unitario"), F.lit(TABLE_HEADER[3])))
    return items.groupBy(*by).agg(F.concat(head, rows).alias("rows")).withColumn("table_id", F.lit(table_id))


def extracted(docs: DataFrame, key: str, found: dict[str, Column]) -> DataFrame:
    """What all extractors find in a document together: texts joined, tables and elements of all, and a note for each that found nothing.

    ``found``: by section, an array of strings, null or empty where there is nothing.
    """
    none = F.array().cast("array<string>")
    of = {s: F.coalesce(found[s], none) if s in found else none for s in SECTIONS}
    notes = F.array_compact(F.array(*(F.when(F.size(of[s]) == 0, F.lit(f"{s}_extractor: prepared")) for s in SECTIONS)))
    marked = lambda s: F.transform(of[s], lambda x: F.concat(F.lit(f"{s}:"), x))
    elements = F.flatten(F.array(*map(marked, ("headers", "footers", "lists", "images", "structural"))))
    return docs.select(key, F.array_join(of["text"], "\n").alias("extracted_text"), of["tables"].alias("tables"), elements.alias("elements"), of["metadata"].alias("metadata"), notes.alias("observations"), F.lit(len(SECTIONS)).alias("extractors_executed"))


def entities(docs: DataFrame) -> DataFrame:
    """(document_id, entity, entity_id, name, value) of the ten entities of each document.

    ``docs``: document_id, model_id, process_id, provider_id, provider_name, commercial and technical (maps), specifications,
    items, conditions and observations (arrays of id and content), metadata and requirement (maps), format, adapter.
    """
    none = F.expr("cast(map() as map<string, string>)")
    text = lambda **kv: F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))))
    c = F.col
    one = {
        "document": (c("document_id"), text(model_id=c("model_id"), schema_version=F.lit(SCHEMA_VERSION))),
        "provider": (c("provider_id"), text(name=c("provider_name"))),
        "commercial_information": (c("document_id"), F.coalesce("commercial", none)),
        "technical_information": (c("document_id"), F.coalesce("technical", none)),
        "metadata": (c("document_id"), F.coalesce("metadata", none)),
        "requirement_context": (c("document_id"), F.coalesce("requirement", none)),
        "original_references": (c("document_id"), text(adapter_name=c("adapter"), format_type=c("format"))),
    }
    shape = lambda entity, key, name, value: F.struct(F.lit(entity).alias("entity"), F.concat(F.lit(ENTITIES[entity] + "-"), key.cast("string")).alias("entity_id"), name.cast("string").alias("name"), value.cast("string").alias("value"))
    of_map = lambda n, k, m: F.transform(F.map_entries(m), lambda e: shape(n, k, e["key"], e["value"]))
    of_list = lambda n, src: F.transform(F.coalesce(c(src), F.array().cast("array<struct<id:string,content:string>>")), lambda x: shape(n, x["id"], F.lit("content"), x["content"]))
    parts = [of_map(n, k, m) for n, (k, m) in one.items()]
    parts += [of_list(n, src) for n, src in (("items", "items"), ("commercial_conditions", "conditions"), ("observations", "observations"))]
    parts.append(F.transform(F.coalesce(c("specifications"), F.array().cast("array<string>")), lambda x: shape("technical_information", c("document_id"), F.lit("specification"), x)))
    return docs.select("document_id", F.explode(reduce(lambda a, b: F.concat(a, b), parts)).alias("x")).select("document_id", "x.*").where(tx.nonblank(F.col("value"))).select(*_ENTITY)
