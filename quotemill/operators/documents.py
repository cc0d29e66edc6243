"""Documents: evidence, decoding, tables of texts, sections, canonical items and the stores of entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.functions import text as tx

#: Header of a table that has none, pages with fewer characters that need OCR, and the adapters of the formats.
TABLE_HEADER = ("Descripción", "Cantidad", "Precio", "Unidad")
OCR_TEXT = 20
ADAPTERS = ("pdf", "word", "excel", "image")
SECTIONS = ("text", "tables", "headers", "footers", "lists", "images", "structural", "metadata")
CONDITION_TYPES = ("condition", "footer", "terms")
INDEX_KEYS = ("document_id", "model_id", "provider_name", "provider_id", "requirement", "project", "format", "adapter")
_LITERAL = r"\((?:\\.|[^\\()])*\)"
_ESCAPES = ((r"\n", "\n"), (r"\r", "\r"), (r"\t", "\t"), (r"\b", " "), (r"\f", " "), (r"\(", "("), (r"\)", ")"), ("\\\\", "\\"))


def resolve_evidence(docs: DataFrame) -> DataFrame:
    """Text and status of evidence documents (pos, document_id, document_label, content_type, file_name, content_data_url).

    Blank ids go by the place in the request; a bad base64 body is a ``decode_error``; a blank text
    falls back to label and file name.
    """
    blank = lambda c: ~tx.nonblank(c)
    url = F.coalesce(F.col("content_data_url"), F.lit(""))
    raw = tx.decode_data_url(url)
    text = F.when(url == "", "").otherwise(F.coalesce(tx.clean_text(tx.decode_text(raw)), F.lit("")))
    status = F.when(url == "", "empty").when(raw.isNull(), "decode_error").otherwise("decoded")
    named = F.when(blank(F.col("document_id")), F.format_string("doc-%d", F.col("pos") + 1)).otherwise(F.col("document_id"))
    fallback = tx.strip(F.concat_ws("\n", "document_label", "file_name"))
    return docs.select("pos", named.alias("document_id"), tx.sniff_format(F.col("content_type"), F.col("file_name")).alias("format"), status.alias("status"), F.when(blank(text), fallback).otherwise(text).alias("text"))


def first_references(sources: list[Column]) -> Column:
    """The first array of references that isn't empty; the last one as it is."""
    out = sources[-1]
    for s in reversed(sources[:-1]):
        out = F.when(F.size(F.coalesce(s, F.array().cast("array<string>"))) > 0, s).otherwise(out)
    return out


def pdf_literals(content: Column) -> Column:
    """Text of a PDF's literal strings: all before Tj, then those in TJ arrays; printable runs where there are none."""
    raw = F.decode(content, "ISO-8859-1")
    literal = F.lit(_LITERAL)
    single = F.regexp_extract_all(raw, F.lit(f"({_LITERAL})\\s*Tj"), F.lit(1))
    arrays = F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(r"(?s)\[(.*?)\]\s*TJ"), F.lit(1)), lambda x: F.regexp_extract_all(x, literal, F.lit(0))))

    def plain(x: Column) -> Column:
        out = F.substr(x, F.lit(2), F.length(x) - 2)
        for a, b in _ESCAPES:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    found = F.transform(F.concat(single, arrays), plain)
    runs = F.regexp_extract_all(raw, F.lit("[\\x20-\\x7E\\xC0-\\xFF]{4,}"), F.lit(0))
    return tx.clean_text(F.array_join(F.when(F.size(found) > 0, found).otherwise(runs), "\n"))


def needs_ocr(text_length: Column, images: Column) -> Column:
    return (images > 0) & (text_length < OCR_TEXT)


def text_rows(text: Column) -> Column:
    """Rows of cells in a text: lines with bars and two cells or more, lines of three parts or more with a digit (four parts of them)."""
    bars = lambda line: F.filter(F.transform(F.split(line, "\\|", -1), tx.strip), lambda x: x != "")
    parts = lambda line: F.split(tx.strip(line), r"\s{2,}", -1)
    none = F.array().cast("array<string>")

    def cells(line: Column) -> Column:
        b, p = bars(line), parts(line)
        loose = F.when((F.size(p) >= 3) & line.rlike("[0-9]"), F.slice(p, 1, 4)).otherwise(none)
        return F.when(F.contains(line, F.lit("|")), F.when(F.size(b) >= 2, b).otherwise(none)).otherwise(loose)

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\R", -1), cells), lambda r: F.size(r) > 0)


def headed(rows: Column) -> Column:
    """Whether the first of the rows is a header."""
    return (F.size(rows) > 0) & tx.looks_like_header(F.array_join(F.get(rows, F.lit(0)), " "))


def with_header(rows: Column) -> Column:
    head = F.array(F.array(*map(F.lit, TABLE_HEADER)))
    return F.when((F.size(rows) == 0) | headed(rows), rows).otherwise(F.concat(head, rows))


def table_items(docs: DataFrame, rows: str, table_id: str = "table-text-1") -> DataFrame:
    """Items of the rows of a table, by position: description, quantity, unit_price, unit; a header row is none."""
    body = F.when(headed(F.col(rows)), F.slice(F.col(rows), F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(F.col(rows))
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    kept = [c for c in docs.columns if c != rows]
    spread = docs.select(*kept, F.posexplode(body).alias("_n", "cells"))
    return spread.select(*kept, F.format_string(f"{table_id}-row-%d", "_n").alias("item_id"), cell(0).alias("description"), cell(1).alias("quantity"), cell(2).alias("unit_price"), cell(3).alias("unit"))


def canonical_items(from_tables: DataFrame, from_metadata: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """Items of tables and of metadata together; ``strict`` keeps an item that both have twice, else one stays."""
    both = from_tables.unionByName(from_metadata)
    return both if strict else both.dropDuplicates(keys)


def conditions(elements: DataFrame, metadata: DataFrame) -> DataFrame:
    """Conditions (document_id, content): structural elements of a condition's type, and those of the metadata."""
    return elements.where(F.col("element_type").isin(*CONDITION_TYPES)).select("document_id", "content").unionByName(metadata.select("document_id", "content"))


def observations(incidents: DataFrame, notes: DataFrame, metadata: DataFrame) -> DataFrame:
    parts = [d.select("document_id", "content", F.lit(kind).alias("observation_type")) for kind, d in (("incident", incidents), ("technical_observation", notes), ("metadata", metadata))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prefixed(metadata: Column, prefix: str, fallback: dict[str, Column] | None = None) -> Column:
    """Fields of the metadata whose name begins with the prefix; the fallback where there are none."""
    found = F.map_filter(metadata, lambda k, _: k.startswith(prefix))
    if fallback is None:
        return found
    other = F.create_map(*(x for k, v in fallback.items() for x in (F.lit(k), F.coalesce(v, F.lit("")))))
    return F.when(F.size(found) > 0, found).otherwise(other)


def sections(docs: DataFrame, key: str, present: dict[str, Column]) -> DataFrame:
    """A row for each document and extractor: what it found, else the note that it is prepared."""
    made = F.array(*(F.struct(F.lit(s).alias("section"), F.coalesce(present.get(s, F.lit(0)), F.lit(0)).cast("long").alias("found")) for s in SECTIONS))
    return docs.select(key, F.explode(made).alias("x")).select(key, "x.section", "x.found", F.when(F.col("x.found") > 0, "extracted").otherwise("prepared").alias("note"))


def adapter(fmt: Column, enabled: tuple[str, ...] = ADAPTERS) -> Column:
    """Whether a format is resolved, unknown or disabled."""
    return F.when(~F.coalesce(fmt, F.lit("")).isin(*ADAPTERS), "unregistered").when(fmt.isin(*enabled), "resolved").otherwise("disabled")


def quality_level(n_incidents: Column, n_warnings: Column) -> Column:
    return F.when(n_incidents > 0, "low").when(n_warnings > 0, "acceptable").otherwise("high")


def index_entries(docs: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """Query keys of each entry of the knowledge index; blank ones are left out."""
    made = F.array(*(F.struct(F.lit(k).alias("query_key"), values[k].cast("string").alias("query_value")) for k in INDEX_KEYS if k in values))
    return docs.select(key, F.explode(made).alias("x")).select(key, "x.*").where(tx.nonblank(F.col("query_value")))


def insert_unique(stored: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``new`` with whether the store takes it: its key is neither stored nor that of an earlier new row."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    known = stored.select(F.col(key).alias("_known")).distinct()
    return new.join(known, F.col(key) == F.col("_known"), "left").withColumn("accepted", first & F.col("_known").isNull()).drop("_known")


def last_write(results: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The registry of results: of each key the last row written."""
    whole = F.struct(*results.columns)
    return results.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(*order)).alias("x")).select("x.*")


def integrate_context(models: DataFrame, requirements: DataFrame) -> DataFrame:
    """Requirement texts beside the models of the same process and document."""
    return models.join(requirements, ["process_id", "document_id"])
