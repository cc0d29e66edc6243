"""Comparison tables: columns, rows, cells, matrices, providers and their integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.operators.places import numbered_id, place


def dynamic_columns(attributes: DataFrame) -> DataFrame:
    """Columns of each table from attributes (process_id, group_id, source_ord, name): first of a name by source, case aside."""
    first = Window.partitionBy("process_id", "group_id", F.lower("name")).orderBy("source_ord", "name")
    kept = attributes.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    at = Window.partitionBy("process_id", "group_id").orderBy("source_ord", "name")
    return place(kept.withColumn("logical_position", F.row_number().over(at)), ["process_id"], ["group_id", "source_ord", "name"], "_place").withColumn("column_id", numbered_id("DCC", "_place")).drop("_place")


def dynamic_rows(groups: DataFrame, providers: DataFrame) -> DataFrame:
    """A row for each table and provider of its process."""
    every = groups.select("process_id", "group_id").join(providers, "process_id")
    return place(every, ["process_id"], ["group_id", "provider_id"], "_place").withColumn("row_id", numbered_id("DCR", "_place")).drop("_place")


def organized_providers(rows: DataFrame) -> DataFrame:
    """Rows by provider and row id; of names equal but for case and blanks the first stays, positions count all."""
    at = Window.partitionBy("process_id", "group_id").orderBy("provider_id", "row_id")
    same = Window.partitionBy("process_id", "group_id", F.lower(F.trim("provider_id"))).orderBy("provider_id", "row_id")
    return rows.withColumn("logical_position", F.row_number().over(at)).withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")


def source_map(documents: DataFrame) -> DataFrame:
    """Documents of each provider; a provider with several is ambiguous. Null providers go by their document."""
    named = documents.select("process_id", F.coalesce("provider_id", "document_id").alias("provider_id"), "document_id").distinct()
    return named.groupBy("process_id", "provider_id").agg(F.count("*").alias("document_count"), F.min("document_id").alias("first_document")).withColumn("duplicate_document_source", F.col("document_count") > 1)


def fill_cells(rows: DataFrame, by_document: DataFrame, by_provider: DataFrame) -> DataFrame:
    """Value of each row by its document, else by its provider if that has just one document; where it has several, the cell is ambiguous."""
    direct = rows.join(by_document.select("process_id", "group_id", F.col("document_id"), F.col("value").alias("_direct")), ["process_id", "group_id", "document_id"], "left")
    known = by_provider.select("process_id", "provider_id", "document_count", F.col("value").alias("_value"))
    several = F.coalesce(F.col("document_count") > 1, F.lit(False))
    value = F.coalesce("_direct", F.when(~several, F.col("_value")))
    return direct.join(known, ["process_id", "provider_id"], "left").select("process_id", "group_id", "provider_id", "document_id", value.alias("value"), (F.col("_direct").isNull() & several).alias("ambiguous"))


def matrix(cells: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """The matrix of ``cells`` (keys, name, value) with a column for each of the given names."""
    return cells.groupBy(*keys).pivot("name", names).agg(F.max("value"))


def duplicates(rows: DataFrame, keys: list[str], order: list[str], finding: str) -> DataFrame:
    """All but the first row of each key, as findings."""
    again = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n > 1")
    return again.drop("_n").withColumn("finding", F.lit(finding))


def dangling(refs: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    return refs.join(targets.select(*on).distinct(), on, "left_anti")


def orphans(columns: DataFrame, referenced: DataFrame, on: list[str]) -> DataFrame:
    return columns.select(*on).exceptAll(columns.select(*on).join(referenced.select(*on).distinct(), on, "left_semi"))


def catalog_coverage(catalogs: dict[str, DataFrame], on: list[str]) -> DataFrame:
    """Keys present in any catalog and, for each, which catalogs lack them."""
    marks = None
    for name, df in catalogs.items():
        one = df.select(*on).distinct().withColumn(name, F.lit(1))
        marks = one if marks is None else marks.join(one, on, "full_outer")
    return marks.select(*on, *(F.col(n).isNull().alias(f"missing_{n}") for n in catalogs))


def severity(counts: list[Column]) -> Column:
    """Whether any of the error counts of a model is above zero."""
    bad = F.lit(False)
    for c in counts:
        bad = bad | (F.coalesce(c, F.lit(0)) > 0)
    return F.when(bad, "invalid").otherwise("valid")
