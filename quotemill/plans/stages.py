"""The tables between the stages of an analysis, each built once for a query and kept in the shared folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill import store
from quotemill.operators import concepts as co
from quotemill.operators import tables as tb
from quotemill.session import ship
from quotemill.sources import quotations as src


class Stages:
    """Stage tables of the quotations in a folder; what several readers share is written once and read again."""

    def __init__(self, spark: SparkSession, d: str):
        ship(spark)  # the Python workers import the normaliser by name
        self.spark, self.d = spark, d
        self._at: dict[str, str] = {}

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        read, self._at[name] = store.materialize(df, name, "lz4")
        return read

    def drop(self, name: str) -> None:
        """Delete a kept table that nothing reads any more."""
        store.release(self.spark, self._at.pop(name))

    @cached_property
    def items(self) -> DataFrame:
        return self.kept(src.items(self.spark, self.d), "items")

    @cached_property
    def documents(self) -> DataFrame:
        return src.documents(self.items)

    @cached_property
    def concepts(self) -> DataFrame:
        return co.detect(self.items, self.documents)

    @cached_property
    def normalized(self) -> DataFrame:
        return co.normalized(self.concepts)

    @cached_property
    def item_concepts(self) -> DataFrame:
        """Normalised items: the concepts that pairs and groups are made of; their origin is the order."""
        kind = F.when(F.col("counted"), co.TYPES["partida"]).otherwise(co.TYPES["item"]).alias("concept_type")
        found = src.item_values(self.spark, self.d).select("process_id", "document_id", "provider_id", "pos", kind, "normalized_value", F.expr("pos div 100000000").alias("origin"))
        return self.kept(found, "item-concepts")

    @cached_property
    def groups(self) -> DataFrame:
        return self.kept(co.comparable_groups(self.item_concepts), "groups")

    @cached_property
    def members(self) -> DataFrame:
        by = ["process_id", "normalized_value", "concept_type"]
        return self.item_concepts.join(self.groups.select(*by, "group_id"), by)

    @cached_property
    def columns(self) -> DataFrame:
        fixed = F.array(*(F.struct(F.lit(o).alias("source_ord"), F.lit(n).alias("name")) for o, n in ((1, "group_type"), (1, "members_count"), (2, "concept_type"), (4, "GROUP_TYPE"))))
        common = self.groups.select("process_id", "group_id", F.explode(fixed).alias("x")).select("process_id", "group_id", "x.*")
        specs = self.members.join(self.items.select("pos", "specification"), "pos").select("process_id", "group_id", F.lit(3).alias("source_ord"), F.col("specification").alias("name")).distinct()
        primary = self.groups.join(self.items.select(F.col("pos").alias("first_member"), "description"), "first_member").select("process_id", "group_id", F.lit(5).alias("source_ord"), F.col("description").alias("name"))
        return tb.dynamic_columns(common.unionByName(specs).unionByName(primary))

    @cached_property
    def rows(self) -> DataFrame:
        return tb.dynamic_rows(self.groups, self.items.select("process_id", "provider_id").distinct())

    def register(self, prefix: str = "stage_") -> list[str]:
        """Temporary views of the stage tables, for SQL."""
        names = ["items", "documents", "concepts", "normalized", "groups", "members", "columns", "rows"]
        for n in names:
            getattr(self, n).createOrReplaceTempView(prefix + n)
        return [prefix + n for n in names]
