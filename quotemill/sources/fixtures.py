"""Small tables of cases, as DataFrames and as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def cases(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """The rows as a table; ``columns`` is a schema."""
    return spark.createDataFrame(rows, columns)


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if isinstance(v, float):
        return f"{v}::DOUBLE"
    return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values(names: list[str], rows: list[tuple]) -> str:
    """The rows as a SQL query."""
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + f") AS t({', '.join(names)})"
