"""What the operators of this subpackage share: keys, splits and joins of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import ship
from quotemill.store import materialize, new_path, release, scratch, shared_folder, write  # noqa: F401  the operators write by these

#: White space that separates words: the code points 20 and 09 to 0D (hexadecimal).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Keys that hold over one in so many of all rows, of which there are so many at most, are joined by broadcast.
SHARES = 20_000


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold -1, which never holds out."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds, F.lit(-1))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def join_crowded(rows: DataFrame, keyed: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``keyed``, which has every key of theirs once and in ``_rows`` how many rows have it.

    A key of many rows would put them all in one task, so crowded keys are joined by broadcast.
    """
    least = F.lit((keyed.agg(F.sum("_rows").alias("n")).first().n or 0) // SHARES)
    hot = keyed.where(F.col("_rows") > least).drop("_rows")
    cold = keyed.where(F.col("_rows") <= least).drop("_rows")
    keys = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(keys, key, "left_anti").join(cold, key))
