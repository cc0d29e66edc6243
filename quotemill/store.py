"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from quotemill.session import checkpoint_folder

#: Shuffle files of a finished query go at once instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a local session without one gets a folder of its own."""
    return checkpoint_folder(spark).rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    at = f"{shared_folder(spark)}/quotemill/{name}-{uuid.uuid4().hex}"
    _written[at] = spark
    return at


def write(df: DataFrame, path: str, codec: str = "zstd") -> None:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).mode("overwrite").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back; a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    write(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.pop(path, None)


@contextlib.contextmanager
def scratch(keep: list[str]) -> Iterator[None]:
    """Deletes, at its end, the intermediate tables written inside but those named in ``keep``."""
    before = set(_written)
    yield
    for path in set(_written) - before - set(keep):
        release(_written[path], path)


@atexit.register
def _sweep() -> None:
    for path, spark in list(_written.items()):
        with contextlib.suppress(Exception):
            if spark._sc._jsc is not None:
                release(spark, path)
