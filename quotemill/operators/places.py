"""Places of rows in an order, and caps that follow from them, without sorting a lane in one task."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill import store


def place(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """``rows`` with the place (from 1) of each in its lane ``by``, by ``order``; one lane may hold most rows.

    Rows are range-sorted by lane and order over all tasks and written once with their place in the
    task; a lane's places in a task start after the counts of the tasks before, of which there is
    one row for each lane and task.
    """
    keys = [*by, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    kept, _ = store.materialize(ranged, "places", "lz4")
    kept = kept.withColumn("_task", F.shiftright("_id", 33))
    counts = kept.groupBy(*by, "_task").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    lanes = [F.col(c).alias(f"_lane{i}") for i, c in enumerate(by)]
    starts = counts.select(*lanes, F.col("_task").alias("_of"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    on = F.col("_task") == F.col("_of")
    for i, c in enumerate(by):
        on &= F.col(c).eqNullSafe(F.col(f"_lane{i}"))
    return kept.join(starts, on).select(*rows.columns, (F.col("_id") + F.col("_shift")).alias(name))


def _sums(keys: list[str], amounts: list[str]):
    """Adds, for each amount, its sum over the rows before in the task, and whether the row before or after has the same keys."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        total, held, like_held = dict.fromkeys(amounts, 0), None, False

        def summed(rows, twins):
            columns = [*rows.columns, pa.array(twins)]
            for n in amounts:
                x = rows.column(n).to_numpy(zero_copy_only=False)
                up = np.cumsum(x, dtype=np.int64) + total[n]
                total[n] = int(up[-1])
                columns.append(pa.array(up - x, pa.int64()))
            return pa.RecordBatch.from_arrays(columns, [*rows.schema.names, "_twin", *(f"{n}_before" for n in amounts)])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            n = rows.num_rows - 1
            alike = np.ones(n, bool)  # of each row and the next
            for k in keys:
                x = rows.column(k)
                alike &= pc.equal(x.slice(0, n), x.slice(1)).to_numpy(zero_copy_only=False)
            if n:
                yield summed(rows.slice(0, n), alike | np.r_[like_held, alike[:-1]])
                like_held = bool(alike[-1])
            held = rows.slice(n)  # the last row waits for the next batch
        if held is not None:
            yield summed(held, np.array([like_held]))

    return run


def running(rows: DataFrame, by: list[str], order: list[str], amounts: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the sum of each amount over the rows before in its lane (``<amount>_before``) and whether others have
    the same lane and order (``_twin``); and the sum of each amount for each lane. Lanes and orders are never null.

    As in ``place``, a lane is sorted over all tasks and written once; its sums in a task start after those of the tasks before.
    """
    keys = [*by, *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_task", F.spark_partition_id())
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema), "_twin boolean", *(f"`{n}_before` bigint" for n in amounts)])
    kept, _ = store.materialize(ranged.mapInArrow(_sums(keys, amounts), schema), "sums")
    first = [F.min(f"{n}_before").alias(f"_first_{n}") for n in amounts]
    counts, _ = store.materialize(kept.groupBy(*by, "_task").agg(*(F.sum(n).alias(n) for n in amounts), *first), "task-sums", "lz4")
    before = Window.partitionBy(*by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_task", *((F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(f"_first_{n}")).alias(f"_shift_{n}") for n in amounts))
    shifted = [(F.col(f"{n}_before") + F.col(f"_shift_{n}")).alias(f"{n}_before") for n in amounts]
    return kept.join(starts, [*by, "_task"]).select(*rows.columns, "_twin", *shifted), counts.groupBy(*by).agg(*(F.sum(n).alias(n) for n in amounts))


def numbered_id(prefix: str, position: str | Column) -> Column:
    return F.format_string(f"{prefix}-%06d", position)


def capped(rows: DataFrame, by: list[str], order: list[str], cap: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows of each lane, and a warning for each lane that has more."""
    placed = place(rows, by, order, "_place")
    over = placed.groupBy(*by).agg(F.count("*").alias("found")).where(F.col("found") > cap)
    warnings = over.select(*by, "found", F.lit(cap).cast("long").alias("cap"), F.lit("warning").alias("severity"))
    return placed.where(F.col("_place") <= cap).drop("_place"), warnings
