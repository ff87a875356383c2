"""First rows per key, and running totals that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import cut_lineage


def first_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows per key in the given order.

    Spark limits every group before the shuffle (window group limit), so a hot
    key sends at most ``n`` rows per task. Give tie keys for a stable result.
    """
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= n)
    return out if rank else out.drop(name)


def running_total(
    df: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    weight: Column | None = None,
    out: str = "running",
    splits: int | None = None,
) -> DataFrame:
    """Running sum of ``weight`` (default 1) per group in ascending order.

    With the default weight this is ``row_number``. The order columns should
    identify a row; group columns must not be null.

    A plain window would put a whole group in one task, and a global one
    everything. Here rows are range partitioned by (group, order), so a group
    gets slices in proportion to its size, ties included. Each slice is summed
    alone and shifted by the totals of the slices before it in its group. The
    sliced rows are written out with their slice, as they are read twice.
    ``splits`` sets the number of slices; by default Spark does.
    """
    group, order = list(group), list(order)
    keys = [*group, *order]
    weighted = df.withColumn("_weight", F.lit(1) if weight is None else weight)
    ranged = weighted.repartitionByRange(splits, *keys) if splits else weighted.repartitionByRange(*keys)
    sliced = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (
        Window.partitionBy(*(group or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = (
        sliced.groupBy(*group, "_slice")
        .agg(F.sum("_weight").alias("_total"))
        .withColumn("_shift", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    return (
        sliced.withColumn("_local", F.sum("_weight").over(within))
        .join(shifts, [*group, "_slice"])
        .withColumn(out, F.col("_local") + F.col("_shift"))
        .drop("_slice", "_weight", "_local", "_shift")
    )


def dense_index(df: DataFrame, key: str, out: str = "set", start: int = 1) -> DataFrame:
    """Distinct values of ``key`` numbered in ascending order, without gaps."""
    values = df.select(key).where(F.col(key).isNotNull()).distinct()
    return running_total(values, [key], out=out).withColumn(out, F.col(out) + (start - 1))
