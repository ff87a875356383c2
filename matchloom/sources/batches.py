"""Resumable batches: work that is already stored is not done again."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def stored_items(spark: SparkSession, path: str) -> set[str]:
    """Item folders that were written to the end (they carry a success mark)."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return set()
    done = set()
    for status in files.listStatus(folder):
        item = status.getPath()
        if files.exists(jvm.org.apache.hadoop.fs.Path(item, "_SUCCESS")):
            done.add(item.getName().split("=", 1)[-1])
    return done


def run_missing(
    spark: SparkSession, path: str, items: Iterable[int], work: Callable[[int], DataFrame], column: str = "imp"
) -> list[int]:
    """Write ``work(item)`` to ``<path>/<column>=<item>`` for items not stored yet.

    Returns the items computed now. An item whose write was cut short has no
    success mark and is done again.
    """
    done = stored_items(spark, path)
    computed = []
    for item in items:
        if str(item) not in done:
            work(item).write.mode("overwrite").parquet(f"{path}/{column}={item}")
            computed.append(item)
    return computed


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All stored items, the item number back as a column."""
    return spark.read.parquet(path)
