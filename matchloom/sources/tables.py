"""Reading, saving and exporting tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, once, at the boundary of the library."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) != len(lowered):
        raise ValueError(f"columns differ by case only: {df.columns}")
    return df.toDF(*lowered)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A metastore table by name, or Parquet by path (anything with a slash)."""
    source = spark.read.parquet(name) if "/" in name else spark.table(name)
    return normalise_names(source)


def _writer(df: DataFrame, name: str, location: str | None, partition_by: Sequence[str] = ()):
    writer = df.write.mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.option("path", f"{location}/{name}") if location else writer


def save_table(
    df: DataFrame,
    name: str,
    save_previous: bool = True,
    partition_by: Sequence[str] = (),
    location: str | None = None,
) -> str | None:
    """Overwrite a table, schema included, keeping the version it replaces.

    The old version is copied to ``<name>_pre<timestamp>``, numbered if that
    second has one; the name is returned, or None when there was nothing to keep. ``location`` puts the
    files into a folder outside the warehouse.
    """
    spark, name = df.sparkSession, name.lower()
    kept = None
    if save_previous and spark.catalog.tableExists(name):
        kept = stamp = f"{name}_pre{datetime.now():%Y%m%d_%H%M%S}"
        nth = 1
        while spark.catalog.tableExists(kept):
            nth, kept = nth + 1, f"{stamp}_{nth + 1}"
        _writer(spark.table(name), kept, location).saveAsTable(kept)
    _writer(df, name, location, partition_by).saveAsTable(name)
    return kept


def checkpoint_table(df: DataFrame, name: str, location: str | None = None) -> DataFrame:
    """Write a table and return it re-read, so later steps start from storage."""
    spark, name = df.sparkSession, name.lower()
    _writer(df, name, location).saveAsTable(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def export_csv(df: DataFrame, path: str) -> None:
    """Write CSV files with a header. A report of a few rows fits one file; size decides."""
    df.write.mode("overwrite").option("header", True).csv(path)
