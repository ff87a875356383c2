"""Versioned archives: many batches in one table, one of them pinned per run."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.joins import validated_merge

BATCH = "archived_on"


class SnapshotError(ValueError):
    """A pinned batch is missing, ambiguous or has another number of rows."""


def batches(archive: DataFrame, batch: str = BATCH) -> DataFrame:
    """Rows per batch; reads the batch column only."""
    return archive.groupBy(batch).agg(F.count(F.lit(1)).alias("n"))


def _extreme(archive: DataFrame, pick: Column, batch: str) -> DataFrame:
    """One batch and its row count: the batch column first, then only that batch is counted."""
    chosen = archive.agg(pick).scalar()
    return batches(archive.where(F.col(batch) == chosen), batch)


def latest_snapshot(archive: DataFrame, as_of, batch: str = BATCH) -> DataFrame:
    """Newest batch not after ``as_of``, with its row count."""
    return _extreme(archive.where(F.col(batch) <= F.lit(as_of)), F.max(batch), batch)


def first_snapshot_after(archive: DataFrame, start, batch: str = BATCH) -> DataFrame:
    """Earliest batch not before ``start``, with its row count."""
    return _extreme(archive.where(F.col(batch) >= F.lit(start)), F.min(batch), batch)


def snapshot_registry(registry: DataFrame, archives: Mapping[str, DataFrame], as_of, batch: str = BATCH) -> DataFrame:
    """Registry rows with the pinned batch and its count; every data set must have one."""
    pinned = None
    for name, archive in archives.items():
        row = latest_snapshot(archive, as_of, batch).withColumn("dataset", F.lit(name))
        pinned = row if pinned is None else pinned.unionByName(row)
    return validated_merge(registry, pinned, ["dataset"], validate="1:1", assert_results=["both"])


def read_snapshot(registry: DataFrame, archive: DataFrame, dataset: str, batch: str = BATCH) -> DataFrame:
    """The pinned batch of a data set, after checking that it is whole.

    The batch column is a partition column in a large archive, so the filter
    prunes files and the count reads their footers.
    """
    rows = registry.where(F.col("dataset") == dataset).select(batch, "n").take(2)
    if len(rows) != 1:
        raise SnapshotError(f"data set {dataset!r} has {'no' if not rows else 'more than one'} registry row")
    chosen = archive.where(F.col(batch) == F.lit(rows[0][batch]))
    found = chosen.count()
    if found == 0 or found != rows[0]["n"]:
        raise SnapshotError(f"{dataset!r} holds {found} rows in batch {rows[0][batch]}, registered {rows[0]['n']}")
    return chosen
