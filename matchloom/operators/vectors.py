"""Sums of small vectors computed inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sum_vectors(parts: DataFrame, key: str = "imp", vector: str = "vec") -> dict[int, np.ndarray]:
    """Add up the task vectors per key.

    ``parts`` has one row per task and key. They are added element-wise on the
    cluster, so what comes to the driver is one vector per key.
    """
    cells = (
        parts.select(key, F.posexplode(vector).alias("at", "x"))
        .groupBy(key, "at")
        .agg(F.sum("x").alias("x"))
        .groupBy(key)
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("x"))
    )
    return {row[key]: np.array(row["x"]) for row in cells.collect()}
