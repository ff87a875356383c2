"""Profiles of missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _nulls(columns: Sequence[str]) -> list:
    return [F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]


def missing_by_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``variable, na_count, na_percent`` for each column, from one pass."""
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *_nulls(columns))
    long = counted.unpivot(["_rows"], list(columns), "variable", "na_count")
    return long.select("variable", "na_count", (F.col("na_count") * 100.0 / F.col("_rows")).alias("na_percent"))


def missing_by_group(df: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(by).agg(*_nulls(columns)).unpivot([by], list(columns), "variable", "na_count")


def missing_per_row(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """How many rows miss 0, 1, 2 ... of the columns, overall or by group."""
    count = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(*by, count.alias("na_count")).groupBy(*by, "na_count").agg(F.count(F.lit(1)).alias("n"))


def missing_rate(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Share of nulls per column and the number of rows, by group."""
    return df.groupBy(*by).agg(
        *[F.avg(F.col(c).isNull().cast("int")).alias(f"{c}_missing_rate") for c in columns],
        F.count(F.lit(1)).alias("n"),
    )


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count per combination of null flags (1 = missing)."""
    flags = [F.col(c).isNull().cast("int").alias(c) for c in columns]
    return df.select(*flags).groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def missing_one_feature(base: DataFrame, feature: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """Rows, nulls and percentage missing of one feature over the matched base."""
    joined = base.select(*keys).join(feature.select(*keys, column), list(keys), "left")
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col(column).isNull(), 1)).alias("na_count")
    ).withColumn("na_percent", F.when(F.col("n_rows") > 0, F.col("na_count") * 100.0 / F.col("n_rows")).otherwise(0.0))
