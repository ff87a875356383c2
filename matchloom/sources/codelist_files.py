"""Code lists in CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matchloom.sources.tables import normalise_names

BOM = "\ufeff"


def read_codelist_csv(spark: SparkSession, path: str) -> DataFrame:
    """Code list with a header line, every column text.

    Long identifiers stay text all the way; a byte-order mark in front of the
    first column name is removed.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False)
    names = [c.replace(BOM, "").strip() for c in raw.columns]
    return normalise_names(raw.toDF(*names))
