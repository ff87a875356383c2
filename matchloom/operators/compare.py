"""Comparing two versions of a table, and stacking result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.joins import MergeError
from matchloom.operators.profile import duplicate_keys


def compare_versions(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose rows differ: ``keys, status, changed``.

    ``status`` is ``only_old``, ``only_new`` or ``differs``; ``changed`` lists
    the differing columns, comma separated. Columns in one version only are
    not compared. A key that repeats in a version raises ``MergeError``.
    """
    keys = list(keys)
    for name, df in (("old", old), ("new", new)):
        if not duplicate_keys(df, keys).isEmpty():
            raise MergeError(f"keys repeat in the {name} version")
    common = [c for c in old.columns if c in new.columns and c not in keys]
    left = old.select(*keys, F.struct(F.lit(1).alias("_"), *common).alias("_old"))
    right = new.select(*keys, F.struct(F.lit(1).alias("_"), *common).alias("_new"))
    names = [F.when(~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")), F.lit(c)) for c in common]
    both = F.col("_old").isNotNull() & F.col("_new").isNotNull()
    return (
        left.join(right, keys, "outer")
        .withColumn("changed", F.when(both, F.concat_ws(",", *names)).otherwise(""))
        .withColumn(
            "status",
            F.when(F.col("_old").isNull(), "only_new").when(F.col("_new").isNull(), "only_old").otherwise("differs"),
        )
        .where(~both | (F.col("changed") != ""))
        .select(*keys, "status", "changed")
    )


def stack_results(tables: Sequence[tuple[Mapping[str, str], DataFrame]]) -> DataFrame:
    """Union of result tables, each with its label columns in front."""
    out = None
    for labels, df in tables:
        labelled = df.select(*[F.lit(v).alias(k) for k, v in labels.items()], *df.columns)
        out = labelled if out is None else out.unionByName(labelled, allowMissingColumns=True)
    return out
