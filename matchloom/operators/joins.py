"""Joins with checks, code-set filters and membership flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import broadcast_if_small


class MergeError(ValueError):
    """A validated merge found duplicate keys or an unexpected match state."""


def keep_codes(records: DataFrame, codes: DataFrame, column: str = "code") -> DataFrame:
    """Records whose code is in the list: a semi join, nothing is collected."""
    listed = broadcast_if_small(codes.select(F.col(column)).distinct())
    return records.join(listed, column, "left_semi")


def drop_codes(records: DataFrame, codes: DataFrame, column: str = "code") -> DataFrame:
    """Records whose code is not in the list (null codes stay)."""
    listed = broadcast_if_small(codes.select(F.col(column)).distinct())
    return records.join(listed, column, "left_anti")


def exclude_people(df: DataFrame, people: DataFrame, person: str = "person_id") -> DataFrame:
    """Rows of persons who are not in ``people``."""
    return df.join(people.select(person).distinct(), person, "left_anti")


def membership_flag(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Add ``out`` = 1 for keys that occur in ``members``, else 0."""
    ids = members.select(key).distinct().withColumn("_member", F.lit(1))
    return df.join(ids, key, "left").withColumn(out, F.coalesce("_member", F.lit(0))).drop("_member")


def values_by_code(records: DataFrame, codes: DataFrame, column: str = "code") -> DataFrame:
    """Inner join with a code list, carrying the list's columns along."""
    return records.join(broadcast_if_small(codes), column)


def validated_merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    validate: str = "m:m",
    assert_results: Sequence[str] = ("both", "left_only", "right_only"),
    indicator: str | None = None,
) -> DataFrame:
    """Join that checks key uniqueness and match states before it returns.

    ``validate`` is ``1:1``, ``1:m``, ``m:1`` or ``m:m``; ``assert_results``
    lists the match states that may occur. Both checks are one aggregation over
    per-key counts, not over the joined rows, and raise ``MergeError``.
    ``indicator`` names a column for the match state. Right-only rows come from
    an anti join: unlike a full join, both parts can be split on a hot key.
    """
    if validate not in ("1:1", "1:m", "m:1", "m:m"):
        raise ValueError(f"unknown validate {validate!r}")
    on = list(on)
    keyed = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_l")).join(
        right.groupBy(*on).agg(F.count(F.lit(1)).alias("_r")), on, "outer"
    )
    seen = keyed.agg(
        F.count(F.when(F.col("_l") > 1, 1)).alias("left_duplicates"),
        F.count(F.when(F.col("_r") > 1, 1)).alias("right_duplicates"),
        F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0)).alias("both"),
        F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("_l"))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.when(F.col("_l").isNull(), F.col("_r"))), F.lit(0)).alias("right_only"),
    ).first()
    left_side, right_side = validate.split(":")
    if left_side == "1" and seen["left_duplicates"]:
        raise MergeError(f"{seen['left_duplicates']} keys repeat on the left, expected {validate}")
    if right_side == "1" and seen["right_duplicates"]:
        raise MergeError(f"{seen['right_duplicates']} keys repeat on the right, expected {validate}")
    unexpected = {s: seen[s] for s in ("both", "left_only", "right_only") if s not in assert_results and seen[s]}
    if unexpected:
        raise MergeError(f"unexpected match states {unexpected}, allowed {list(assert_results)}")
    state = F.when(F.col("_in_right").isNull(), "left_only").otherwise("both")
    merged = left.join(right.withColumn("_in_right", F.lit(True)), on, "left").withColumn("_state", state).drop("_in_right")
    if seen["right_only"]:
        rest = right.join(left.select(*on).distinct(), on, "left_anti").withColumn("_state", F.lit("right_only"))
        merged = merged.unionByName(rest, allowMissingColumns=True)
    return merged.withColumnRenamed("_state", indicator) if indicator else merged.drop("_state")
