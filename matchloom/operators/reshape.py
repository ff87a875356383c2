"""Wide records to long ones, and the record normalisers built on that."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions.codes import (
    cause_position,
    clean_code,
    clean_position,
    parent_code,
    same,
    strip_punctuation,
)
from matchloom.functions.dates import parse_compact_date
from matchloom.functions.values import not_blank
from matchloom.operators.ranking import first_rows


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names of the columns that match the pattern as a whole."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def select_matching(df: DataFrame, ids: Sequence[str], pattern: str) -> DataFrame:
    return df.select(*ids, *[c for c in columns_matching(df, pattern) if c not in ids])


def wide_to_long(df: DataFrame, ids: Sequence[str], position: str, stub: str) -> DataFrame:
    """One row per column ``<stub><suffix>``; the suffix becomes ``position``, the value ``stub``.

    Every position gives a row, nulls too; callers drop blanks.
    """
    values = [c for c in df.columns if c.startswith(stub) and c not in ids]
    return df.unpivot(list(ids), values, "_column", stub).select(
        *ids, F.expr(f"substr(_column, {len(stub) + 1})").alias(position), stub
    )


def wide_to_long_multi(df: DataFrame, ids: Sequence[str], position: str, stubs: Sequence[str]) -> DataFrame:
    """Several stubs in parallel: one row per suffix with a column per stub.

    A suffix that a stub lacks gives null there. All rows come from one pass
    over the record, as an inline table of its own columns.
    """
    suffixes = sorted({c[len(s):] for s in stubs for c in df.columns if c.startswith(s) and c not in ids})
    types = dict(df.dtypes)

    def cell(stub: str, suffix: str):
        if stub + suffix in types:
            return F.col(stub + suffix)
        like = next(t for c, t in df.dtypes if c.startswith(stub))
        return F.lit(None).cast(like)

    rows = [
        F.struct(F.lit(x).alias(position), *[cell(s, x).alias(s) for s in stubs]) for x in suffixes
    ]
    return df.select(*ids, F.inline(F.array(*rows)))


def codes_long(
    df: DataFrame, ids: Sequence[str], stub3: str, stub4: str, position: str = "position", digits: str = "digits"
) -> DataFrame:
    """Coded positions, three- and four-character codes below each other.

    Gives ``ids, position, digits, code``: leading zeros of positions stripped,
    codes cleaned, blanks dropped.
    """
    pairs = wide_to_long_multi(df, ids, "_position", [stub3, stub4])
    return (
        pairs.select(
            *ids,
            clean_position("_position").alias(position),
            F.inline(
                F.array(
                    F.struct(F.lit("3").alias(digits), F.col(stub3).alias("_raw")),
                    F.struct(F.lit("4").alias(digits), F.col(stub4).alias("_raw")),
                )
            ),
        )
        .withColumn("code", clean_code("_raw"))
        .where(not_blank("code"))
        .drop("_raw")
    )


def diagnosis_long(df: DataFrame, ids: Sequence[str], stub3: str = "diag_3_", stub4: str = "diag_4_") -> DataFrame:
    return codes_long(df, ids, stub3, stub4, "diag_position", "diag_digits")


def operations_long(df: DataFrame, ids: Sequence[str], stub3: str = "opertn_3_", stub4: str = "opertn_4_") -> DataFrame:
    return codes_long(df, ids, stub3, stub4, "opertn_position", "opertn_digits")


def code_consistency(df: DataFrame, ids: Sequence[str], stub3: str, stub4: str) -> DataFrame:
    """Per position: does the 3-character code begin the 4-character one, and is that one short enough."""
    return wide_to_long_multi(df, ids, "position", [stub3, stub4]).select(
        *ids,
        "position",
        same(stub3, parent_code(stub4)).alias("same_parent"),
        F.when(F.length(stub4) > 4, 0).otherwise(1).alias("length_ok"),
    )


def digits_mismatch(
    long: DataFrame, ids: Sequence[str], position: str = "position", digits: str = "digits"
) -> DataFrame:
    """Long codes back to one column per digit count, where they disagree."""
    wide = long.groupBy(*ids, position).pivot(digits, ["3", "4"]).agg(F.min("code"))
    return (
        wide.withColumnRenamed("3", "code_3")
        .withColumnRenamed("4", "code_4")
        .where(parent_code("code_4") != F.col("code_3"))
    )


def operation_dates_long(df: DataFrame, ids: Sequence[str], date_stub: str, code_stub: str) -> DataFrame:
    """Operation codes with their dates; null and ``-`` codes dropped, rows distinct."""
    long = wide_to_long_multi(df, ids, "position", [date_stub, code_stub])
    return long.where(F.col(code_stub).isNotNull() & (F.col(code_stub) != "-")).distinct()


def latest_registration(
    df: DataFrame, person: str, registered: str, died: str, cause: str
) -> DataFrame:
    """Text dates parsed, then one row per person: the latest registration.

    Ties go to the later date of death, then to the higher underlying cause.
    """
    parsed = (
        df.where(F.col(person).isNotNull())
        .withColumn(registered, F.try_to_date(F.col(registered), "yyyyMMdd"))
        .withColumn(died, parse_compact_date(died))
    )
    order = [F.col(c).desc_nulls_last() for c in (registered, died, cause)]
    return first_rows(parsed, [person], order)


def deaths_long(df: DataFrame, person: str, died: str, stub: str) -> DataFrame:
    """Causes of death, long, each as its 4- and 3-character code.

    ``df`` is one row per person with columns ``<stub>underlying`` and
    ``<stub>1 ...``; rows without a date of death or a cause are dropped.
    """
    causes = wide_to_long(df.where(F.col(died).isNotNull()), [person, died], "_position", stub)
    return causes.where(F.col(stub).isNotNull()).select(
        person,
        F.col(died).alias("date"),
        cause_position(F.upper("_position")).alias("diag_position"),
        F.inline(
            F.array(
                F.struct(F.lit("4").alias("diag_digits"), strip_punctuation(stub).alias("code")),
                F.struct(F.lit("3").alias("diag_digits"), strip_punctuation(parent_code(stub)).alias("code")),
            )
        ),
    )
