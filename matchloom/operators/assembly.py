"""Assembling the analysis table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.values import level_dummies, one_or_zero


def analysis_table(
    sets: DataFrame,
    demographics: DataFrame,
    member_tables: Sequence[DataFrame] = (),
    zero_flags: Sequence[str] = (),
    person: str = "person_id",
    set_column: str = "set",
) -> DataFrame:
    """Matched sets with demographics by person and further tables by member.

    All member tables share the (person, set) key, so they are stacked and
    folded in one aggregation instead of joined one after another; they must
    not repeat a column. ``zero_flags`` become 1 for the value 1, else 0.
    """
    key = [person, set_column]
    out = sets.join(demographics, person, "left")
    tables = list(member_tables)
    if tables:
        names = [c for t in tables for c in t.columns if c not in key]
        if len(set(names)) != len(names):
            raise ValueError(f"member tables repeat a column: {names}")
        stacked = tables[0]
        for table in tables[1:]:
            stacked = stacked.unionByName(table, allowMissingColumns=True)
        folded = stacked.groupBy(*key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])
        out = out.join(folded, key, "left")
    return out.withColumns({c: one_or_zero(c) for c in zero_flags})


def with_dummies(df: DataFrame, factors: Mapping[str, tuple[Sequence, object]]) -> tuple[DataFrame, list[str]]:
    """Add 0/1 columns for each factor ``{column: (levels, reference)}``; returns their names too."""
    columns: dict[str, Column] = {}
    for column, (levels, reference) in factors.items():
        columns.update(level_dummies(column, levels, reference))
    return df.withColumns(columns), list(columns)


def with_interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Products of column pairs, named ``a:b``."""
    columns = {f"{a}:{b}": F.col(f"`{a}`") * F.col(f"`{b}`") for a, b in pairs}
    return df.withColumns(columns), list(columns)


def model_terms(
    df: DataFrame,
    terms: Sequence[str] = (),
    factors: Mapping[str, tuple[Sequence, object]] | None = None,
    interactions: Sequence[tuple[str, str]] = (),
) -> tuple[DataFrame, list[str]]:
    """The columns of a model with factors: ``terms``, a 0/1 column per level but the reference, and interactions.

    An interaction names terms or factors; of a factor every level but the
    reference is multiplied. Returns the table and the names of the columns.
    """
    factors = dict(factors or {})
    columns = {f: list(level_dummies(f, *spec)) for f, spec in factors.items()}
    wide, dummies = with_dummies(df, factors)
    pairs = [(a, b) for x, y in interactions for a in columns.get(x, [x]) for b in columns.get(y, [y])]
    wide, products = with_interactions(wide, pairs)
    return wide, [*terms, *dummies, *products]
