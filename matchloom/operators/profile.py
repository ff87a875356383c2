"""Frequency tables, counts, descriptions and duplicate checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from matchloom.operators.ranking import running_total
from matchloom.session import cut_lineage

QUARTERS = (0.25, 0.5, 0.75)


def freq_one(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage per value, null being a value of its own."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    return counts.withColumn("percent", F.col("n") * 100.0 / total.scalar())


def freq_two(df: DataFrame, row: str, column: str, margins: bool = False) -> DataFrame:
    """Count and percentage per pair of values.

    With margins, ``level`` is 0 for cells, 1 for row totals, 2 for column
    totals and 3 for the grand total.
    """
    pairs = df.groupBy(row, column).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("_total"))
    if margins:
        pairs = pairs.cube(row, column).agg(F.sum("n").alias("n"), F.grouping_id().cast("int").alias("level"))
    return pairs.withColumn("percent", F.col("n") * 100.0 / total.scalar())


def count_var(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Rows, non-null values and distinct values of a column.

    The exact distinct count reduces to one row per value first, so a value
    that fills the table costs no more than a rare one.
    """
    if approximate:
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count(column).alias("n_non_null"),
            F.approx_count_distinct(column).alias("n_distinct"),
        )
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col(column).isNotNull(), F.col("_n"))), F.lit(0)).alias("n_non_null"),
        F.count(column).alias("n_distinct"),
    )


def count_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows and distinct key tuples."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct")
    )


def date_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first_date"), F.max(column).alias("last_date"))


def describe_by(df: DataFrame, by: str, column: str, accuracy: int | None = None) -> DataFrame:
    """Count, mean, standard deviation, minimum, quartiles and maximum per group.

    Exact quartiles come from counts per value that are numbered by running
    totals, so no task holds a group. With ``accuracy`` they come from a bounded
    sketch.
    """
    value = F.col(column).cast("double")
    if accuracy:
        quartiles = F.percentile_approx(value, list(QUARTERS), accuracy)
        table = df.groupBy(by)
        stats = [F.count(value), F.avg(value), F.stddev(value), F.min(value), quartiles, F.max(value)]
        names = ["count", "mean", "std", "min", "_q", "max"]
        out = table.agg(*[s.alias(n) for s, n in zip(stats, names)])
    else:
        stats = df.groupBy(by).agg(
            F.count(value).alias("count"),
            F.avg(value).alias("mean"),
            F.stddev(value).alias("std"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
        )
        # a struct, so that a null group is a key like any other
        stats = stats.withColumn("_key", F.struct(by))
        counts = df.where(value.isNotNull()).groupBy(F.struct(by).alias("_key"), value.alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
        out = stats.join(_quartiles(counts, stats.select("_key", "count")), "_key", "left")
    return out.select(
        by, "count", "mean", "std", "min",
        *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
        "max",
    )


def _quartiles(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Quartiles ``_q`` per ``_key`` from the counts ``_n`` of each ``_value``; ``totals`` has ``_key`` and ``count``."""
    placed = running_total(counts, ["_value"], ["_key"], weight=F.col("_n"), out="_upto").join(totals, "_key")
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("_value")))
    place = [q * (F.col("count") - 1) for q in QUARTERS]
    low, high = [at(F.floor(p)) for p in place], [at(F.ceil(p)) for p in place]
    part = [F.max(p - F.floor(p)) for p in place]
    return placed.groupBy("_key").agg(F.array(*[a + f * (b - a) for a, b, f in zip(low, high, part)]).alias("_q"))


def summary_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Long summary of columns, a row each: numbers with exact quartiles, anything else by its text.

    ``column, kind, count, nulls, mean, std, min, p25, p50, p75, max`` and, for text,
    dates and other kinds, ``first`` and ``last`` in text order. Two passes: one for
    the sums of all columns, one that unpivots the numbers into counts per (column,
    value), which one running total numbers. Without rows the count is 0.
    """
    columns = list(columns or df.columns)
    numeric = {f.name for f in df.schema if isinstance(f.dataType, NumericType)}
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    none, sums, rows = F.lit(None), [], []
    for i, c in enumerate(columns):
        value = named(c).cast("double") if c in numeric else none.cast("double")
        text = none.cast("string") if c in numeric else named(c).cast("string")
        stats = {
            "count": F.count(named(c)), "nulls": F.count(F.lit(1)) - F.count(named(c)), "mean": F.avg(value), "std": F.stddev(value),
            "min": F.min(value), "max": F.max(value), "first": F.min(text), "last": F.max(text),
        }
        sums += [fn.alias(f"{i}#{name}") for name, fn in stats.items()]
        kind = F.lit("number" if c in numeric else "text").alias("kind")
        rows.append(F.struct(F.lit(i).alias("_key"), F.lit(c).alias("column"), kind, *[F.col(f"`{i}#{name}`").alias(name) for name in stats]))
    stats = cut_lineage(df.agg(*sums).select(F.inline(F.array(*rows))))
    out = stats.withColumn("_q", F.lit(None).cast("array<double>"))
    if numeric & set(columns):
        cells = [F.struct(F.lit(i).alias("_key"), named(c).cast("double").alias("_value")) for i, c in enumerate(columns) if c in numeric]
        counts = df.select(F.inline(F.array(*cells))).where(F.col("_value").isNotNull()).groupBy("_key", "_value").agg(F.count(F.lit(1)).alias("_n"))
        out = stats.join(F.broadcast(_quartiles(counts, F.broadcast(stats.select("_key", "count")))), "_key", "left")  # a row per column
    quartiles = [F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "p50", "p75"))]
    return out.select("column", "kind", "count", "nulls", "mean", "std", "min", *quartiles, "max", "first", "last")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` random rows, the same ones for any partitioning.

    Rows are ordered by a hash of their keys; each task keeps its first ``n``.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return df.orderBy(F.md5(text), *keys).limit(n)


def preview(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """First ``n`` rows in order."""
    return df.orderBy(*order).limit(n)
