"""Bounded as-of lookups without pairing every probe with every record."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import cut_lineage, discard


def one_per_day(events: DataFrame, keys: Sequence[str], date: str, payload: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Reduce events to one row per key and day, the first by the tie columns.

    The minimum is combined before the shuffle, so a key that owns a large
    share of the records leaves each task with at most one row per day.
    """
    carried = [*ties, *[c for c in payload if c not in ties]]
    return (
        events.groupBy(*keys, date)
        .agg(F.min(F.struct(*carried)).alias("_first"))
        .select(*keys, date, *[F.col(f"_first.{c}").alias(c) for c in payload])
    )


def nearest_event(
    probes: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    at: str,
    date: str,
    payload: Sequence[str] = (),
    forward: Column | bool = False,
    slices: int | None = None,
) -> DataFrame:
    """Add to each probe the last event on or before ``at``, by key.

    Where ``forward`` holds it is the first event on or after ``at``. Keys may be
    null; of several events of a key at one time any may be taken.

    Probes and events are merged and range partitioned by (key, time), so a key
    spreads over slices in proportion to its rows. Inside a slice the neighbouring
    event is carried to the probe in time order; what comes from another slice is
    one event per slice and key that a slice border cuts, at most two rows per
    slice. The work is linear in both inputs, where a join would multiply them per
    key. ``slices`` sets the number of slices; by default Spark does.
    """
    by = list(by)
    ahead = forward if isinstance(forward, Column) else F.lit(forward)
    event = F.struct(F.col(date), *[F.col(c) for c in payload])
    probe_columns = [c for c in probes.columns if c not in by]
    # on one day: forward probes, then events, then backward probes
    merged = probes.select(
        *by, F.col(at).alias("_at"), F.when(ahead, 0).otherwise(2).alias("_turn"), F.struct(*probe_columns).alias("_probe")
    ).unionByName(
        events.select(*by, F.col(date).alias("_at"), F.lit(1).alias("_turn"), event.alias("_event")), allowMissingColumns=True
    )
    # written before it is dealt out, since dealing looks at the rows twice
    merged = cut_lineage(merged)
    order = [*by, "_at", "_turn"]
    ranged = merged.repartitionByRange(slices, *order) if slices else merged.repartitionByRange(*order)
    sliced = cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))
    discard(merged)
    within = f"OVER (PARTITION BY _slice, {', '.join(f'`{c}`' for c in by)} ORDER BY _at, _turn"
    before = F.expr(f"last(_event) IGNORE NULLS {within} ROWS UNBOUNDED PRECEDING)")
    after = F.expr(f"lead(_event, 1) IGNORE NULLS {within})")
    if not isinstance(forward, Column):
        here, carried = (after, F.col("_later")) if forward else (before, F.col("_earlier"))
    else:
        here = F.when(F.col("_turn") == 0, after).otherwise(before)
        carried = F.when(F.col("_turn") == 0, F.col("_later")).otherwise(F.col("_earlier"))
    found = sliced.withColumn("_here", here).where(F.col("_turn") != 1)
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*by, "_slice"]]
    return (
        found.alias("s")
        .join(F.broadcast(_carried(sliced, by)).alias("c"), reduce(and_, same), "left")
        .select(
            *[F.col(f"s.{c}").alias(c) for c in by], "_probe", F.coalesce("_here", carried).alias("_found")
        )
        .select(
            *by,
            *[F.col(f"_probe.{c}").alias(c) for c in probe_columns],
            F.col(f"_found.{date}").alias(date),
            *[F.col(f"_found.{c}").alias(c) for c in payload],
        )
    )


def _carried(sliced: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each slice of a key that lies in several: the last event of the slices before, the first of those after.

    Only the first and the last key of a slice can reach into another one, so
    there are at most two rows per slice.
    """
    ends = sliced.groupBy("_slice").agg(F.min(F.struct(*by)).alias("low"), F.max(F.struct(*by)).alias("high"))
    cut = cut_lineage(ends.select(F.explode(F.array("low", "high")).alias("key")).select("key.*").distinct())
    same = reduce(and_, [F.col(f"s.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by])
    event, at = F.when(F.col("_turn") == 1, F.col("_event")), F.when(F.col("_turn") == 1, F.col("_at"))
    spans = cut_lineage(
        sliced.alias("s")
        .join(F.broadcast(cut).alias("k"), same, "left_semi")
        .groupBy(*by, "_slice")
        .agg(F.max_by(event, at).alias("_last"), F.min_by(event, at).alias("_first"))
    )
    along = Window.partitionBy(*by).orderBy("_slice")
    return spans.select(
        *by,
        "_slice",
        F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_later"),
    )


def latest_in_window(
    base: DataFrame,
    records: DataFrame,
    person: str,
    window: tuple[Column, Column],
    date: str,
    payload: Sequence[str],
    ties: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Latest record of each base row's person inside the row's closed window.

    Base rows without such a record are left out, as after an inner join. Rows
    on one day are resolved by the tie columns, then by the payload. Rows of one
    person with one window are looked up once.
    """
    daily = one_per_day(
        records.where(F.col(person).isNotNull() & F.col(date).isNotNull()),
        [person], date, payload, [*ties, *[c for c in payload if c not in ties]],
    )
    start, end = window
    asked = base.withColumn("_start", start).withColumn("_end", end).where(F.col(person).isNotNull())
    probes = asked.select(person, "_start", "_end").where(F.col("_start") <= F.col("_end")).distinct()
    found = nearest_event(probes, daily, [person], "_end", date, payload, slices=slices)
    hits = found.where(F.col(date) >= F.col("_start"))
    return asked.join(hits, [person, "_start", "_end"]).drop("_start", "_end").select(
        *base.columns, date, *[c for c in payload if c != date]
    )
