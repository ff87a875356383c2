"""Look-back features: one column per specification and matched-set member.

All features come from one pass over the large tables, not one filter, join and
ranking each: records are matched to the code lists (broadcast when small),
reduced to one row per person, code group and day, and met by the look-back
windows in date order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.dates import lookback_window
from matchloom.functions.values import RECENCY_DAYS, in_range
from matchloom.operators.asof import nearest_event, one_per_day
from matchloom.session import broadcast_if_small, cut_lineage, fits, local_table

RULES = ("latest", "flag", "span")


@dataclass(frozen=True)
class Feature:
    """One look-back feature.

    ``rule`` is ``latest`` (value of the latest record), ``flag`` (1 if there is
    any record) or ``span`` (1 if the first and last record lie at least
    ``min_days`` apart). ``months=None`` looks back to birth. ``low`` and
    ``high`` bound the values inclusively; ``below`` is an exclusive bound.
    ``fill`` replaces a missing result.
    """

    name: str
    codelist: str
    sources: tuple[str, ...]
    rule: str = "flag"
    months: int | None = 12
    start_offset: int = 0
    end_offset: int = 0
    low: float | None = None
    high: float | None = None
    below: float | None = None
    min_days: int = 90
    max_days: int | None = None
    fill: int | None = None

    def window(self, index_date: str, birth_date: str) -> tuple[Column, Column]:
        start, end = lookback_window(index_date, self.months, self.start_offset, self.end_offset, birth_date)
        if self.max_days is not None:
            start = F.greatest(start, F.date_sub(F.col(index_date), self.max_days))
        return start, end


def _stream(f: Feature) -> tuple:
    """What decides which records a feature sees; features that agree share them."""
    return (f.codelist, f.sources, f.low, f.high, f.below, f.rule == "latest")


def _streams(features: Sequence[Feature]) -> dict[tuple, int]:
    return {key: i for i, key in enumerate(dict.fromkeys(_stream(f) for f in features))}


def _stream_map(features: Sequence[Feature], codes: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``code, source, stream, priority`` and the value bounds, for every stream."""
    number = lambda x: None if x is None else float(x)
    rows = [
        (s, codelist, i, sources.index(s), number(low), number(high), number(below), needs_value)
        for (codelist, from_sources, low, high, below, needs_value), i in _streams(features).items()
        for s in from_sources
    ]
    spec = local_table(
        codes.sparkSession, rows,
        "source string, codelist string, stream int, priority int, low double, high double, below double, needs_value boolean",
    )
    listed = codes.select(F.col("name").alias("codelist"), "code").distinct()
    return listed.join(F.broadcast(spec), "codelist").drop("codelist")  # a row per stream and source


@dataclass(frozen=True)
class Source:
    """Where a source's records lie: a table, and the columns of its codes and values.

    Sources of one table (the same DataFrame object) are read in one scan.
    """

    records: DataFrame
    code: str = "code"
    value: str | None = "value"


def _matched(
    sources: Mapping[str, Source], mapping: DataFrame, person: str, wanted: DataFrame | None
) -> DataFrame:
    """``person, date, code, value`` with the streams that take them, each physical table read once."""
    tables: dict[int, list[tuple[str, Source]]] = {}
    for label, source in sources.items():
        tables.setdefault(id(source.records), []).append((label, source))
    parts = []
    for entries in tables.values():
        df = entries[0][1].records
        value = lambda s: (F.col(s.value).cast("double") if s.value in df.columns else F.lit(None).cast("double"))
        seen = [
            F.struct(F.lit(label).alias("source"), F.col(s.code).alias("code"), value(s).alias("value")) for label, s in entries
        ]
        rows = df.where(F.col(person).isNotNull() & F.col("date").isNotNull())
        if wanted is not None:
            rows = rows.join(F.broadcast(wanted), person, "left_semi")
        if len(seen) == 1:
            rows = rows.select(person, "date", seen[0].alias("_seen")).select(person, "date", "_seen.*")
        else:
            rows = rows.select(person, "date", F.inline(F.array(*seen)))
        parts.append(rows.join(mapping, ["source", "code"]))
    return reduce(DataFrame.unionByName, parts)


def feature_events(
    records: Mapping[str, DataFrame | Source],
    codes: DataFrame,
    features: Sequence[Feature],
    person: str = "person_id",
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``person, stream, date, value``: one row per day, matched and in range.

    A stream serves all features with the same codes, sources and value range.

    ``records`` maps a source label to ``(person, date, code, value)`` or to a
    ``Source``; the order of the mapping settles ties on a day, then code, then
    value. Streams that only ask for days keep no value, so a day is one row after a
    hash aggregate; where a value counts, equal rows are joined first and the
    day's first row is taken from what is left.
    ``wanted`` limits the people: before anything is shuffled when their ids
    are few enough to broadcast, else after the reduction to days.
    """
    early = wanted is not None and fits(wanted)
    sources = {label: r if isinstance(r, Source) else Source(r) for label, r in records.items()}
    mapping = broadcast_if_small(_stream_map(features, codes, list(sources)))
    rows = _matched(sources, mapping, person, wanted if early else None)
    valid = rows.where(
        (F.col("low").isNull() | (F.col("value") >= F.col("low")))
        & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
        & (F.col("below").isNull() | (F.col("value") < F.col("below")))
        & (F.col("value").isNotNull() | ~F.col("needs_value"))
    )
    ties = ["priority", "code", "value"]
    bare = [F.when(F.col("needs_value"), F.col(c)).alias(c) for c in ties]
    days = valid.select(person, "stream", "date", "needs_value", *bare).distinct()
    if any(f.rule == "latest" for f in features):
        days = cut_lineage(days)
        daily = one_per_day(days.where("needs_value"), [person, "stream"], "date", ["value"], ties)
        days = daily.unionByName(days.where("not needs_value").select(daily.columns))
    else:
        days = days.select(person, "stream", "date", "value")
    return days if early or wanted is None else days.join(wanted, person, "left_semi")


def _probes(base: DataFrame, features: Sequence[Feature], person: str, index_date: str, birth_date: str) -> DataFrame:
    """Windows of each (person, index date), one per feature.

    Each window is looked up backwards from its end; for a span also forwards
    from its start.
    """
    rows, streams = [], _streams(features)
    for f in features:
        start, end = f.window(index_date, birth_date)
        for ahead in (False, True) if f.rule == "span" else (False,):
            rows.append(
                F.struct(
                    F.lit(streams[_stream(f)]).alias("stream"), F.lit(f.name).alias("feature"), start.alias("_start"), end.alias("_end"),
                    F.lit(ahead).alias("_ahead"), (start if ahead else end).alias("_look"),
                )
            )
    return (
        base.select(person, index_date, F.inline(F.array(*rows)))
        .where(F.col("_start").isNotNull() & F.col("_end").isNotNull())
    )


def feature_table(
    base: DataFrame,
    records: Mapping[str, DataFrame | Source],
    codes: DataFrame,
    features: Sequence[Feature],
    person: str = "person_id",
    index_date: str = "index_date",
    birth_date: str = "birth_date",
) -> DataFrame:
    """``base`` with one column per feature, null (or ``fill``) without a record.

    A feature depends on person and index date only, so people in several sets
    of one date are computed once. The result joins back on those two columns.
    ``base`` is written once, unless it is a written table, for it is read as people,
    as windows and as the result.
    """
    for f in features:
        if f.rule not in RULES:
            raise ValueError(f"unknown rule {f.rule!r}")
    base = base if hasattr(base, "cut_path") else cut_lineage(base)
    asked = cut_lineage(base.groupBy(person, index_date).agg(F.min(birth_date).alias(birth_date)))
    events = feature_events(records, codes, features, person, asked.select(person).distinct())
    probes = _probes(asked, features, person, index_date, birth_date)
    ahead = F.col("_ahead") if any(f.rule == "span" for f in features) else False
    found = nearest_event(probes, events, [person, "stream"], "_look", "date", ["value"], ahead)
    found = found.where(F.col("date").between(F.col("_start"), F.col("_end")))
    columns = []
    for f in features:
        mine = F.col("feature") == f.name
        if f.rule == "latest":
            column = F.max(F.when(mine, F.col("value")))
        elif f.rule == "flag":
            column = F.max(F.when(mine, 1))
        else:
            apart = F.datediff(F.max(F.when(mine, F.col("date"))), F.min(F.when(mine, F.col("date"))))
            column = F.when(apart >= f.min_days, 1)
        columns.append(column.alias(f.name))
    wide = found.groupBy(person, index_date).agg(*columns)
    out = base.join(wide, [person, index_date], "left")
    fills = {f.name: f.fill for f in features if f.fill is not None}
    return out.na.fill(fills) if fills else out


def any_in_window(
    base: DataFrame,
    sources: Mapping[str, tuple],
    out: str,
    months: int | None,
    end_offset: int = 0,
    **columns: str,
) -> DataFrame:
    """Members with a listed code in their window, as ``base`` plus a flag of 1 or null.

    ``sources`` is ``{label: (records, codes)}`` as for a code-list match.
    """
    labelled = None
    for label, (_, codes, *_rest) in sources.items():
        part = codes.select(F.lit(label).alias("name"), "code")
        labelled = part if labelled is None else labelled.unionByName(part)
    records = {label: spec[0] for label, spec in sources.items()}
    flags = [Feature(f"_{label}", label, (label,), "flag", months, 0, end_offset) for label in sources]
    flagged = feature_table(base, records, labelled, flags, **columns)
    names = [f.name for f in flags]
    return flagged.withColumn(out, F.coalesce(*names)).drop(*names)


def recency_features(
    codelist: str, source: str, windows: Mapping[str, tuple[int, int]] | None = None, months: int = 12
) -> list[Feature]:
    """A flag per day range before the index date, inside the look-back months."""
    windows = RECENCY_DAYS if windows is None else windows
    return [
        Feature(name, codelist, (source,), "flag", months, 0, -near, max_days=far)
        for name, (near, far) in windows.items()
    ]


def exposure_recency(
    base: DataFrame,
    records: DataFrame,
    codes: DataFrame,
    codelist: str,
    windows: Mapping[str, tuple[int, int]] | None = None,
    months: int = 12,
    person: str = "person_id",
    set_column: str = "set",
    **columns: str,
) -> DataFrame:
    """0/1 exposure flags by recency, for members with any record in the look-back.

    A record outside all day ranges but inside the months (day 366 of a leap
    year) keeps its member in the table with all flags 0.
    """
    flags = recency_features(codelist, "records", windows, months)
    every = [*flags, Feature("_any", codelist, ("records",), "flag", months)]
    table = feature_table(base, {"records": records}, codes, every, person=person, **columns)
    names = [f.name for f in flags]
    return table.where(F.col("_any") == 1).select(person, set_column, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def class_flags(
    base: DataFrame,
    records: DataFrame,
    codes: DataFrame,
    names: Sequence[str],
    months: int = 12,
    max_days: int = 365,
    person: str = "person_id",
    set_column: str = "set",
    **columns: str,
) -> DataFrame:
    """One 0/1 column per code-list name, for members with any of the classes."""
    flags = [Feature(n, n, ("records",), "flag", months, max_days=max_days) for n in names]
    table = feature_table(base, {"records": records}, codes, flags, person=person, **columns)
    return table.where(F.coalesce(*names).isNotNull()).select(
        person, set_column, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def persistent_low(
    base: DataFrame,
    readings: DataFrame,
    below: float,
    out: str,
    min_days: int = 90,
    months: int | None = None,
    **columns: str,
) -> DataFrame:
    """Flag members with two readings under ``below`` at least ``min_days`` apart."""
    codes = local_table(readings.sparkSession, [(out, "reading")], "name string, code string")
    rule = Feature(out, out, ("readings",), "span", months, below=below, min_days=min_days)
    return feature_table(base, {"readings": readings.withColumn("code", F.lit("reading"))}, codes, [rule], **columns)


def plausible(df: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows whose value lies in the inclusive range."""
    return df.where(in_range(column, low, high))
