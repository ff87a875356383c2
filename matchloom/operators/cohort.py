"""Inclusion rules, attrition, exclusion by earlier events, first outcomes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.dates import within
from matchloom.functions.values import flag
from matchloom.operators.codelists import codelist_match, first_match
from matchloom.operators.joins import membership_flag


def inclusion_flags(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One 0/1 column per rule; a null condition counts as not met."""
    return df.withColumns({name: flag(rule) for name, rule in rules.items()})


def _accepted(required: Mapping[str, object]) -> list[Column]:
    tests = []
    for column, wanted in required.items():
        values = list(wanted) if isinstance(wanted, (list, tuple, set)) else [wanted]
        tests.append(F.coalesce(F.col(column).isin(values), F.lit(False)))
    return tests


def cohort_inclusion(df: DataFrame, required: Mapping[str, object]) -> DataFrame:
    """Rows in which every listed column has its wanted value (or one of them)."""
    keep = F.lit(True)
    for test in _accepted(required):
        keep = keep & test
    return df.where(keep)


def attrition(df: DataFrame, required: Mapping[str, object]) -> DataFrame:
    """Rows left after each rule in turn, from one pass over the data.

    ``step, rule, n_rule`` (meets this rule), ``n_kept`` (meets it and all
    before it), ``n_lost`` (lost at this step). Step 0 counts all rows.
    """
    sums = [F.count(F.lit(1)).alias("_k0"), F.count(F.lit(1)).alias("_r0")]
    so_far = F.lit(True)
    for i, test in enumerate(_accepted(required), 1):
        so_far = so_far & test
        sums += [F.count(F.when(so_far, 1)).alias(f"_k{i}"), F.count(F.when(test, 1)).alias(f"_r{i}")]
    steps = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(rule).alias("rule"),
            F.col(f"_r{i}").alias("n_rule"),
            F.col(f"_k{i}").alias("n_kept"),
            (F.col(f"_k{max(i - 1, 0)}") - F.col(f"_k{i}")).alias("n_lost"),
        )
        for i, rule in enumerate(["all", *required])
    ]
    return df.agg(*sums).select(F.inline(F.array(*steps)))


def event_before_entry(
    people: DataFrame,
    sources: Mapping[str, tuple],
    start: str,
    end: str,
    out: str,
    person: str = "person_id",
) -> DataFrame:
    """Add a 0/1 flag: any listed code dated in ``[start, end)`` of the person.

    Records are matched to the codes before they meet the people, and only the
    ids of those flagged are joined back.
    """
    windows = people.where(F.col(end).isNotNull()).select(person, F.col(start).alias("_from"), F.col(end).alias("_to"))
    hits = (
        codelist_match(sources)
        .join(windows, person)
        .where(within("date", "_from", "_to", closed=False))
        .select(person)
    )
    return membership_flag(people, hits, person, out)


def first_event_in_window(
    windows: DataFrame,
    sources: Mapping[str, tuple],
    person: str = "person_id",
    start: str = "window_start",
    end: str = "window_end",
    first_in_window: bool = False,
) -> DataFrame:
    """First matching event of each person, kept only inside the closed window.

    By default the first event ever is chosen and then tested, so an earlier
    event outside the window removes the person; ``first_in_window`` tests
    first. The first event is found before the join with the windows, so only
    one row per person is shuffled for it.
    """
    matches = codelist_match(sources)
    inside = within("date", start, end)
    keep = ["date", "code", "source", start, end]
    if first_in_window:
        return first_match(matches.join(windows, person).where(inside), [person]).select(person, *keep)
    return first_match(matches, [person]).join(windows, person).where(inside).select(person, *keep)


def invalid_windows(df: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Rows whose window ends before it starts."""
    return df.where(F.col(end) < F.col(start))


def window_check(df: DataFrame, by: Sequence[str] = (), start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Row count and number of invalid windows, per group."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col(end) < F.col(start), 1)).alias("n_invalid"),
    )
