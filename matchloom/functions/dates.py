"""Column expressions on dates and observation windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.codes import as_column

# Days of a year for ages, the form of a compact date, and its length with a one-digit day.
DAYS_PER_YEAR = 365.25
COMPACT = "yyyyMMdd"
SHORT_LENGTH = 7


def parse_compact_date(text) -> Column:
    """Date of ``yyyyMMdd`` text, null when malformed.

    Seven characters mean a one-digit day, which gets its zero.
    """
    text = as_column(text)
    padded = F.when(
        F.length(text) == SHORT_LENGTH,
        F.concat(F.substring(text, 1, 6), F.lit("0"), F.substring(text, 7, 1)),
    ).otherwise(text)
    return F.try_to_date(padded, COMPACT)


def year_month(date) -> Column:
    return F.date_format(as_column(date), "yyyy-MM")


def year_text(date) -> Column:
    return F.date_format(as_column(date), "yyyy")


def days_between(start, end, inclusive: bool = False) -> Column:
    days = F.datediff(as_column(end), as_column(start))
    return days + 1 if inclusive else days


def age_years(birth, at) -> Column:
    """Whole years, counting 365.25 days to a year."""
    return F.floor(F.datediff(as_column(at), as_column(birth)) / F.lit(DAYS_PER_YEAR)).cast("int")


def years_since(date, at) -> Column:
    return F.datediff(as_column(at), as_column(date)) / F.lit(DAYS_PER_YEAR)


def lookback_window(
    index_date,
    months: int | None,
    start_offset: int = 0,
    end_offset: int = 0,
    birth_date=None,
) -> tuple[Column, Column]:
    """Closed window before an index date.

    It starts ``months`` months back (plus ``start_offset`` days), or at birth
    when ``months`` is None, and ends ``end_offset`` days from the index date.
    """
    index_date = as_column(index_date)
    if months is None:
        if birth_date is None:
            raise ValueError("a window over all history needs the birth date column")
        start = as_column(birth_date)
    else:
        start = F.date_add(F.add_months(index_date, -months), start_offset)
    return start, F.date_add(index_date, end_offset)


def observation_start(entry, study_start: str) -> Column:
    """Entry date, not before the study start; null without an entry date."""
    entry = as_column(entry)
    return F.when(entry.isNotNull(), F.greatest(entry, F.to_date(F.lit(study_start))))


def observation_end(study_end: str, *stops, bounded: bool = False) -> Column:
    """First non-null stop (event, then death), else the study end.

    A stop after the study end extends the window unless ``bounded``.
    """
    last = F.to_date(F.lit(study_end))
    end = F.coalesce(*[as_column(s) for s in stops], last)
    return F.least(end, last) if bounded else end


def within(date, start, end, closed: bool = True) -> Column:
    """In ``[start, end]``, or ``[start, end)`` when not closed."""
    date, start, end = as_column(date), as_column(start), as_column(end)
    return (date >= start) & (date <= end if closed else date < end)
