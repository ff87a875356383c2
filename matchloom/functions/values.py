"""Recodes, bands, scores and flags as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.codes import as_column

# CKD-EPI 2021 creatinine equation and the unit of creatinine.
UMOL_PER_MG_DL = 88.4
CKD_EPI_SCALE = 142
CKD_EPI_KAPPA = {"F": 0.7, "M": 0.9}
CKD_EPI_ALPHA = {"F": -0.241, "M": -0.302}
CKD_EPI_HIGH_EXPONENT = -1.2
CKD_EPI_AGE_BASE = 0.9938
CKD_EPI_FEMALE = 1.012

# Recency windows in days before the index date, both ends included.
RECENCY_DAYS = {
    "exposed_12m": (0, 365),
    "recent_3m": (0, 90),
    "recent_6m": (92, 180),
    "recent_12m": (182, 365),
}
RECENCY_DAYS_CONTIGUOUS = {
    "exposed_12m": (0, 366),
    "recent_3m": (0, 90),
    "recent_6m": (91, 180),
    "recent_12m": (181, 366),
}

# Body-mass bands (label, low, high), with one-decimal gaps between them.
BMI_BANDS = {
    1: (("Underweight", None, 18.4), ("Healthy weight", 18.5, 24.9), ("Overweight", 25.0, 29.9), ("Obese", 30.0, None)),
    2: (("Underweight", None, 18.4), ("Healthy weight", 18.5, 22.9), ("Overweight", 23.0, 27.4), ("Obese", 27.5, None)),
}


def recode(column, mapping: Mapping, default=None) -> Column:
    """Map listed values; others become ``default``, or stay when it is None."""
    column = as_column(column)
    out = None
    for old, new in mapping.items():
        out = F.when(column == old, new) if out is None else out.when(column == old, new)
    rest = column if default is None else F.lit(default)
    return rest if out is None else out.otherwise(rest)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or null."""
    return F.when(condition, 1).otherwise(0)


def one_or_zero(column) -> Column:
    """1 only for the value 1; null and everything else give 0."""
    return flag(as_column(column) == 1)


def in_range(column, low=None, high=None) -> Column:
    """Inclusive plausible range; a missing bound is open."""
    column = as_column(column)
    test = column.isNotNull()
    if low is not None:
        test = test & (column >= low)
    if high is not None:
        test = test & (column <= high)
    return test


def not_blank(column) -> Column:
    column = as_column(column)
    return column.isNotNull() & (column != "")


def safe_number(text, whole: bool = False) -> Column:
    """Number in a text, null when it is not one; ``whole`` truncates."""
    number = as_column(text).cast("string").try_cast("double")
    return number.try_cast("int") if whole else number


def with_thousands(column) -> Column:
    """Whole number as text with thousands separators."""
    return F.format_number(as_column(column), 0)


def typed_null(type_name: str) -> Column:
    return F.lit(None).cast(type_name)


def ckd_epi_2021(creatinine_umol, sex, age) -> Column:
    """Estimated filtration rate, rounded to a whole number.

    Creatinine is in micromoles per litre; any sex but ``F`` takes the male
    constants.
    """
    female = as_column(sex) == "F"
    kappa = F.when(female, CKD_EPI_KAPPA["F"]).otherwise(CKD_EPI_KAPPA["M"])
    alpha = F.when(female, CKD_EPI_ALPHA["F"]).otherwise(CKD_EPI_ALPHA["M"])
    ratio = as_column(creatinine_umol).cast("double") / UMOL_PER_MG_DL / kappa
    value = (
        F.lit(CKD_EPI_SCALE)
        * F.pow(F.least(ratio, F.lit(1.0)), alpha)
        * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(CKD_EPI_HIGH_EXPONENT))
        * F.pow(F.lit(CKD_EPI_AGE_BASE), as_column(age))
        * F.when(female, CKD_EPI_FEMALE).otherwise(1.0)
    )
    return F.round(value, 0)


def band_by_group(value, group, bands: Mapping = BMI_BANDS, gaps: bool = False) -> Column:
    """Label of the band of ``value``, with the band table chosen by ``group``.

    A value between two bands goes to the lower one, or to null with
    ``gaps=True``. Null value or unlisted group gives null.
    """
    value, group = as_column(value), as_column(group)
    out = F.when(value.isNull() | group.isNull(), F.lit(None).cast("string"))
    for key, rows in bands.items():
        for position, (label, low, high) in enumerate(rows):
            test = group == key
            if gaps:
                if low is not None:
                    test = test & (value >= low)
                if high is not None:
                    test = test & (value <= high)
            elif position + 1 < len(rows):
                test = test & (value < rows[position + 1][1])
            out = out.when(test, label)
    return out


def binned(value, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins ``[b0, b1), [b1, b2) ...``; outside gives null."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per bin")
    value = as_column(value)
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for low, high, label in zip(breaks, breaks[1:], labels):
        test = (value >= low) if high == float("inf") else (value >= low) & (value < high)
        out = out.when(test, label)
    return out


def exposure_group(recent, *older) -> Column:
    """``both``, ``recent_only``, ``non_recent_only`` or ``none`` from 0/1 flags."""
    is_recent = F.coalesce(as_column(recent) == 1, F.lit(False))
    is_older = F.lit(False)
    for column in older:
        is_older = is_older | F.coalesce(as_column(column) == 1, F.lit(False))
    return (
        F.when(is_recent & is_older, "both")
        .when(is_recent, "recent_only")
        .when(is_older, "non_recent_only")
        .otherwise("none")
    )


def level_dummies(column: str, levels: Sequence, reference, prefix: str | None = None) -> dict[str, Column]:
    """0/1 columns for each level but the reference; null stays null."""
    if reference not in levels:
        raise ValueError(f"{reference!r} is not a level")
    source = F.col(column)
    return {
        f"{prefix or column}_{level}": F.when(source.isNotNull(), (source == level).cast("int"))
        for level in levels
        if level != reference
    }
