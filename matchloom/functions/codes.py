"""Column expressions on clinical codes, which are always strings."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


# What a code is cleaned of, at its end and anywhere, and the zero before a position.
TRAILING = r"X$"
PUNCTUATION = r"[.,\-\s]"
PUNCTUATION_NO_COMMA = r"[.\-\s]"
LEADING_ZERO = r"^0"


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_code(code, comma: bool = True) -> Column:
    """Drop one trailing ``X``, then dots, dashes, blanks (and commas).

    The order matters: ``A41.X`` gives ``A41.`` and then ``A41``, while the
    ``X`` of ``A41X.`` stays.
    """
    plain = F.regexp_replace(as_column(code), TRAILING, "")
    return strip_punctuation(plain) if comma else F.regexp_replace(plain, PUNCTUATION_NO_COMMA, "")


def strip_punctuation(code) -> Column:
    return F.regexp_replace(as_column(code), PUNCTUATION, "")


def clean_code_of(code, terminology, kind: str = "ICD10") -> Column:
    """``clean_code`` for one terminology, other codes unchanged."""
    return F.when(as_column(terminology) == kind, clean_code(code, comma=False)).otherwise(as_column(code))


def differs(left, right) -> Column:
    """1 when the two values differ, null counting as a value."""
    return (~as_column(left).eqNullSafe(as_column(right))).cast("int")


def same(left, right) -> Column:
    """Null-safe equality as 0/1."""
    return as_column(left).eqNullSafe(as_column(right)).cast("int")


def parent_code(code, digits: int = 3) -> Column:
    return F.substring(as_column(code), 1, digits)


def clean_position(position) -> Column:
    """Position text after a stub: no leading zero."""
    return F.regexp_replace(as_column(position), LEADING_ZERO, "")


def cause_position(position, underlying: str = "UNDERLYING") -> Column:
    """``SECONDARY_n`` for numbered causes, the underlying one as it is."""
    position = as_column(position)
    return F.when(position != underlying, F.concat(F.lit("SECONDARY_"), position)).otherwise(position)


def starts_with_any(code, prefixes: Iterable[str]) -> Column:
    """True when the code begins with one of the prefixes (any lengths)."""
    by_length: dict[int, list[str]] = {}
    for prefix in prefixes:
        by_length.setdefault(len(prefix), []).append(prefix)
    test = F.lit(False)
    for length, group in sorted(by_length.items()):
        test = test | F.substring(as_column(code), 1, length).isin(group)
    return test


def prefix_rule(code, include: Iterable[str], exclude: Iterable[str] = ()) -> Column:
    """Hierarchical rule: under an included prefix and under no excluded one."""
    exclude = list(exclude)
    rule = starts_with_any(code, include)
    return rule & ~starts_with_any(code, exclude) if exclude else rule
