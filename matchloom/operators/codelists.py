"""Building code lists, and matching records to them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.codes import clean_code_of, differs, prefix_rule
from matchloom.operators.joins import drop_codes
from matchloom.operators.ranking import first_rows
from matchloom.session import broadcast_if_small, local_table

CODELIST_SCHEMA = "name string, terminology string, code string, term string"


def literal_codelist(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """Code list from rows ``(name, terminology, code, term)``, all text."""
    return local_table(spark, [tuple(r) for r in rows], CODELIST_SCHEMA)


def code_labels(records: DataFrame, code: str, label: str) -> DataFrame:
    """One representative label per code, the first by name."""
    return records.groupBy(F.col(code).alias("code")).agg(F.min(label).alias("term"))


def prefix_codelist(
    labels: DataFrame,
    name: str,
    terminology: str,
    include: Sequence[str],
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Codes under the included prefixes and under none of the excluded ones."""
    return labels.where(prefix_rule("code", include, exclude)).select(
        F.lit(name).alias("name"), F.lit(terminology).alias("terminology"), "code", "term"
    )


def reference_codelist(reference: DataFrame, names: Sequence[str], rename: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of a reference list for the given names, distinct, names optionally changed."""
    from matchloom.functions.values import recode

    chosen = reference.where(F.col("name").isin(list(names))).select("name", "terminology", "code", "term").distinct()
    return chosen.withColumn("name", recode("name", rename)) if rename else chosen


def harmonised_union(lists: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column missing from one list becomes null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), lists)


def clean_codelist(codes: DataFrame, kind: str = "ICD10", changed: str | None = None) -> DataFrame:
    """Clean the codes of one terminology; ``changed`` names a 0/1 column for rows altered."""
    out = codes.withColumn("_old", F.col("code")).withColumn("code", clean_code_of("code", "terminology", kind))
    if changed:
        out = out.withColumn(changed, differs("code", "_old"))
    return out.drop("_old")


def build_codelist(lists: Sequence[DataFrame], kind: str = "ICD10", excluded: DataFrame | None = None) -> DataFrame:
    """Union, clean, and drop excluded codes."""
    combined = clean_codelist(harmonised_union(lists), kind)
    return drop_codes(combined, excluded) if excluded is not None else combined


def suspicious_codes(codes: DataFrame, zeros: int = 9, min_length: int = 13) -> DataFrame:
    """Long numeric codes ending in zeros, as a spreadsheet leaves them after rounding."""
    return codes.where(
        (F.length("code") >= min_length) & F.col("code").rlike(r"^\d+$") & (F.right("code", F.lit(zeros)) == "0" * zeros)
    )


def prefix_problems(codes: DataFrame, include: Sequence[str]) -> DataFrame:
    """Prefix rules that select no code of the list (for example names typed as prefixes)."""
    counts = codes.agg(
        *[F.count(F.when(F.substring("code", 1, len(p)) == p, 1)).alias(f"_{i}") for i, p in enumerate(include)]
    )
    rows = [F.struct(F.lit(p).alias("prefix"), F.col(f"_{i}").alias("n_codes")) for i, p in enumerate(include)]
    return counts.select(F.inline(F.array(*rows))).where(F.col("n_codes") == 0)


def codelist_overlap(codes: DataFrame) -> DataFrame:
    """Codes that stand under more than one name."""
    return (
        codes.groupBy("code")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
        .where(F.size("names") > 1)
    )


def codelist_match(sources: Mapping[str, tuple]) -> DataFrame:
    """Records that carry a listed code, over all sources.

    ``sources`` is ``{label: (records, codes)}`` or ``{label: (records, codes,
    priority)}``; the priority settles ties and is the position in the mapping
    when not given. Every record column passes through; ``name`` comes from the
    list, ``source`` and ``source_priority`` from the mapping. Matching uses
    the code only, before anything is shuffled by person.
    """
    parts = []
    for position, (label, spec) in enumerate(sources.items(), 1):
        records, codes = spec[0], spec[1]
        priority = spec[2] if len(spec) > 2 else position
        listed = broadcast_if_small(codes.select("name", "code").distinct())
        parts.append(
            records.join(listed, "code")
            .withColumn("source", F.lit(label))
            .withColumn("source_priority", F.lit(priority))
        )
    return harmonised_union(parts)


def first_match(matches: DataFrame, keys: Sequence[str], last: bool = False) -> DataFrame:
    """One row per key: earliest date (latest with ``last``), then priority, then code."""
    date = F.col("date").desc_nulls_last() if last else F.col("date").asc_nulls_last()
    ties = [c for c in ("name", "source_priority") if c in matches.columns and c not in keys]
    order = [date, *[t for t in ("source_priority",) if t in ties], "code", *[t for t in ("name",) if t in ties]]
    return first_rows(matches, keys, order)


def match_wide(
    matches: DataFrame, names: Sequence[str], keys: Sequence[str] = ("person_id",), prefix: str = "out_", last: bool = False
) -> DataFrame:
    """Per key a flag and a first (last) date column for each name."""
    pick = F.max if last else F.min
    columns = []
    for name in names:
        hit = F.col("name") == name
        columns += [
            F.max(F.when(hit, 1).otherwise(0)).alias(f"{prefix}{name}_flag"),
            pick(F.when(hit, F.col("date"))).alias(f"{prefix}{name}_date"),
        ]
    return matches.groupBy(*keys).agg(*columns)


def match_summary(matches: DataFrame, by_code: bool = False, person: str = "person_id") -> DataFrame:
    """Rows and distinct people by name (and code), per source and over all of them.

    People are first reduced to one row per (name, code, source, person), so
    the distinct count never gathers the raw records of one code.
    """
    labels = ["name", "code"] if by_code else ["name"]
    reduced = matches.groupBy(*labels, "source", person).agg(F.count(F.lit(1)).alias("_n"))
    per_source = reduced.groupBy(*labels, "source").agg(
        F.sum("_n").alias("n_rows"), F.count(person).alias("n_people")
    )
    overall = (
        reduced.groupBy(*labels, person).agg(F.sum("_n").alias("_n"))
        .groupBy(*labels).agg(F.sum("_n").alias("n_rows"), F.count(person).alias("n_people"))
        .withColumn("source", F.lit("all"))
    )
    return per_source.unionByName(overall)
