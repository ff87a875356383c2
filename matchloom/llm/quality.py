"""Quality rules with thresholds that follow the corpus.

Every document gets integer measures. Their distribution per (language, source)
is kept as a mergeable quantile sketch: counts per bucket, where a bucket is the
measure cut to its six leading binary digits, so a bucket's value is off by at
most 1/32 and sketches merge by adding counts, in any order, to the same result.
Thresholds are outlier fences read from the sketches, joined back to documents.

Only DataFrame functions are used. A hot language or source adds to the same few
buckets before the shuffle; what is joined to documents is one row per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import column, free_name, words
from matchloom.session import broadcast_if_small, cut_lineage

SHORTEST, REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"
#: A group with fewer documents is judged by its language, a small language by all.
GROUP_ROWS = 200
#: A fence lies this many spreads beyond the quartile ...
REACH = 3
#: ... where a spread is the quartile distance, and at least this (thousandths).
LEAST_SPREAD = {"word_length": 1500, "symbols": 50, "capitals": 300, "dup_lines": 300, "repeats": 200}
TWO_SIDED = ("word_length",)


def base_measures(text: Column) -> dict[str, Column]:
    """Per-document counts that need one look at the text; see ``measure``."""
    filled = F.coalesce(text, F.lit(""))
    return {
        "words": words(text),
        "word_chars": F.length(F.regexp_replace(filled, r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.regexp_count(filled, F.lit(SYMBOLS)).cast("long"),
        "n_capitals": F.regexp_count(filled, F.lit(r"\p{Lu}")).cast("long"),
        "lines": F.filter(F.split(filled, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
    }


def repeated_words(df: DataFrame, array: str, out: str) -> DataFrame:
    """Number of words that lie in a window of five found twice or more in the text.

    Windows are compared by hash. Their order is only sorted out for texts that
    repeat one, so most texts cost one pass.
    """
    keys, grams, pairs, starts = (free_name(df.columns, n) for n in ("_keys", "_grams", "_pairs", "_starts"))
    size = F.size(array)
    gram = lambda i: F.xxhash64(*[F.get(F.col(keys), i + k) for k in range(WINDOW)])
    none = F.array().cast("array<int>")
    same = lambda s, k: F.get(F.col(pairs), k)["gram"] == s["gram"]
    return (
        df.withColumn(keys, F.transform(array, lambda w: F.xxhash64(w)))
        .withColumn(grams, F.when(size >= WINDOW, F.transform(F.sequence(F.lit(0), size - WINDOW), gram)))
        .withColumn(
            pairs,
            F.when(
                F.size(F.array_distinct(grams)) < F.size(grams),
                F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("gram"), i.alias("at")))),
            ),
        )
        .withColumn(
            starts,
            F.when(
                F.col(pairs).isNotNull(),
                F.array_sort(
                    F.transform(
                        F.filter(pairs, lambda s, k: F.coalesce(same(s, k - 1), F.lit(False)) | F.coalesce(same(s, k + 1), F.lit(False))),
                        lambda s: s["at"],
                    )
                ),
            ).otherwise(none),
        )
        .withColumn(
            out,
            F.when(F.size(starts) == 0, F.lit(0)).otherwise(
                F.lit(WINDOW)
                + F.aggregate(
                    F.sequence(F.lit(0), F.size(starts) - 1),
                    F.lit(0),
                    lambda total, k: total
                    + F.when(k == 0, 0).otherwise(
                        F.least(F.lit(WINDOW), F.get(F.col(starts), k) - F.get(F.col(starts), k - 1))
                    ),
                )
            ).cast("long"),
        )
        .drop(keys, grams, pairs, starts)
    )


def measure(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add a struct ``out`` with the counts of each whole text and the base verdict.

    A null or empty text has no words and fails the base rules. Other columns,
    whatever their names, pass through.
    """
    kept = docs.columns
    raw = free_name([*kept, out], "_raw")
    arr = free_name([*kept, out, raw], "_words")
    rep = free_name([*kept, out, raw, arr], "_repeats")
    counts = base_measures(column(text))
    lines = counts.pop("lines")
    found = counts.pop("words")
    df = docs.withColumn(arr, found).withColumn(
        raw, F.struct(*[v.alias(k) for k, v in counts.items()], lines.alias("lines"))
    )
    df = repeated_words(df, arr, rep)
    n = F.size(arr).cast("long")
    lines = F.col(raw)["lines"]
    n_dup = (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    per = lambda count, base: F.when(base > 0, F.floor(1000 * count / base)).otherwise(0).cast("long")
    get = lambda name: F.col(raw)[name]
    measured = F.struct(
        n.alias("n_words"),
        get("word_chars").alias("word_chars"),
        get("n_symbols").alias("n_symbols"),
        n_dup.alias("n_dup_lines"),
        F.col(rep).alias("n_repeat_words"),
        ((n < SHORTEST) | (100 * F.col(rep) > REPEAT_PERCENT * n)).alias("base_failed"),
        F.struct(
            per(get("word_chars"), n).alias("word_length"),
            per(get("n_symbols"), n).alias("symbols"),
            per(get("n_capitals"), n).alias("capitals"),
            per(n_dup, F.size(lines)).alias("dup_lines"),
            per(F.col(rep), n).alias("repeats"),
        ).alias("rates"),
    )
    return df.withColumn(out, measured).select(*[column(c) for c in kept], out)


def bucket(value: Column) -> Column:
    """A non-negative long cut to its six leading binary digits."""
    drop = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame, at: str, groups: list[str]) -> DataFrame:
    """Counts per (groups, rate, bucket) over documents that pass the base rules."""
    rates = F.array(*[
        F.struct(F.lit(name).alias("rate"), bucket(F.col(at)["rates"][name]).alias("bucket")) for name in LEAST_SPREAD
    ])
    return (
        measured.where(~F.col(at)["base_failed"])
        .select(*[column(g).alias(f"g{i}") for i, g in enumerate(groups)], F.explode(rates).alias("r"))
        .groupBy(*[f"g{i}" for i in range(len(groups))], F.col("r.rate").alias("rate"), F.col("r.bucket").alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def merged(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of finer groups added up to coarser ones."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: its number of documents and a struct of (low, high) per rate.

    Quartiles are the smallest buckets that reach a quarter and three quarters.
    A window holds the buckets of one group and rate, under two thousand rows.
    """
    whole = Window.partitionBy(*keys, "rate")
    running = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    spread = F.create_map(*[F.lit(x) for pair in LEAST_SPREAD.items() for x in pair])
    quartiles = (
        sketches.withColumn("upto", F.sum("n").over(running))
        .withColumn("total", F.sum("n").over(whole))
        .groupBy(*keys, "rate")
        .agg(
            F.min(F.when(4 * F.col("upto") >= F.col("total"), F.col("bucket"))).alias("q1"),
            F.min(F.when(4 * F.col("upto") >= 3 * F.col("total"), F.col("bucket"))).alias("q3"),
            F.max("total").alias("total"),
        )
        .withColumn("reach", REACH * F.greatest(F.col("q3") - F.col("q1"), spread[F.col("rate")]))
    )
    return quartiles.groupBy(*keys).agg(
        F.max("total").alias("total"),
        F.struct(*[
            F.struct(
                F.max(F.when(F.col("rate") == name, F.col("q1") - F.col("reach"))).alias("low"),
                F.max(F.when(F.col("rate") == name, F.col("q3") + F.col("reach"))).alias("high"),
            ).alias(name)
            for name in LEAST_SPREAD
        ]).alias("fence"),
    )


def thresholds(measured: DataFrame, at: str, lang: str, source: str) -> DataFrame:
    """Fences per (language, source), taken from the language or from all where few documents are.

    Null languages and sources are groups of their own.
    """
    fine = cut_lineage(sketch(measured, at, [lang, source]))
    by_source = fences(fine, ["g0", "g1"])
    by_lang = fences(merged(fine, ["g0"]), ["g0"]).select(
        F.col("g0").alias("l0"), F.col("total").alias("lang_total"), F.col("fence").alias("lang_fence")
    )
    overall = fences(merged(fine.withColumn("all", F.lit(0)), ["all"]), ["all"]).select(F.col("fence").alias("all_fence"))
    return (
        by_source.join(by_lang, F.col("g0").eqNullSafe(F.col("l0")), "left")
        .withColumn("all_fence", overall.scalar())
        .select(
            "g0",
            "g1",
            F.when(F.col("total") >= GROUP_ROWS, F.col("fence"))
            .when(F.col("lang_total") >= GROUP_ROWS, F.col("lang_fence"))
            .otherwise(F.col("all_fence"))
            .alias("fence"),
        )
    )


def adaptive_rules(
    docs: DataFrame,
    out: str = "quality",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    carry: bool = True,
) -> DataFrame:
    """Add a struct ``out``: counts, ``base_failed``, ``kept`` and the names of failed rates.

    The measured documents are written once, as the sketches and the verdict both
    read them; rows are never matched by document id, so repeated ids are safe.
    An empty table gives an empty result. Without ``carry`` the text itself is
    neither written nor returned.
    """
    at = free_name(docs.columns, out)
    columns = [c for c in docs.columns if carry or c != text]
    measured = cut_lineage(measure(docs, at, text).select(*map(column, columns), at))
    limits = broadcast_if_small(cut_lineage(thresholds(measured, at, lang, source)))
    rate = column_of("d", at)["rates"]
    failed = F.filter(
        F.array(*[
            F.when(
                (rate[name] > F.col("t.fence")[name]["high"])
                | ((rate[name] < F.col("t.fence")[name]["low"]) if name in TWO_SIDED else F.lit(False)),
                F.lit(name),
            )
            for name in LEAST_SPREAD
        ]),
        lambda name: name.isNotNull(),
    )
    base = measured.alias("d").join(
        limits.alias("t"),
        column_of("d", lang).eqNullSafe(F.col("t.g0")) & column_of("d", source).eqNullSafe(F.col("t.g1")),
        "left",
    )
    keep = ~column_of("d", at)["base_failed"] & (F.size(failed) == 0)
    full = F.struct(
        *[column_of("d", at)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        keep.alias("kept"),
        failed.alias("failed"),
    )
    return base.select(*[column_of("d", c) for c in columns], full.alias(at))


def column_of(table: str, name: str) -> Column:
    return F.col(f"{table}.`{name.replace('`', '``')}`")


def keep_good(docs: DataFrame, **names: str) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    at = free_name(docs.columns, "quality")
    return adaptive_rules(docs, at, **names).where(F.col(at)["kept"]).drop(at)
