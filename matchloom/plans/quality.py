"""Queries on frequencies, missing values and version comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators import compare as K
from matchloom.operators import missing as N
from matchloom.operators import profile as P
from matchloom.plans.features import FEATURES_SQL, features, members
from matchloom.plans.registry import query
from matchloom.plans.roles import PEOPLE_SQL, people, table


@query("freq_one", f"""
WITH {PEOPLE_SQL}
SELECT segment, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM people), 6)::DOUBLE AS percent FROM people GROUP BY segment""")
def freq_one(spark, sf):
    return P.freq_one(people(spark, sf), "segment").withColumn("percent", F.round("percent", 6))


@query("freq_two", """
SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS INTEGER) AS level,
  round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6)::DOUBLE AS percent FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)""")
def freq_two(spark, sf):
    return P.freq_two(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", margins=True).withColumn("percent", F.round("percent", 6))


@query("count_var", f"""
WITH {PEOPLE_SQL} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(death_date) AS BIGINT) AS n_non_null, count(DISTINCT death_date) AS n_distinct FROM people""")
def count_var(spark, sf):
    return P.count_var(people(spark, sf), "death_date")


@query("count_keys", """
SELECT CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS n_distinct FROM lineitem""")
def count_keys(spark, sf):
    return P.count_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("date_range", "SELECT CAST(min(l_shipdate) AS DATE) AS first_date, CAST(max(l_shipdate) AS DATE) AS last_date FROM lineitem")
def date_range(spark, sf):
    return P.date_range(table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("day")), "day")


@query("describe_by", """
SELECT l_returnflag, count(q) AS count, round(avg(q), 6) AS mean, round(stddev_samp(q), 6) AS std, min(q) AS min, quantile_cont(q, 0.25) AS p25,
  quantile_cont(q, 0.5) AS p50, quantile_cont(q, 0.75) AS p75, max(q) AS max
FROM (SELECT l_returnflag, nullif(l_quantity, 50) AS q FROM lineitem) GROUP BY l_returnflag""")
def describe_by(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.nullif("l_quantity", F.lit(50.0)).alias("q"))
    out = P.describe_by(df, "l_returnflag", "q")
    return out.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_TEXTS = ("l_returnflag", "l_linestatus")


def _summary_sql(column: str) -> str:
    if column in _NUMBERS:
        value = f"CAST({column} AS DOUBLE)"
        numbers = [f"round(avg({value}), 4)", f"round(stddev_samp({value}), 4)", f"min({value})", *[f"quantile_cont({value}, {q})" for q in (0.25, 0.5, 0.75)], f"max({value})"]
        texts = ["CAST(NULL AS VARCHAR)"] * 2
    else:
        numbers, texts = ["CAST(NULL AS DOUBLE)"] * 7, [f"min({column})", f"max({column})"]
    named = zip([*numbers, *texts], ["mean", "std", "min", "p25", "p50", "p75", "max", "first", "last"])
    kind = "number" if column in _NUMBERS else "text"
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS kind, count({column}) AS count, count(*) - count({column}) AS nulls, "
        + ", ".join(f'{value} AS "{name}"' for value, name in named) + " FROM lineitem"
    )


@query("summary_cols", " UNION ALL ".join(_summary_sql(c) for c in (*_NUMBERS, *_TEXTS)))
def summary_cols(spark, sf):
    """Every number and text of the line items, quartiles included."""
    out = P.summary_columns(table(spark, sf, "lineitem"), [*_NUMBERS, *_TEXTS])
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)})


@query("duplicate_keys", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return P.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_suppkey"])


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("sample_rows", """
SELECT o_orderkey, o_custkey FROM orders ORDER BY md5(concat_ws('|', '42', o_orderkey)), o_orderkey LIMIT 200""")
def sample_rows(spark, sf):
    return P.sample_rows(table(spark, sf, "orders"), 200, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("preview", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 20")
def preview(spark, sf):
    return P.preview(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), 20, ["o_orderpriority", "o_orderkey"])


# -- missing values over the feature table -----------------------------------

GAPPY = ["last_small", "last_large", "low_score", "any_source"]


def profiled(spark, sf) -> DataFrame:
    df = features(spark, sf, members(spark, sf))
    return df.select("set", "person_id", "sex", "statin", *GAPPY)


@query("missing_by_column", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS variable, count(*) - count({c}) AS na_count, round((count(*) - count({c})) * 100.0 / count(*), 6)::DOUBLE AS na_percent FROM features" for c in GAPPY))
def missing_by_column(spark, sf):
    return N.missing_by_column(profiled(spark, sf), GAPPY).withColumn("na_percent", F.round("na_percent", 6))


@query("missing_by_group", f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"SELECT statin, '{c}' AS variable, count(*) - count({c}) AS na_count FROM features GROUP BY statin" for c in GAPPY))
def missing_by_group(spark, sf):
    return N.missing_by_group(profiled(spark, sf), "statin", GAPPY)


_NA_COUNT = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in GAPPY)


@query("missing_per_row", f"WITH {FEATURES_SQL} SELECT sex, CAST({_NA_COUNT} AS INTEGER) AS na_count, count(*) AS n FROM features GROUP BY 1, 2")
def missing_per_row(spark, sf):
    return N.missing_per_row(profiled(spark, sf), GAPPY, ["sex"])


@query("missing_rate", f"WITH {FEATURES_SQL} SELECT sex, statin, "
       + ", ".join(f"round(avg(CAST({c} IS NULL AS INTEGER)), 6) AS {c}_missing_rate" for c in GAPPY) + ", count(*) AS n FROM features GROUP BY 1, 2")
def missing_rate(spark, sf):
    out = N.missing_rate(profiled(spark, sf), ["sex", "statin"], GAPPY)
    return out.withColumns({f"{c}_missing_rate": F.round(f"{c}_missing_rate", 6) for c in GAPPY})


@query("missing_patterns", f"WITH {FEATURES_SQL} SELECT " + ", ".join(f"CAST({c} IS NULL AS INTEGER) AS {c}" for c in GAPPY)
       + ", count(*) AS n FROM features GROUP BY " + ", ".join(f"{c} IS NULL" for c in GAPPY))
def missing_patterns(spark, sf):
    return N.missing_patterns(profiled(spark, sf), GAPPY)


@query("missing_one_feature", """
WITH f AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 420000 GROUP BY o_custkey)
SELECT count(*) AS n_rows, count(*) - count(top) AS na_count, round((count(*) - count(top)) * 100.0 / count(*), 6)::DOUBLE AS na_percent
FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def missing_one_feature(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id"))
    top = table(spark, sf, "orders").where("o_totalprice > 420000").groupBy(F.col("o_custkey").alias("person_id")).agg(F.max("o_totalprice").alias("top"))
    return N.missing_one_feature(base, top, "top", ["person_id"]).withColumn("na_percent", F.round("na_percent", 6))


# -- comparing and stacking --------------------------------------------------


@query("compare_versions", """
WITH o AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderstatus) AS status FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1, 2),
n AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_orderstatus) AS status FROM orders WHERE year(o_orderdate) = 1998 GROUP BY 1, 2)
SELECT coalesce(o.o_custkey, n.o_custkey) AS o_custkey, coalesce(o.o_orderpriority, n.o_orderpriority) AS o_orderpriority,
  CASE WHEN o.n IS NULL THEN 'only_new' WHEN n.n IS NULL THEN 'only_old' ELSE 'differs' END AS status,
  CASE WHEN o.n IS NULL OR n.n IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.n <> n.n THEN 'n' END, CASE WHEN o.status <> n.status THEN 'state' END) END AS changed
FROM o FULL JOIN n ON o.o_custkey = n.o_custkey AND o.o_orderpriority = n.o_orderpriority
WHERE o.n IS NULL OR n.n IS NULL OR o.n <> n.n OR o.status <> n.status""")
def compare_versions(spark, sf):
    def version(year: int) -> DataFrame:
        chosen = table(spark, sf, "orders").where(F.year("o_orderdate") == year)
        return chosen.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderstatus").alias("state"))

    return K.compare_versions(version(1997), version(1998), ["o_custkey", "o_orderpriority"])


@query("stack_results", """
SELECT 'first' AS model, 'urgent' AS kind, o_orderstatus AS term, round(avg(o_totalprice), 4) AS estimate FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_orderstatus
UNION ALL
SELECT 'second', 'low', o_orderstatus, round(avg(o_totalprice), 4) FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY o_orderstatus""")
def stack_results(spark, sf):
    def result(priority: str) -> DataFrame:
        chosen = table(spark, sf, "orders").where(F.col("o_orderpriority") == priority)
        return chosen.groupBy(F.col("o_orderstatus").alias("term")).agg(F.round(F.avg("o_totalprice"), 4).alias("estimate"))

    return K.stack_results([({"model": "first", "kind": "urgent"}, result("1-URGENT")), ({"model": "second", "kind": "low"}, result("5-LOW"))])
