"""Study roles played by the supplied tables, each with its SQL twin.

The tables are a sales schema; customers stand for people, orders and line
items for dated coded records, quantities for measurements.
"""

from __future__ import annotations

import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.dates import observation_end, observation_start, within
from matchloom.functions.values import flag
from matchloom.operators.cohort import first_event_in_window
from matchloom.session import local_table
from matchloom.sources.tables import read_table

STUDY_START = "1998-01-01"
STUDY_END = "1998-12-31"
OUTCOME_CODES = ("1-URGENT",)


# tables opened by a session, for reading a file's schema costs a job
_OPENED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stamp(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    path = f"{sf}/{name}.parquet"
    opened, key = _OPENED.setdefault(spark, {}), (path, stamp(spark, path))
    if key not in opened:
        opened[key] = read_table(spark, path)
    return opened[key]


def born(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person: birth date and sex."""
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        key.alias("person_id"),
        F.make_date((1940 + key % 60).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int")).alias("birth_date"),
        F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
    )


def people(spark: SparkSession, sf: str) -> DataFrame:
    """One row per person: birth, sex, region, entry and death dates."""
    key = F.col("c_custkey")
    activity = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.min("o_orderdate").cast("date").alias("entry_date"),
        F.max("o_orderdate").cast("date").alias("last_date"),
    )
    return (
        table(spark, sf, "customer")
        .join(activity, "c_custkey", "left")
        .select(
            key.alias("person_id"),
            F.make_date((1940 + key % 60).cast("int"), (1 + key % 12).cast("int"), (1 + key % 28).cast("int")).alias("birth_date"),
            (1940 + key % 60).cast("int").alias("birth_year"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("sex"),
            F.col("c_mktsegment").alias("segment"),
            F.col("c_nationkey").alias("nation_key"),
            "entry_date",
            F.when(key % 10 == 0, F.date_add("last_date", 30)).alias("death_date"),
        )
    )


PEOPLE_SQL = """
people AS (
  SELECT c_custkey AS person_id,
         make_date(1940 + c_custkey % 60, 1 + c_custkey % 12, 1 + c_custkey % 28) AS birth_date,
         CAST(1940 + c_custkey % 60 AS INTEGER) AS birth_year,
         CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
         c_mktsegment AS segment, c_nationkey AS nation_key, entry_date,
         CASE WHEN c_custkey % 10 = 0 THEN last_date + 30 END AS death_date
  FROM customer LEFT JOIN (
    SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS entry_date, CAST(max(o_orderdate) AS DATE) AS last_date
    FROM orders GROUP BY o_custkey) a ON a.o_custkey = c_custkey)"""


def hospital(spark: SparkSession, sf: str) -> DataFrame:
    """Coded records A: ``person_id, date, code``."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("person_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("code"),
    )


HOSPITAL_SQL = """
hospital AS (
  SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS code FROM orders)"""


def prescriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Coded records B with a measurement: ``person_id, date, code, kind, value``."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    return items.join(orders, "l_orderkey").join(parts, "l_partkey").select(
        F.col("o_custkey").alias("person_id"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("code"),
        F.col("p_type").alias("kind"),
        F.col("l_quantity").alias("value"),
    )


PRESCRIPTIONS_SQL = """
prescriptions AS (
  SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS date, p_brand AS code, p_type AS kind, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def outcome_codes(spark: SparkSession) -> DataFrame:
    return local_table(spark, [("outcome", "PRIORITY", c) for c in OUTCOME_CODES], "name string, terminology string, code string")


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """People with their observation window before any outcome is known."""
    return people(spark, sf).where(F.col("entry_date").isNotNull()).select(
        "*",
        observation_start("entry_date", STUDY_START).alias("window_start"),
        observation_end(STUDY_END, "death_date").alias("window_end"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """First outcome of each person, kept when inside the person's window."""
    return first_event_in_window(
        observed(spark, sf).select("person_id", "window_start", "window_end"),
        {"hospital": (hospital(spark, sf), outcome_codes(spark))},
    )


OUTCOMES_SQL = f"""
observed AS (
  SELECT *, greatest(entry_date, DATE '{STUDY_START}') AS window_start,
         coalesce(death_date, DATE '{STUDY_END}') AS window_end
  FROM people WHERE entry_date IS NOT NULL),
outcomes AS (
  SELECT person_id, date, code, 'hospital' AS source, window_start, window_end FROM (
    SELECT o.person_id, h.date, h.code, o.window_start, o.window_end,
           row_number() OVER (PARTITION BY o.person_id ORDER BY h.date, h.code) AS rn
    FROM observed o JOIN hospital h ON h.person_id = o.person_id WHERE h.code IN ('1-URGENT')) r
  WHERE rn = 1 AND date BETWEEN window_start AND window_end)"""


def follow_up(spark: SparkSession, sf: str) -> DataFrame:
    """Everybody with case flag, window, follow-up days and matching columns."""
    events = outcomes(spark, sf).select("person_id", "date", "source", "code")
    joined = people(spark, sf).where(F.col("entry_date").isNotNull()).join(events, "person_id", "left")
    return joined.select(
        "*",
        flag(F.col("date").isNotNull()).alias("case"),
        F.year("entry_date").alias("entry_year"),
        observation_start("entry_date", STUDY_START).alias("window_start"),
        observation_end(STUDY_END, "date", "death_date").alias("window_end"),
    ).withColumn("follow_up_days", F.datediff("window_end", "window_start") + 1)


FOLLOW_UP_SQL = f"""
follow_up AS (
  SELECT *, date_diff('day', window_start, window_end) + 1 AS follow_up_days FROM (
    SELECT p.*, o.date, o.source, o.code,
           CASE WHEN o.date IS NOT NULL THEN 1 ELSE 0 END AS "case",
           year(p.entry_date) AS entry_year,
           greatest(p.entry_date, DATE '{STUDY_START}') AS window_start,
           coalesce(o.date, p.death_date, DATE '{STUDY_END}') AS window_end
    FROM people p LEFT JOIN outcomes o ON o.person_id = p.person_id
    WHERE p.entry_date IS NOT NULL) f)"""
COHORT_SQL = ",".join([PEOPLE_SQL, HOSPITAL_SQL, OUTCOMES_SQL, FOLLOW_UP_SQL])
