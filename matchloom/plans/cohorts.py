"""Queries on inclusion, outcomes, code-list matches and matched sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import dates as D
from matchloom.functions import values as V
from matchloom.operators import codelists as L
from matchloom.operators import cohort as H
from matchloom.operators import joins as J
from matchloom.operators import matching as M
from matchloom.operators.joins import validated_merge
from matchloom.plans.registry import query
from matchloom.plans.roles import (
    COHORT_SQL,
    HOSPITAL_SQL,
    OUTCOMES_SQL,
    PEOPLE_SQL,
    PRESCRIPTIONS_SQL,
    follow_up,
    hospital,
    observed,
    outcomes,
    people,
    prescriptions,
    table,
)
from matchloom.session import local_table

# -- cohort ------------------------------------------------------------------


@query("first_event_in_window", f"""
WITH {PEOPLE_SQL}, {HOSPITAL_SQL}, {OUTCOMES_SQL}
SELECT person_id, date, code, source, window_start, window_end FROM outcomes""")
def first_event_in_window(spark, sf):
    return outcomes(spark, sf)


@query("first_event_after_start", f"""
WITH {PEOPLE_SQL}, {HOSPITAL_SQL}, {OUTCOMES_SQL}
SELECT person_id, date, code, 'hospital' AS source, window_start, window_end FROM (
  SELECT o.person_id, h.date, h.code, o.window_start, o.window_end,
         row_number() OVER (PARTITION BY o.person_id ORDER BY h.date, h.code) AS rn
  FROM observed o JOIN hospital h ON h.person_id = o.person_id
  WHERE h.code = '1-URGENT' AND h.date BETWEEN o.window_start AND o.window_end) WHERE rn = 1""")
def first_event_after_start(spark, sf):
    codes = local_table(spark, [("outcome", "1-URGENT")], "name string, code string")
    windows = observed(spark, sf).select("person_id", "window_start", "window_end")
    return H.first_event_in_window(windows, {"hospital": (hospital(spark, sf), codes)}, first_in_window=True)


@query("recode_map", """
SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'BASIC' WHEN 'STANDARD' THEN 'BASIC' WHEN 'PROMO' THEN 'OFFER' ELSE p_type END AS grouped,
       CASE p_type WHEN 'ECONOMY' THEN 'low' ELSE 'other' END AS level, count(*) AS n FROM part GROUP BY 1, 2, 3""")
def recode_map(spark, sf):
    mapping = {"ECONOMY": "BASIC", "STANDARD": "BASIC", "PROMO": "OFFER"}
    return table(spark, sf, "part").select(
        "p_type", V.recode("p_type", mapping).alias("grouped"), V.recode("p_type", {"ECONOMY": "low"}, "other").alias("level")
    ).groupBy("p_type", "grouped", "level").agg(F.count(F.lit(1)).alias("n"))


def flagged_people(spark, sf) -> DataFrame:
    codes = local_table(spark, [("early", "5-LOW")], "name string, code string")
    known = H.event_before_entry(
        people(spark, sf).withColumn("cut_date", F.add_months("entry_date", 6)),
        {"hospital": (hospital(spark, sf), codes)}, "birth_date", "cut_date", "low_before_cut",
    )
    return H.inclusion_flags(known, {
        "no_entry_date": F.col("entry_date").isNull(),
        "included_birth": F.col("birth_date") <= F.to_date(F.lit("1985-06-30")),
        "included_entry": F.col("entry_date") <= F.to_date(F.lit("1996-06-30")),
    }).withColumn("included_death", 1 - V.flag(F.col("death_date") < F.to_date(F.lit("2001-01-01"))))


FLAGGED_SQL = f"""{PEOPLE_SQL}, {HOSPITAL_SQL},
flagged AS (
  SELECT p.*, entry_date + INTERVAL 6 MONTH AS cut_date,
    CASE WHEN EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = p.person_id AND h.code = '5-LOW'
       AND h.date >= p.birth_date AND h.date < p.entry_date + INTERVAL 6 MONTH) THEN 1 ELSE 0 END AS low_before_cut,
    CASE WHEN entry_date IS NULL THEN 1 ELSE 0 END AS no_entry_date,
    CASE WHEN birth_date <= DATE '1985-06-30' THEN 1 ELSE 0 END AS included_birth,
    CASE WHEN entry_date <= DATE '1996-06-30' THEN 1 ELSE 0 END AS included_entry,
    CASE WHEN death_date < DATE '2001-01-01' THEN 0 ELSE 1 END AS included_death
  FROM people p)"""
FLAG_NAMES = ("no_entry_date", "included_birth", "included_entry", "included_death", "low_before_cut")
RULES = {
    "included_birth": 1,
    "included_death": 1,
    "segment": ["BUILDING", "MACHINERY", "AUTOMOBILE"],
    "no_entry_date": 0,
    "low_before_cut": 0,
}
SEGMENTS = "('BUILDING', 'MACHINERY', 'AUTOMOBILE')"


@query("inclusion_flags", f"WITH {FLAGGED_SQL} SELECT person_id, {', '.join(FLAG_NAMES)} FROM flagged")
def inclusion_flags(spark, sf):
    return flagged_people(spark, sf).select("person_id", *FLAG_NAMES)


@query("cohort_inclusion", f"""
WITH {FLAGGED_SQL} SELECT person_id, sex, segment, entry_date FROM flagged
WHERE included_birth = 1 AND included_death = 1 AND segment IN {SEGMENTS} AND no_entry_date = 0 AND low_before_cut = 0""")
def cohort_inclusion(spark, sf):
    return H.cohort_inclusion(flagged_people(spark, sf), RULES).select("person_id", "sex", "segment", "entry_date")


@query("inclusion_variant", f"""
WITH {FLAGGED_SQL} SELECT person_id, sex, segment, entry_date FROM flagged
WHERE included_birth = 1 AND included_death = 1 AND segment IN {SEGMENTS} AND included_entry = 1""")
def inclusion_variant(spark, sf):
    rules = {"included_birth": 1, "included_death": 1, "segment": RULES["segment"], "included_entry": 1}
    return H.cohort_inclusion(flagged_people(spark, sf), rules).select("person_id", "sex", "segment", "entry_date")


_TESTS = ("TRUE", "included_birth = 1", "included_death = 1", f"segment IN {SEGMENTS}", "no_entry_date = 0", "low_before_cut = 0")
_NAMES = ("all", *RULES)


def _attrition_sql() -> str:
    rows = []
    for i, name in enumerate(_NAMES):
        kept, before = " AND ".join(_TESTS[: i + 1]), " AND ".join(_TESTS[: max(i, 1)])
        rows.append(
            f"SELECT CAST({i} AS INTEGER) AS step, '{name}' AS rule, count(*) FILTER (WHERE {_TESTS[i]}) AS n_rule, "
            f"count(*) FILTER (WHERE {kept}) AS n_kept, "
            f"count(*) FILTER (WHERE {before}) - count(*) FILTER (WHERE {kept}) AS n_lost FROM flagged"
        )
    return f"WITH {FLAGGED_SQL} " + " UNION ALL ".join(rows)


@query("attrition", _attrition_sql())
def attrition(spark, sf):
    return H.attrition(flagged_people(spark, sf), RULES)


@query("event_before_entry", f"WITH {FLAGGED_SQL} SELECT low_before_cut, count(*) AS n FROM flagged GROUP BY 1")
def event_before_entry(spark, sf):
    return flagged_people(spark, sf).groupBy("low_before_cut").agg(F.count(F.lit(1)).alias("n"))


@query("window_checks", f"""
WITH {COHORT_SQL}
SELECT segment, count(*) AS n_rows, count(*) FILTER (WHERE window_end < window_start) AS n_invalid FROM follow_up GROUP BY segment""")
def window_checks(spark, sf):
    return H.window_check(follow_up(spark, sf), ["segment"])


@query("person_region", """
SELECT c_custkey AS person_id, n_name AS nation, r_name AS region FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 6 <> 0 LEFT JOIN region ON r_regionkey = n_regionkey""")
def person_region(spark, sf):
    places = table(spark, sf, "nation").where("n_nationkey % 6 <> 0").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, sf, "customer")
    return customers.join(places, customers.c_nationkey == places.n_nationkey, "left").select(
        F.col("c_custkey").alias("person_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


@query("validated_merge", """
SELECT c.c_nationkey AS nation_key, c.c_custkey AS person_id, n.n_name AS nation,
       CASE WHEN c.c_custkey IS NULL THEN 'right_only' WHEN n.n_name IS NULL THEN 'left_only' ELSE 'both' END AS state
FROM customer c FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON n.n_nationkey = c.c_nationkey""")
def validated_merge_query(spark, sf):
    left = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation_key"), F.col("c_custkey").alias("person_id"))
    right = table(spark, sf, "nation").where("n_nationkey < 20").select(
        F.col("n_nationkey").alias("nation_key"), F.col("n_name").alias("nation")
    )
    return validated_merge(left, right, ["nation_key"], validate="m:1", assert_results=["both", "left_only", "right_only"], indicator="state")


@query("membership_flag", """
SELECT c_custkey AS person_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 1 ELSE 0 END AS big_order
FROM customer""")
def membership_flag(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("person_id"))
    return J.membership_flag(table(spark, sf, "customer").select(F.col("c_custkey").alias("person_id")), big, "person_id", "big_order")


@query("date_parts", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, strftime(o_orderdate, '%Y') AS year_text,
       CAST(DATE '1998-06-30' - CAST(o_orderdate AS DATE) AS INTEGER) AS days,
       CAST(DATE '1998-06-30' - CAST(o_orderdate AS DATE) + 1 AS INTEGER) AS days_inclusive FROM orders""")
def date_parts(spark, sf):
    day, at = F.col("o_orderdate").cast("date"), F.to_date(F.lit("1998-06-30"))
    return table(spark, sf, "orders").select(
        "o_orderkey", D.year_month("o_orderdate").alias("year_month"), D.year_text("o_orderdate").alias("year_text"),
        D.days_between(day, at).alias("days"), D.days_between(day, at, inclusive=True).alias("days_inclusive"),
    )


# -- code-list matches over two sources --------------------------------------

MATCH_CODES = (("urgent", "1-URGENT"), ("urgent", "2-HIGH"), ("minor", "5-LOW"))
BRAND_CODES = (("urgent", "Brand#4"), ("minor", "Brand#5"), ("minor", "Brand#6"))


def match_sources(spark, sf):
    priorities = local_table(spark, list(MATCH_CODES), "name string, code string")
    brands = local_table(spark, list(BRAND_CODES), "name string, code string")
    drugs = prescriptions(spark, sf).select("person_id", "date", "code")
    return {"hospital": (hospital(spark, sf), priorities, 1), "pharmacy": (drugs, brands, 2)}


MATCHED_SQL = f"""{HOSPITAL_SQL}, {PRESCRIPTIONS_SQL},
matched AS (
  SELECT person_id, date, code, name, 'hospital' AS source, 1 AS source_priority FROM hospital
  JOIN (VALUES ('urgent', '1-URGENT'), ('urgent', '2-HIGH'), ('minor', '5-LOW')) c(name, code) USING (code)
  UNION ALL
  SELECT person_id, date, code, name, 'pharmacy', 2 FROM prescriptions
  JOIN (VALUES ('urgent', 'Brand#4'), ('minor', 'Brand#5'), ('minor', 'Brand#6')) c(name, code) USING (code))"""


@query("codelist_match_all", f"WITH {MATCHED_SQL} SELECT person_id, date, code, name, source, CAST(source_priority AS INTEGER) AS source_priority FROM matched")
def codelist_match_all(spark, sf):
    return L.codelist_match(match_sources(spark, sf))


def _ranked_sql(direction: str) -> str:
    return f"""WITH {MATCHED_SQL} SELECT person_id, name, date, source, code FROM (
      SELECT *, row_number() OVER (PARTITION BY person_id, name ORDER BY date {direction}, source_priority, code) AS rn FROM matched) WHERE rn = 1"""


@query("codelist_match_first", _ranked_sql("ASC"))
def codelist_match_first(spark, sf):
    first = L.first_match(L.codelist_match(match_sources(spark, sf)), ["person_id", "name"])
    return first.select("person_id", "name", "date", "source", "code")


@query("codelist_match_last", _ranked_sql("DESC"))
def codelist_match_last(spark, sf):
    last = L.first_match(L.codelist_match(match_sources(spark, sf)), ["person_id", "name"], last=True)
    return last.select("person_id", "name", "date", "source", "code")


@query("codelist_match_wide", f"""
WITH {MATCHED_SQL}
SELECT person_id, max(CASE WHEN name = 'urgent' THEN 1 ELSE 0 END) AS out_urgent_flag, min(CASE WHEN name = 'urgent' THEN date END) AS out_urgent_date,
  max(CASE WHEN name = 'minor' THEN 1 ELSE 0 END) AS out_minor_flag, min(CASE WHEN name = 'minor' THEN date END) AS out_minor_date
FROM matched GROUP BY person_id""")
def codelist_match_wide(spark, sf):
    return L.match_wide(L.codelist_match(match_sources(spark, sf)), ["urgent", "minor"])


def _summary_sql(labels: str) -> str:
    return f"""WITH {MATCHED_SQL}
SELECT {labels}, source, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT person_id) AS n_people FROM matched GROUP BY {labels}, source
UNION ALL SELECT {labels}, 'all', CAST(count(*) AS BIGINT), count(DISTINCT person_id) FROM matched GROUP BY {labels}"""


@query("codelist_match_summary", _summary_sql("name"))
def codelist_match_summary(spark, sf):
    return L.match_summary(L.codelist_match(match_sources(spark, sf)))


@query("codelist_match_summary_codes", _summary_sql("name, code"))
def codelist_match_summary_codes(spark, sf):
    return L.match_summary(L.codelist_match(match_sources(spark, sf)), by_code=True)


# -- matching ----------------------------------------------------------------

STRICT = M.MatchRules(exact=("sex", "segment", "entry_year"), near="birth_year")
NO_CASES = M.MatchRules(exact=("sex", "segment", "entry_year"), near="birth_year", cases_as_controls=False)
LOOSE = M.MatchRules(exact=("sex", "segment"), near="birth_year")
SAME_BIRTH = M.MatchRules(exact=("sex", "segment", "birth_year"))
K, SEED = 10, 42


def _pairs_sql(cell: str, control: str = "TRUE") -> str:
    return f"""{COHORT_SQL},
cases AS (SELECT * FROM follow_up WHERE "case" = 1),
pairs AS (
  SELECT c.person_id AS case_id, n.person_id AS control_id, c.window_start AS c_start, c.window_end AS c_end,
         n.window_start AS n_start, n.window_end AS n_end, c.date AS index_date, c.source, c.code,
         row_number() OVER (PARTITION BY c.person_id ORDER BY n.follow_up_days DESC, n.person_id) AS pos
  FROM cases c JOIN follow_up n ON n.sex = c.sex AND n.segment = c.segment AND {cell}
   AND n.person_id <> c.person_id AND n.follow_up_days >= c.follow_up_days AND {control})"""


_NEAR = "abs(n.birth_year - c.birth_year) <= 1"
_STRICT = f"{_NEAR} AND n.entry_year = c.entry_year"
_COUNTS = "SELECT c.person_id, count(p.control_id) AS n_eligible FROM cases c LEFT JOIN pairs p ON p.case_id = c.person_id GROUP BY c.person_id"


@query("match_candidates", f"WITH {_pairs_sql(_STRICT)} {_COUNTS}")
def match_candidates(spark, sf):
    return M.eligible_counts(follow_up(spark, sf), STRICT)


@query("match_no_cases", f"""WITH {_pairs_sql(_STRICT, 'n."case" = 0')} {_COUNTS}""")
def match_no_cases(spark, sf):
    return M.eligible_counts(follow_up(spark, sf), NO_CASES)


@query("match_unmatched", f"WITH {_pairs_sql(_STRICT)} SELECT person_id FROM cases WHERE person_id NOT IN (SELECT case_id FROM pairs)")
def match_unmatched(spark, sf):
    return M.unmatched_cases(follow_up(spark, sf), STRICT)


def _hash_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


_DRAWS_SQL = f"""draws AS (
  SELECT case_id, n, greatest(n - {K}, 0) + 1 AS j, CAST([] AS BIGINT[]) AS taken FROM ranges
  UNION ALL
  SELECT case_id, n, j + 1, list_append(taken, CASE WHEN list_contains(taken, t) THEN j ELSE t END)
  FROM (SELECT *, 1 + {_hash_sql("'42'", 'case_id', 'j')} % j AS t FROM draws WHERE j <= n)),
picked AS (
  SELECT case_id, d, {_hash_sql("'42'", 'case_id', "'rank'", 'd')} AS h
  FROM (SELECT case_id, unnest(taken) AS d FROM draws WHERE j = n + 1))"""

SETS_SQL = f"""{_pairs_sql(_NEAR)},
ranges AS (SELECT case_id, count(*) AS n FROM pairs GROUP BY case_id),
{_DRAWS_SQL},
sampled AS (
  SELECT p.case_id, q.control_id, q.index_date, q.source, q.code, h / 1152921504606846976.0::DOUBLE AS random_num,
         CAST(row_number() OVER (PARTITION BY p.case_id ORDER BY h, d) AS INTEGER) AS control_rank
  FROM picked p JOIN pairs q ON q.case_id = p.case_id AND q.pos = p.d),
numbers AS (SELECT case_id, row_number() OVER (ORDER BY case_id) AS set FROM ranges),
sets AS (
  SELECT n.set, s.control_id AS person_id, 0 AS "case", s.index_date, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS code,
         CAST(random_num AS DOUBLE) AS random_num, control_rank FROM sampled s JOIN numbers n USING (case_id)
  UNION ALL
  SELECT n.set, c.person_id, 1, c.date, c.source, c.code, NULL, NULL FROM cases c JOIN numbers n ON n.case_id = c.person_id)"""


def matched(spark, sf) -> DataFrame:
    return M.matched_sets(follow_up(spark, sf), LOOSE, "date", K, SEED)


@query("matched_sets", f"""
WITH RECURSIVE {SETS_SQL} SELECT set, person_id, "case", index_date, source, code, round(random_num, 9) AS random_num, control_rank FROM sets""")
def matched_sets(spark, sf):
    return matched(spark, sf).withColumn("random_num", F.round("random_num", 9))


@query("set_size_distribution", f"""
WITH RECURSIVE {SETS_SQL}, per_set AS (SELECT set, count(*) FILTER (WHERE "case" = 0) AS num_controls FROM sets GROUP BY set)
SELECT num_controls, count(*) AS num_cases, round(count(*) * 100.0 / (SELECT count(*) FROM per_set), 6)::DOUBLE AS percentage FROM per_set GROUP BY num_controls""")
def set_size_distribution(spark, sf):
    return M.set_size_distribution(matched(spark, sf)).withColumn("percentage", F.round("percentage", 6))


@query("stratum_sizes", f"""
WITH {COHORT_SQL}
SELECT sex, segment, entry_year, CAST(sum("case") AS BIGINT) AS num_cases, CAST(sum(1 - "case") AS BIGINT) AS num_others,
       CAST(sum("case") > 0 AS INTEGER) AS has_case FROM (SELECT * REPLACE (CAST(entry_year AS INTEGER) AS entry_year) FROM follow_up) GROUP BY 1, 2, 3""")
def stratum_sizes(spark, sf):
    return M.stratum_sizes(follow_up(spark, sf), ["sex", "segment", "entry_year"])


@query("match_overlap", f"""
WITH RECURSIVE {_pairs_sql('n.birth_year = c.birth_year')},
overlapping AS (
  SELECT case_id, control_id, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS place FROM pairs
  WHERE n_start <= c_end AND n_end >= c_start AND n_start <= n_end AND c_start <= c_end),
ranges AS (SELECT case_id, count(*) AS n FROM overlapping GROUP BY case_id),
{_DRAWS_SQL}
SELECT p.case_id, control_id, CAST(row_number() OVER (PARTITION BY p.case_id ORDER BY h, d) AS INTEGER) AS control_rank
FROM picked p JOIN overlapping o ON o.case_id = p.case_id AND o.place = p.d""")
def match_overlap(spark, sf):
    return M.sample_overlapping(follow_up(spark, sf), SAME_BIRTH, "window_start", "window_end", K, SEED)


@query("dense_set_index", """
SELECT o_custkey, dense_rank() OVER (ORDER BY o_custkey) AS set FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def dense_set_index(spark, sf):
    return M.dense_index(table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'"), "o_custkey", "set")
