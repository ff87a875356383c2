"""Queries on look-back features, exposures, scores and the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import dates as D
from matchloom.functions import values as V
from matchloom.operators import assembly as A
from matchloom.operators import features as X
from matchloom.operators.asof import latest_in_window
from matchloom.plans.cohorts import SETS_SQL, matched
from matchloom.plans.registry import query
from matchloom.plans.roles import HOSPITAL_SQL, PEOPLE_SQL, PRESCRIPTIONS_SQL, born, hospital, people, prescriptions, table
from matchloom.session import cut_lineage, local_table

# Every urgent order is a set of its own here, so one person is in several
# sets, some of them with the same index date.


def members(spark, sf) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("set"), F.col("o_custkey").alias("person_id"), F.col("o_orderdate").cast("date").alias("index_date")
    )
    return urgent.join(born(spark, sf), "person_id")


MEMBERS_SQL = f"""{PEOPLE_SQL}, {HOSPITAL_SQL}, {PRESCRIPTIONS_SQL},
members AS (
  SELECT o_orderkey AS set, o_custkey AS person_id, CAST(o_orderdate AS DATE) AS index_date, birth_date, sex
  FROM orders JOIN people ON person_id = o_custkey WHERE o_orderpriority = '1-URGENT')"""


def measurements(spark, sf) -> DataFrame:
    return prescriptions(spark, sf).select("person_id", "date", F.col("kind").alias("code"), "value")


def drugs(spark, sf) -> DataFrame:
    return prescriptions(spark, sf).select("person_id", "date", "code", "value")


@query("lookback_window", f"""
WITH {MEMBERS_SQL}
SELECT set, person_id, CAST(index_date - INTERVAL 6 MONTH AS DATE) + 3 AS start_6, index_date - 1 AS end_6, birth_date AS start_all, index_date AS end_all FROM members""")
def lookback_window(spark, sf):
    a, b = D.lookback_window("index_date", 6, start_offset=3, end_offset=-1)
    c, d = D.lookback_window("index_date", None, birth_date="birth_date")
    return members(spark, sf).select(
        "set", "person_id", a.alias("start_6"), b.alias("end_6"), c.alias("start_all"), d.alias("end_all")
    )


@query("latest_in_window", f"""
WITH {MEMBERS_SQL}
SELECT set, person_id, date, code, value FROM (
  SELECT m.set, m.person_id, p.date, p.kind AS code, p.value,
         row_number() OVER (PARTITION BY m.set, m.person_id ORDER BY p.date DESC, p.kind, p.value) AS rn
  FROM members m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.date BETWEEN CAST(m.index_date - INTERVAL 24 MONTH AS DATE) AND m.index_date
  WHERE p.value BETWEEN 10 AND 40) WHERE rn = 1""")
def latest_in_window_query(spark, sf):
    valid = X.plausible(measurements(spark, sf), "value", 10, 40)
    window = D.lookback_window("index_date", 24)
    found = latest_in_window(members(spark, sf), valid, "person_id", window, "date", ["code", "value"])
    return found.select("set", "person_id", "date", "code", "value")


@query("range_filter", f"""
WITH {PRESCRIPTIONS_SQL}
SELECT kind, count(*) AS n, min(value) AS low, max(value) AS high FROM prescriptions WHERE value BETWEEN 10 AND 40 GROUP BY kind""")
def range_filter(spark, sf):
    kept = X.plausible(prescriptions(spark, sf), "value", 10, 40)
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("any_in_window", f"""
WITH {MEMBERS_SQL}
SELECT set, person_id, index_date, CASE WHEN
  EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = m.person_id AND h.code = '5-LOW'
          AND h.date BETWEEN CAST(m.index_date - INTERVAL 6 MONTH AS DATE) AND m.index_date - 1)
  OR EXISTS (SELECT 1 FROM prescriptions p WHERE p.person_id = m.person_id AND p.code = 'Brand#7'
          AND p.date BETWEEN CAST(m.index_date - INTERVAL 6 MONTH AS DATE) AND m.index_date - 1) THEN 1 END AS infected
FROM members m""")
def any_in_window(spark, sf):
    low = local_table(spark, [("infected", "5-LOW")], "name string, code string")
    brand = local_table(spark, [("infected", "Brand#7")], "name string, code string")
    sources = {"hospital": (hospital(spark, sf), low), "pharmacy": (drugs(spark, sf), brand)}
    out = X.any_in_window(members(spark, sf), sources, "infected", 6, end_offset=-1)
    return out.select("set", "person_id", "index_date", "infected")


@query("flag_with_offset", f"""
WITH {MEMBERS_SQL}
SELECT set, person_id,
  CASE WHEN EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = m.person_id AND h.code = '1-URGENT'
    AND h.date BETWEEN CAST(m.index_date - INTERVAL 6 MONTH AS DATE) AND m.index_date) THEN 1 END AS seen,
  CASE WHEN EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = m.person_id AND h.code = '1-URGENT'
    AND h.date BETWEEN CAST(m.index_date - INTERVAL 6 MONTH AS DATE) AND m.index_date - 1) THEN 1 END AS seen_offset
FROM members m""")
def flag_with_offset(spark, sf):
    codes = local_table(spark, [("urgent", "1-URGENT")], "name string, code string")
    flags = [X.Feature("seen", "urgent", ("hospital",), "flag", 6), X.Feature("seen_offset", "urgent", ("hospital",), "flag", 6, end_offset=-1)]
    out = X.feature_table(members(spark, sf), {"hospital": hospital(spark, sf)}, codes, flags)
    return out.select("set", "person_id", "seen", "seen_offset")


@query("persistent_low", f"""
WITH {MEMBERS_SQL}, spans AS (
  SELECT m.set, m.person_id, max(p.date) - min(p.date) AS days FROM members m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.date BETWEEN m.birth_date AND m.index_date WHERE p.value < 8 GROUP BY m.set, m.person_id)
SELECT m.set, m.person_id, CASE WHEN s.days >= 90 THEN 1 END AS chronic FROM members m LEFT JOIN spans s ON s.set = m.set AND s.person_id = m.person_id""")
def persistent_low(spark, sf):
    readings = measurements(spark, sf).select("person_id", "date", "value")
    return X.persistent_low(members(spark, sf), readings, 8, "chronic").select("set", "person_id", "chronic")


EXPOSURE_SQL = f"""{MEMBERS_SQL},
hits AS (
  SELECT m.set, m.person_id, m.index_date - p.date AS days FROM members m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.date BETWEEN CAST(m.index_date - INTERVAL 12 MONTH AS DATE) AND m.index_date
  WHERE substr(p.code, 1, 7) = 'Brand#2'),
exposure AS (
  SELECT set, person_id, max(CASE WHEN days <= 365 THEN 1 ELSE 0 END) AS exposed_12m, max(CASE WHEN days <= 90 THEN 1 ELSE 0 END) AS recent_3m,
    max(CASE WHEN days BETWEEN 92 AND 180 THEN 1 ELSE 0 END) AS recent_6m, max(CASE WHEN days BETWEEN 182 AND 365 THEN 1 ELSE 0 END) AS recent_12m
  FROM hits GROUP BY set, person_id)"""


def exposure_codes(spark, sf) -> DataFrame:
    from matchloom.operators.codelists import prefix_codelist
    from matchloom.plans.records import brand_labels

    return prefix_codelist(brand_labels(spark, sf), "exposure", "BRAND", ["Brand#2"])


def exposure(spark, sf, base: DataFrame) -> DataFrame:
    return X.exposure_recency(base, drugs(spark, sf), exposure_codes(spark, sf), "exposure")


@query("exposure_recency", f"WITH {EXPOSURE_SQL} SELECT * FROM exposure")
def exposure_recency(spark, sf):
    return exposure(spark, sf, members(spark, sf))


@query("exposure_group", f"""
WITH {EXPOSURE_SQL}
SELECT grouping, count(*) AS n FROM (
  SELECT CASE WHEN recent_3m = 1 AND (recent_6m = 1 OR recent_12m = 1) THEN 'both' WHEN recent_3m = 1 THEN 'recent_only'
              WHEN recent_6m = 1 OR recent_12m = 1 THEN 'non_recent_only' ELSE 'none' END AS grouping
  FROM members LEFT JOIN exposure USING (set, person_id)) GROUP BY grouping""")
def exposure_group(spark, sf):
    base = members(spark, sf)
    joined = base.join(exposure(spark, sf, base), ["set", "person_id"], "left")
    grouping = V.exposure_group("recent_3m", "recent_6m", "recent_12m").alias("grouping")
    return joined.select(grouping).groupBy("grouping").agg(F.count(F.lit(1)).alias("n"))


CLASSES = {"statin": ["Brand#10", "Brand#11"], "diuretic": ["Brand#12"], "steroid": ["Brand#13", "Brand#14"]}


def class_codes(spark) -> DataFrame:
    return local_table(spark, [(n, c) for n, cs in CLASSES.items() for c in cs], "name string, code string")


@query("class_flags_pivot", f"""
WITH {MEMBERS_SQL}, hits AS (
  SELECT DISTINCT m.set, m.person_id, c.name FROM members m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.date BETWEEN CAST(m.index_date - INTERVAL 12 MONTH AS DATE) AND m.index_date AND m.index_date - p.date <= 365
  JOIN (VALUES {', '.join(f"('{n}', '{c}')" for n, cs in CLASSES.items() for c in cs)}) c(name, code) ON c.code = p.code)
SELECT set, person_id, {', '.join(f"max(CASE WHEN name = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in CLASSES)} FROM hits GROUP BY set, person_id""")
def class_flags_pivot(spark, sf):
    return X.class_flags(members(spark, sf), drugs(spark, sf), class_codes(spark), list(CLASSES))


FEATURES = [
    X.Feature("last_small", "small", ("lab",), "latest", 36, low=5, high=45),
    X.Feature("last_large", "large", ("lab",), "latest", 24, low=10),
    X.Feature("low_score", "any_kind", ("lab",), "span", None, below=6),
    X.Feature("admitted", "admission", ("hospital",), "flag", 6, end_offset=-1, fill=0),
    X.Feature("statin", "statin", ("pharmacy",), "flag", 12, max_days=365, fill=0),
    X.Feature("any_source", "mixed", ("hospital", "pharmacy"), "flag", 3),
]
FEATURE_CODES = [
    ("small", "SMALL"), ("large", "LARGE"), ("large", "MEDIUM"), ("admission", "2-HIGH"), ("statin", "Brand#10"),
    ("statin", "Brand#11"), ("mixed", "3-MEDIUM"), ("mixed", "Brand#9"),
    *[("any_kind", k) for k in ("SMALL", "LARGE", "MEDIUM", "STANDARD", "ECONOMY", "PROMO")],
]


def features(spark, sf, base: DataFrame) -> DataFrame:
    codes = local_table(spark, FEATURE_CODES, "name string, code string")
    given = prescriptions(spark, sf)
    records = {"hospital": X.Source(hospital(spark, sf)), "pharmacy": X.Source(given), "lab": X.Source(given, code="kind")}
    return X.feature_table(base, records, codes, FEATURES)


def _features_sql(base: str) -> str:
    def latest(name, kinds, months, test):
        return f"""{name} AS (SELECT set, person_id, value AS {name} FROM (
          SELECT m.set, m.person_id, p.value, row_number() OVER (PARTITION BY m.set, m.person_id ORDER BY p.date DESC, p.kind, p.value) AS rn
          FROM {base} m JOIN prescriptions p ON p.person_id = m.person_id AND p.kind IN ({kinds}) AND {test}
           AND p.date BETWEEN CAST(m.index_date - INTERVAL {months} MONTH AS DATE) AND m.index_date) WHERE rn = 1)"""

    within = "AND {a}.date BETWEEN CAST(m.index_date - INTERVAL {months} MONTH AS DATE) AND m.index_date"
    hospital_hit = "EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = m.person_id AND h.code = '{code}' " + within.format(a="h", months="{months}") + "{off})"
    drug_hit = "EXISTS (SELECT 1 FROM prescriptions p WHERE p.person_id = m.person_id AND p.code IN ({codes}) " + within.format(a="p", months="{months}") + "{extra})"
    return f"""{latest('last_small', "'SMALL'", 36, 'p.value BETWEEN 5 AND 45')},
{latest('last_large', "'LARGE', 'MEDIUM'", 24, 'p.value >= 10')},
spans AS (SELECT m.set, m.person_id, max(p.date) - min(p.date) AS days FROM {base} m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.value < 6 AND p.date BETWEEN m.birth_date AND m.index_date GROUP BY m.set, m.person_id),
features AS (
  SELECT m.*, a.last_small, b.last_large, CASE WHEN s.days >= 90 THEN 1 END AS low_score,
    CASE WHEN {hospital_hit.format(code='2-HIGH', months=6, off=' - 1')} THEN 1 ELSE 0 END AS admitted,
    CASE WHEN {drug_hit.format(codes="'Brand#10', 'Brand#11'", months=12, extra=' AND m.index_date - p.date <= 365')} THEN 1 ELSE 0 END AS statin,
    CASE WHEN {hospital_hit.format(code='3-MEDIUM', months=3, off='')} OR {drug_hit.format(codes="'Brand#9'", months=3, extra='')} THEN 1 END AS any_source
  FROM {base} m LEFT JOIN last_small a ON a.set = m.set AND a.person_id = m.person_id
  LEFT JOIN last_large b ON b.set = m.set AND b.person_id = m.person_id
  LEFT JOIN spans s ON s.set = m.set AND s.person_id = m.person_id)"""


FEATURES_SQL = f"{MEMBERS_SQL}, {_features_sql('members')}"
FEATURE_NAMES = [f.name for f in FEATURES]


@query("feature_table", f"WITH {FEATURES_SQL} SELECT set, person_id, index_date, {', '.join(FEATURE_NAMES)} FROM features")
def feature_table(spark, sf):
    return features(spark, sf, members(spark, sf)).select("set", "person_id", "index_date", *FEATURE_NAMES)


def analysis(spark, sf) -> DataFrame:
    """Matched sets with demographics, features and exposure flags."""
    sets = cut_lineage(matched(spark, sf))
    person = people(spark, sf).select("person_id", "birth_date", "sex", "segment", "nation_key", "entry_date")
    base = cut_lineage(sets.join(person.select("person_id", "birth_date"), "person_id"))
    feature = features(spark, sf, base).select("person_id", "set", *FEATURE_NAMES)
    exposed = exposure(spark, sf, base)
    flags = [c for c in exposed.columns if c not in ("person_id", "set")]
    return A.analysis_table(sets, person, [feature, exposed], zero_flags=["low_score", "any_source", *flags])


_ANALYSIS_COLUMNS = (
    "set, person_id, \"case\", index_date, sex, segment, birth_date, last_small, last_large, low_score, admitted, statin, any_source, "
    "exposed_12m, recent_3m, recent_6m, recent_12m"
)


@query("analysis_table", f"""
WITH RECURSIVE {SETS_SQL}, {PRESCRIPTIONS_SQL},
based AS (SELECT s.*, p.birth_date, p.sex, p.segment FROM sets s JOIN people p ON p.person_id = s.person_id),
{_features_sql('based')},
hits AS (
  SELECT m.set, m.person_id, m.index_date - p.date AS days FROM based m JOIN prescriptions p ON p.person_id = m.person_id
   AND p.date BETWEEN CAST(m.index_date - INTERVAL 12 MONTH AS DATE) AND m.index_date WHERE substr(p.code, 1, 7) = 'Brand#2'),
exposure AS (
  SELECT set, person_id, max(CASE WHEN days <= 365 THEN 1 ELSE 0 END) AS exposed_12m, max(CASE WHEN days <= 90 THEN 1 ELSE 0 END) AS recent_3m,
    max(CASE WHEN days BETWEEN 92 AND 180 THEN 1 ELSE 0 END) AS recent_6m, max(CASE WHEN days BETWEEN 182 AND 365 THEN 1 ELSE 0 END) AS recent_12m
  FROM hits GROUP BY set, person_id)
SELECT f.set, f.person_id, f."case", f.index_date, f.sex, f.segment, f.birth_date, f.last_small, f.last_large, coalesce(f.low_score, 0) AS low_score,
  f.admitted, f.statin, coalesce(f.any_source, 0) AS any_source, coalesce(e.exposed_12m, 0) AS exposed_12m, coalesce(e.recent_3m, 0) AS recent_3m,
  coalesce(e.recent_6m, 0) AS recent_6m, coalesce(e.recent_12m, 0) AS recent_12m
FROM features f LEFT JOIN exposure e ON e.set = f.set AND e.person_id = f.person_id""")
def analysis_table(spark, sf):
    return analysis(spark, sf).select(*[c.strip().strip('"') for c in _ANALYSIS_COLUMNS.split(",")])


@query("reference_level_dummies", """
SELECT c_custkey, """ + ", ".join(
    f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"c_mktsegment_{s}\"" for s in ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")
) + " FROM customer")
def reference_level_dummies(spark, sf):
    levels = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    df, names = A.with_dummies(table(spark, sf, "customer"), {"c_mktsegment": (levels, "BUILDING")})
    return df.select("c_custkey", *names)


# -- scores and bands --------------------------------------------------------


@query("egfr_score", f"""
WITH {PEOPLE_SQL}, {PRESCRIPTIONS_SQL},
scored AS (
  SELECT r.person_id, r.date, r.code, r.value * 12 AS creatinine, p.sex,
    CAST(floor((r.date - p.birth_date) / 365.25) AS INTEGER) AS age,
    r.value * 12 / 88.4::DOUBLE / CASE WHEN p.sex = 'F' THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS ratio
  FROM prescriptions r JOIN people p ON p.person_id = r.person_id WHERE r.kind = 'SMALL' AND r.value * 12 >= 20 AND r.value * 12 < 1000)
SELECT person_id, date, code, creatinine, age, round(142 * pow(least(ratio, 1.0::DOUBLE), CASE WHEN sex = 'F' THEN -0.241::DOUBLE ELSE -0.302::DOUBLE END)
  * pow(greatest(ratio, 1.0::DOUBLE), -1.2::DOUBLE) * pow(0.9938::DOUBLE, age) * CASE WHEN sex = 'F' THEN 1.012::DOUBLE ELSE 1.0::DOUBLE END, 0) AS egfr
FROM scored""")
def egfr_score(spark, sf):
    scored = (
        prescriptions(spark, sf)
        .where(F.col("kind") == "SMALL")
        .withColumn("creatinine", F.col("value") * 12)
        .where(V.in_range("creatinine", 20) & (F.col("creatinine") < 1000))
        .join(people(spark, sf).select("person_id", "birth_date", "sex"), "person_id")
        .withColumn("age", D.age_years("birth_date", "date"))
    )
    return scored.select("person_id", "date", "code", "creatinine", "age", V.ckd_epi_2021("creatinine", "sex", "age").alias("egfr"))


@query("age_years", f"""
WITH {PEOPLE_SQL} SELECT person_id, CAST(floor((entry_date - birth_date) / 365.25) AS INTEGER) AS age FROM people""")
def age_years(spark, sf):
    return people(spark, sf).select("person_id", D.age_years("birth_date", "entry_date").alias("age"))


@query("years_since", f"""
WITH {PEOPLE_SQL}
SELECT person_id, round(CAST(DATE '1998-12-31' - entry_date AS DOUBLE) / 365.25, 6) AS years FROM people""")
def years_since(spark, sf):
    return people(spark, sf).select(
        "person_id", F.round(D.years_since("entry_date", F.to_date(F.lit("1998-12-31"))), 6).alias("years")
    )


def _band_sql(column: str, gaps: bool) -> str:
    cases = []
    for group, rows in V.BMI_BANDS.items():
        for i, (label, low, high) in enumerate(rows):
            if gaps:
                test = " AND ".join([f"bmi >= {low}"] * (low is not None) + [f"bmi <= {high}"] * (high is not None))
            else:
                test = f"bmi < {rows[i + 1][1]}" if i + 1 < len(rows) else "TRUE"
            cases.append(f"WHEN grp = {group} AND {test} THEN '{label}'")
    return f"CASE WHEN bmi IS NULL OR grp IS NULL THEN NULL {' '.join(cases)} END AS {column}"


@query("banded_by_group", f"""
WITH bmi AS (
  SELECT l_orderkey, l_linenumber, CAST(round(l_quantity * 0.95 + l_tax * 10, 2) AS DOUBLE) AS bmi,
    CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 3 = 1 THEN 1 ELSE 2 END AS grp FROM lineitem)
SELECT l_orderkey, l_linenumber, bmi, {_band_sql('band', False)}, {_band_sql('band_gaps', True)} FROM bmi""")
def banded_by_group(spark, sf):
    group = F.when(F.col("l_linenumber") % 3 == 1, 1).when(F.col("l_linenumber") % 3 == 2, 2)
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.col("l_quantity") * 0.95 + F.col("l_tax") * 10, 2).alias("bmi"), group.alias("grp")
    )
    return df.select(
        "l_orderkey", "l_linenumber", "bmi", V.band_by_group("bmi", "grp").alias("band"), V.band_by_group("bmi", "grp", gaps=True).alias("band_gaps")
    )


BREAKS = [float("-inf"), 10.0, 20.0, 30.0, 40.0, float("inf")]
LABELS = ["under 10", "10-19", "20-29", "30-39", "40 and over"]


@query("binned", """
SELECT l_orderkey, l_linenumber, CASE WHEN q < 10 THEN 'under 10' WHEN q < 20 THEN '10-19' WHEN q < 30 THEN '20-29' WHEN q < 40 THEN '30-39'
  WHEN q >= 40 THEN '40 and over' END AS band FROM (SELECT l_orderkey, l_linenumber, nullif(l_quantity, 50) AS q FROM lineitem)""")
def binned(spark, sf):
    value = F.nullif("l_quantity", F.lit(50.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.binned(value, BREAKS, LABELS).alias("band"))


@query("safe_cast", """
SELECT l_orderkey, l_linenumber, TRY_CAST(raw AS DOUBLE) AS number, CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INTEGER) AS whole FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 THEN 'unknown' WHEN l_linenumber = 4 THEN '' ELSE CAST(l_discount * 100 + 0.5 AS VARCHAR) END AS raw FROM lineitem)""")
def safe_cast(spark, sf):
    raw = F.when(F.col("l_linenumber") == 3, "unknown").when(F.col("l_linenumber") == 4, "").otherwise((F.col("l_discount") * 100 + 0.5).cast("string"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", V.safe_number(raw).alias("number"), V.safe_number(raw, whole=True).alias("whole")
    )


@query("zero_filled_flags", """
SELECT c_custkey, CASE WHEN flagged = 1 THEN 1 ELSE 0 END AS flagged, coalesce(n_orders, 0) AS n_orders FROM customer LEFT JOIN (
  SELECT o_custkey, max(CASE WHEN o_totalprice > 450000 THEN 1 END) AS flagged, count(*) AS n_orders FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def zero_filled_flags(spark, sf):
    flags = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max(F.when(F.col("o_totalprice") > 450000, 1)).alias("flagged"), F.count(F.lit(1)).alias("n_orders")
    )
    joined = table(spark, sf, "customer").select("c_custkey").join(flags, "c_custkey", "left")
    return joined.na.fill(0, ["n_orders"]).withColumn("flagged", V.one_or_zero("flagged"))
