"""Queries on sources, snapshots, code lists and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import codes as C
from matchloom.functions import dates as D
from matchloom.functions import values as V
from matchloom.operators import codelists as L
from matchloom.operators import joins as J
from matchloom.operators import reshape as R
from matchloom.operators.ranking import first_rows
from matchloom.plans.registry import query
from matchloom.plans.roles import (
    HOSPITAL_SQL,
    PEOPLE_SQL,
    PRESCRIPTIONS_SQL,
    hospital,
    people,
    prescriptions,
    table,
)
from matchloom.session import local_table
from matchloom.sources import snapshots as S

# -- snapshots: the order year is the batch --------------------------------


def archive(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").withColumn("archived_on", F.year("o_orderdate"))


ARCHIVE_SQL = "archive AS (SELECT *, CAST(year(o_orderdate) AS INTEGER) AS archived_on FROM orders)"


@query("latest_snapshot", f"""
WITH {ARCHIVE_SQL}
SELECT archived_on, count(*) AS n, format('{{:,}}', count(*)) AS n_text
FROM archive WHERE archived_on <= 1999 GROUP BY archived_on ORDER BY archived_on DESC LIMIT 1""")
def latest_snapshot(spark, sf):
    return S.latest_snapshot(archive(spark, sf), 1999).withColumn("n_text", V.with_thousands("n"))


@query("first_snapshot_after", f"""
WITH {ARCHIVE_SQL}
SELECT archived_on, count(*) AS n FROM archive WHERE archived_on >= 1997 GROUP BY archived_on ORDER BY archived_on LIMIT 1""")
def first_snapshot_after(spark, sf):
    return S.first_snapshot_after(archive(spark, sf), 1997)


def _archives(spark, sf):
    ship = table(spark, sf, "lineitem").withColumn("archived_on", F.year("l_shipdate"))
    return {"orders": archive(spark, sf), "lineitem": ship}


def _registry(spark, sf):
    rows = [(0, "orders", "o_orderkey"), (1, "lineitem", "l_orderkey")]
    registry = local_table(spark, rows, "index int, dataset string, id string")
    return S.snapshot_registry(registry, _archives(spark, sf), 2000)


@query("snapshot_registry", f"""
WITH {ARCHIVE_SQL}, ship AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS archived_on FROM lineitem),
pinned AS (
  (SELECT 'orders' AS dataset, archived_on, count(*) AS n FROM archive WHERE archived_on <= 2000 GROUP BY 2 ORDER BY 2 DESC LIMIT 1)
  UNION ALL
  (SELECT 'lineitem', archived_on, count(*) FROM ship WHERE archived_on <= 2000 GROUP BY 2 ORDER BY 2 DESC LIMIT 1))
SELECT r.index, r.dataset, r.id, p.archived_on, p.n
FROM (VALUES (0, 'orders', 'o_orderkey'), (1, 'lineitem', 'l_orderkey')) r(index, dataset, id) JOIN pinned p USING (dataset)""")
def snapshot_registry(spark, sf):
    return _registry(spark, sf)


@query("read_snapshot", f"""
WITH {ARCHIVE_SQL}
SELECT o_orderkey, o_custkey, archived_on FROM archive WHERE archived_on = 2000""")
def read_snapshot(spark, sf):
    batch = S.read_snapshot(_registry(spark, sf), archive(spark, sf), "orders")
    return batch.select("o_orderkey", "o_custkey", "archived_on")


# -- code lists --------------------------------------------------------------


def brand_labels(spark, sf) -> DataFrame:
    return L.code_labels(table(spark, sf, "part"), "p_brand", "p_name")


LABELS_SQL = "labels_b AS (SELECT p_brand AS code, min(p_name) AS term FROM part GROUP BY p_brand)"


@query("code_labels", f"WITH {LABELS_SQL} SELECT code, term FROM labels_b")
def code_labels(spark, sf):
    return brand_labels(spark, sf)


@query("literal_codelist", """
SELECT c.name, c.terminology, c.code, c.term, count(*) AS n_records
FROM (VALUES ('urgent', 'PRIORITY', '1-URGENT', 'Urgent'), ('urgent', 'PRIORITY', '2-HIGH', 'High'),
             ('calm', 'PRIORITY', '5-LOW', 'Low')) c(name, terminology, code, term)
JOIN orders ON o_orderpriority = c.code GROUP BY 1, 2, 3, 4""")
def literal_codelist(spark, sf):
    rows = [("urgent", "PRIORITY", "1-URGENT", "Urgent"), ("urgent", "PRIORITY", "2-HIGH", "High"), ("calm", "PRIORITY", "5-LOW", "Low")]
    codes = L.literal_codelist(spark, rows)
    matched = J.values_by_code(hospital(spark, sf), codes)
    return matched.groupBy("name", "terminology", "code", "term").agg(F.count(F.lit(1)).alias("n_records"))


@query("codelist_prefix", f"""
WITH {LABELS_SQL}
SELECT 'early' AS name, 'BRAND' AS terminology, code, term FROM labels_b WHERE substr(code, 1, 7) IN ('Brand#1', 'Brand#3')""")
def codelist_prefix(spark, sf):
    return L.prefix_codelist(brand_labels(spark, sf), "early", "BRAND", ["Brand#1", "Brand#3"])


@query("codelist_prefix_exclude", f"""
WITH {LABELS_SQL}
SELECT 'early' AS name, 'BRAND' AS terminology, code, term FROM labels_b
WHERE (substr(code, 1, 7) = 'Brand#1' OR substr(code, 1, 8) = 'Brand#24') AND NOT substr(code, 1, 8) IN ('Brand#12', 'Brand#13')""")
def codelist_prefix_exclude(spark, sf):
    return L.prefix_codelist(brand_labels(spark, sf), "early", "BRAND", ["Brand#1", "Brand#24"], ["Brand#12", "Brand#13"])


@query("codelist_union_class", f"""
WITH {LABELS_SQL}
SELECT name, 'BRAND' AS terminology, code, term FROM labels_b JOIN
 (VALUES ('first', 'Brand#1'), ('second', 'Brand#2'), ('either', 'Brand#1'), ('either', 'Brand#2')) r(name, prefix)
 ON substr(code, 1, 7) = prefix""")
def codelist_union_class(spark, sf):
    labels, a, b = brand_labels(spark, sf), ["Brand#1"], ["Brand#2"]
    lists = [L.prefix_codelist(labels, n, "BRAND", p) for n, p in (("first", a), ("second", b), ("either", a + b))]
    return L.harmonised_union(lists)


@query("codelist_harmonised_union", f"""
WITH {LABELS_SQL}
SELECT 'brand' AS name, 'BRAND' AS terminology, code, term, CAST(NULL AS INTEGER) AS n_sizes FROM labels_b
UNION ALL
SELECT 'type', 'TYPE', p_type, CAST(NULL AS VARCHAR), CAST(count(DISTINCT p_size) AS INTEGER) FROM part GROUP BY p_type""")
def codelist_harmonised_union(spark, sf):
    brands = L.prefix_codelist(brand_labels(spark, sf), "brand", "BRAND", ["Brand#"])
    sizes = table(spark, sf, "part").select("p_type", "p_size").distinct()
    types = sizes.groupBy(F.col("p_type").alias("code")).agg(F.count("p_size").cast("int").alias("n_sizes"))
    types = types.select(F.lit("type").alias("name"), F.lit("TYPE").alias("terminology"), "code", "n_sizes")
    return L.harmonised_union([brands, types])


RAW_CODE_SQL = """CASE WHEN p_partkey % 11 = 0 THEN NULL
  WHEN p_partkey % 7 = 0 THEN 'A' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.X'
  WHEN p_partkey % 5 = 0 THEN 'E' || CAST(p_size AS VARCHAR) || '-' || CAST(p_partkey % 10 AS VARCHAR)
  WHEN p_partkey % 3 = 0 THEN 'J' || lpad(CAST(p_size AS VARCHAR), 2, '0') || ' .' || CAST(p_partkey % 10 AS VARCHAR)
  ELSE 'M' || lpad(CAST(p_size AS VARCHAR), 2, '0') || CAST(p_partkey % 10 AS VARCHAR) END"""


def raw_code():
    """Untidy code of a part, in several spellings."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    digit, two = (key % 10).cast("string"), F.lpad(size, 2, "0")
    return (
        F.when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 7 == 0, F.concat(F.lit("A"), two, F.lit(".X")))
        .when(key % 5 == 0, F.concat(F.lit("E"), size, F.lit("-"), digit))
        .when(key % 3 == 0, F.concat(F.lit("J"), two, F.lit(" ."), digit))
        .otherwise(F.concat(F.lit("M"), two, digit))
    )


CLEAN = "regexp_replace(regexp_replace({}, 'X$', ''), '[.,\\-\\s]', '', 'g')"


@query("code_cleanup", f"""
WITH raw AS (SELECT p_partkey, {RAW_CODE_SQL} AS raw FROM part)
SELECT p_partkey, {CLEAN.format('raw')} AS code, substr({CLEAN.format('raw')}, 1, 3) AS parent,
       CAST(length({CLEAN.format('raw')}) AS INTEGER) AS code_length FROM raw""")
def code_cleanup(spark, sf):
    cleaned = table(spark, sf, "part").select("p_partkey", C.clean_code(raw_code()).alias("code"))
    return cleaned.select("p_partkey", "code", C.parent_code("code").alias("parent"), F.length("code").alias("code_length"))


@query("code_cleanup_changed", f"""
WITH raw AS (SELECT p_partkey, {RAW_CODE_SQL} AS raw, CASE WHEN p_partkey % 2 = 0 THEN 'ICD10' ELSE 'SNOMED' END AS terminology FROM part),
clean AS (SELECT *, CASE WHEN terminology = 'ICD10' THEN {CLEAN.format('raw')} ELSE raw END AS code FROM raw)
SELECT p_partkey, terminology, code, CAST(code IS DISTINCT FROM raw AS INTEGER) AS changed FROM clean""")
def code_cleanup_changed(spark, sf):
    kind = F.when(F.col("p_partkey") % 2 == 0, "ICD10").otherwise("SNOMED")
    raw = table(spark, sf, "part").select("p_partkey", kind.alias("terminology"), raw_code().alias("code"))
    return L.clean_codelist(raw, changed="changed")


@query("codelist_build", f"""
WITH raw AS (SELECT DISTINCT {RAW_CODE_SQL} AS raw FROM part),
{LABELS_SQL}, joined AS (
  SELECT 'parts' AS name, 'ICD10' AS terminology, {CLEAN.format('raw')} AS code, CAST(NULL AS VARCHAR) AS term FROM raw WHERE raw IS NOT NULL
  UNION ALL SELECT 'brands', 'BRAND', code, term FROM labels_b)
SELECT * FROM joined WHERE code NOT IN ('Brand#7', 'M010')""")
def codelist_build(spark, sf):
    raw = table(spark, sf, "part").select(raw_code().alias("code")).where(V.not_blank("code")).distinct()
    parts = raw.select(F.lit("parts").alias("name"), F.lit("ICD10").alias("terminology"), "code")
    brands = L.prefix_codelist(brand_labels(spark, sf), "brands", "BRAND", ["Brand#"])
    dropped = local_table(spark, [("Brand#7",), ("M010",)], "code string")
    return L.build_codelist([parts, brands], excluded=dropped).select("name", "terminology", "code", "term")


@query("codelist_checks", """
WITH codes AS (
  SELECT DISTINCT 'supplier_parts' AS name, CAST(l_suppkey * 1000000000 + 1000000000000 AS VARCHAR) AS code FROM lineitem
  UNION ALL SELECT DISTINCT 'part_parts', CAST(l_partkey * 1000000001 AS VARCHAR) FROM lineitem)
SELECT name, code FROM codes WHERE length(code) >= 13 AND code LIKE '%000000000'""")
def codelist_checks(spark, sf):
    items = table(spark, sf, "lineitem")
    rounded = items.select(F.lit("supplier_parts").alias("name"), (F.col("l_suppkey") * 1000000000 + 1000000000000).cast("string").alias("code"))
    whole = items.select(F.lit("part_parts").alias("name"), (F.col("l_partkey") * 1000000001).cast("string").alias("code"))
    return L.suspicious_codes(rounded.distinct().unionByName(whole.distinct()))


@query("codelist_overlap", """
WITH codes AS (SELECT DISTINCT p_type AS name, p_brand AS code FROM part)
SELECT code, string_agg(name, ',' ORDER BY name) AS names FROM codes GROUP BY code HAVING count(*) > 1""")
def codelist_overlap(spark, sf):
    codes = table(spark, sf, "part").select(F.col("p_type").alias("name"), F.col("p_brand").alias("code"))
    return L.codelist_overlap(codes.distinct()).withColumn("names", F.concat_ws(",", "names"))


@query("prefix_problems", """
SELECT prefix, CAST(0 AS BIGINT) AS n_codes FROM (VALUES ('Brand#1'), ('Brand#9'), ('ring'), ('Brand#77')) p(prefix)
WHERE NOT EXISTS (SELECT 1 FROM part WHERE substr(p_brand, 1, length(prefix)) = prefix)""")
def prefix_problems(spark, sf):
    return L.prefix_problems(brand_labels(spark, sf), ["Brand#1", "Brand#9", "ring", "Brand#77"])


@query("code_semi_join", f"""
WITH {HOSPITAL_SQL} SELECT person_id, date, code FROM hospital WHERE code IN ('1-URGENT', '3-MEDIUM')""")
def code_semi_join(spark, sf):
    codes = local_table(spark, [("1-URGENT",), ("3-MEDIUM",), ("9-NONE",)], "code string")
    return J.keep_codes(hospital(spark, sf), codes).select("person_id", "date", "code")


@query("code_exclusion", f"""
WITH {PRESCRIPTIONS_SQL} SELECT person_id, date, code, value FROM prescriptions WHERE code NOT IN ('Brand#3', 'Brand#14')""")
def code_exclusion(spark, sf):
    codes = local_table(spark, [("Brand#3",), ("Brand#14",)], "code string")
    return J.drop_codes(prescriptions(spark, sf), codes).select("person_id", "date", "code", "value")


@query("anti_join_people", f"""
WITH {PEOPLE_SQL}, {HOSPITAL_SQL}
SELECT p.person_id, p.sex, p.segment FROM people p
WHERE NOT EXISTS (SELECT 1 FROM hospital h WHERE h.person_id = p.person_id AND h.code = '1-URGENT')""")
def anti_join_people(spark, sf):
    urgent = hospital(spark, sf).where(F.col("code") == "1-URGENT")
    return J.exclude_people(people(spark, sf), urgent).select("person_id", "sex", "segment")


@query("values_by_code", f"""
WITH {PRESCRIPTIONS_SQL}
SELECT p.person_id, p.date, p.code, p.value, c.unit FROM prescriptions p
JOIN (VALUES ('Brand#2', 'mg'), ('Brand#5', 'ml')) c(code, unit) ON c.code = p.code""")
def values_by_code(spark, sf):
    codes = local_table(spark, [("Brand#2", "mg"), ("Brand#5", "ml")], "code string, unit string")
    return J.values_by_code(prescriptions(spark, sf), codes).select("person_id", "date", "code", "value", "unit")


# -- reshaping ---------------------------------------------------------------


@query("wide_to_long", """
SELECT l_orderkey, l_linenumber, pos AS position, amount FROM (
  SELECT l_orderkey, l_linenumber, l_quantity AS "QUANTITY", l_tax AS "TAX", l_discount AS "DISCOUNT" FROM lineitem)
UNPIVOT INCLUDE NULLS (amount FOR pos IN ("QUANTITY", "TAX", "DISCOUNT"))""")
def wide_to_long(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_quantity").alias("amount_QUANTITY"), F.col("l_tax").alias("amount_TAX"), F.col("l_discount").alias("amount_DISCOUNT"),
    )
    long = R.wide_to_long(wide, ["l_orderkey", "l_linenumber"], "position", "amount_")
    return long.withColumnRenamed("amount_", "amount")


@query("wide_to_long_multi", """
SELECT l_orderkey, l_linenumber, '01' AS position, l_returnflag AS flag, l_quantity AS amount FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, '02', l_linestatus, l_tax FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, '03', NULL, l_discount FROM lineitem""")
def wide_to_long_multi(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("flag_01"), F.col("l_linestatus").alias("flag_02"),
        F.col("l_quantity").alias("amount_01"), F.col("l_tax").alias("amount_02"), F.col("l_discount").alias("amount_03"),
    )
    long = R.wide_to_long_multi(wide, ["l_orderkey", "l_linenumber"], "position", ["flag_", "amount_"])
    return long.withColumnsRenamed({"flag_": "flag", "amount_": "amount"})


def wide_record(spark, sf, stub: str) -> DataFrame:
    """A part as an episode with two coded positions of 3 and 4 characters."""
    second = F.when(F.col("p_size") > 40, F.concat(F.upper(F.substring("p_type", 1, 3)), (F.col("p_size") % 10).cast("string")))
    return (
        table(spark, sf, "part")
        .withColumn(f"{stub}_4_01", raw_code())
        .withColumn(f"{stub}_4_02", second)
        .withColumn(f"{stub}_3_01", F.substring(f"{stub}_4_01", 1, 3))
        .withColumn(f"{stub}_3_02", F.when(F.col("p_size") % 2 == 0, F.substring(f"{stub}_4_02", 1, 3)))
    )


WIDE_SQL = f"""
wide AS (SELECT *, substr(d401, 1, 3) AS d301, CASE WHEN p_size % 2 = 0 THEN substr(d402, 1, 3) END AS d302 FROM (
  SELECT p_partkey, p_size, {RAW_CODE_SQL} AS d401,
    CASE WHEN p_size > 40 THEN upper(substr(p_type, 1, 3)) || CAST(p_size % 10 AS VARCHAR) END AS d402 FROM part)),
long AS (
  SELECT p_partkey, '1' AS position, '3' AS digits, {CLEAN.format('d301')} AS code FROM wide
  UNION ALL SELECT p_partkey, '1', '4', {CLEAN.format('d401')} FROM wide
  UNION ALL SELECT p_partkey, '2', '3', {CLEAN.format('d302')} FROM wide
  UNION ALL SELECT p_partkey, '2', '4', {CLEAN.format('d402')} FROM wide),
kept AS (SELECT * FROM long WHERE code IS NOT NULL AND code <> '')"""


@query("diagnosis_long", f"WITH {WIDE_SQL} SELECT p_partkey, position AS diag_position, digits AS diag_digits, code FROM kept")
def diagnosis_long(spark, sf):
    wide = R.select_matching(wide_record(spark, sf, "diag"), ["p_partkey"], r"diag_(3|4)_\d\d")
    return R.diagnosis_long(wide, ["p_partkey"])


@query("operations_long", f"WITH {WIDE_SQL} SELECT p_partkey, position AS opertn_position, digits AS opertn_digits, code FROM kept")
def operations_long(spark, sf):
    wide = R.select_matching(wide_record(spark, sf, "opertn"), ["p_partkey"], r"opertn_(3|4)_\d\d")
    return R.operations_long(wide, ["p_partkey"])


@query("code_consistency", f"""
WITH {WIDE_SQL}, pairs AS (
  SELECT p_partkey, '01' AS position, d301 AS c3, d401 AS c4 FROM wide UNION ALL SELECT p_partkey, '02', d302, d402 FROM wide)
SELECT p_partkey, position, CAST(c3 IS NOT DISTINCT FROM substr(c4, 1, 3) AS INTEGER) AS same_parent,
       CASE WHEN length(c4) > 4 THEN 0 ELSE 1 END AS length_ok FROM pairs""")
def code_consistency(spark, sf):
    return R.code_consistency(wide_record(spark, sf, "diag"), ["p_partkey"], "diag_3_", "diag_4_")


@query("digits_pivot_check", f"""
WITH {WIDE_SQL}
SELECT a.p_partkey, a.position, a.code AS code_3, b.code AS code_4 FROM kept a JOIN kept b
ON a.p_partkey = b.p_partkey AND a.position = b.position AND a.digits = '3' AND b.digits = '4'
WHERE substr(b.code, 1, 3) <> a.code""")
def digits_pivot_check(spark, sf):
    long = R.codes_long(wide_record(spark, sf, "diag"), ["p_partkey"], "diag_3_", "diag_4_")
    return R.digits_mismatch(long, ["p_partkey"])


@query("operation_dates_long", """
WITH ops AS (
  SELECT l_orderkey, '01' AS position, CAST(l_shipdate AS DATE) AS opdate_, CASE WHEN l_returnflag = 'R' THEN '-' ELSE l_returnflag END AS opertn_ FROM lineitem
  UNION ALL
  SELECT l_orderkey, '02', CAST(l_shipdate AS DATE) + 7, CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END FROM lineitem)
SELECT DISTINCT l_orderkey, position, opdate_, opertn_ FROM ops WHERE opertn_ IS NOT NULL AND opertn_ <> '-'""")
def operation_dates_long(spark, sf):
    ship = F.col("l_shipdate").cast("date")
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey",
        ship.alias("opdate_01"),
        F.date_add(ship, 7).alias("opdate_02"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise(F.col("l_returnflag")).alias("opertn_01"),
        F.when(F.col("l_linestatus") != "O", F.col("l_linestatus")).alias("opertn_02"),
    )
    return R.operation_dates_long(wide, ["l_orderkey"], "opdate_", "opertn_")


def death_records(spark, sf) -> DataFrame:
    """Orders as death registrations with text dates, some short, some malformed."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    text = F.date_format(day, "yyyyMMdd")
    died = (
        F.when(key % 17 == 0, "notadate")
        .when((key % 3 == 0) & (F.dayofmonth(day) < 10), F.concat(F.substring(text, 1, 6), F.substring(text, 8, 1)))
        .otherwise(text)
    )
    return table(spark, sf, "orders").select(
        F.when(F.col("o_custkey") % 19 != 0, F.col("o_custkey")).alias("person_id"),
        text.alias("reg_date"),
        died.alias("reg_date_of_death"),
        F.concat(F.lit("I"), F.lpad((key % 100).cast("string"), 2, "0"), F.lit("."), (key % 7).cast("string")).alias("s_cod_code_underlying"),
        F.concat(F.lit("J"), (key % 90 + 10).cast("string"), F.lit("-1")).alias("s_cod_code_1"),
        F.when(key % 2 == 0, F.concat(F.lit("K"), (key % 90 + 10).cast("string"))).alias("s_cod_code_2"),
    )


DEATHS_SQL = """
raw AS (
  SELECT CASE WHEN o_custkey % 19 <> 0 THEN o_custkey END AS person_id, strftime(o_orderdate, '%Y%m%d') AS reg_text,
    CASE WHEN o_orderkey % 17 = 0 THEN 'notadate'
         WHEN o_orderkey % 3 = 0 AND day(o_orderdate) < 10 THEN strftime(o_orderdate, '%Y%m') || CAST(day(o_orderdate) AS VARCHAR)
         ELSE strftime(o_orderdate, '%Y%m%d') END AS died_text,
    'I' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || '.' || CAST(o_orderkey % 7 AS VARCHAR) AS c0,
    'J' || CAST(o_orderkey % 90 + 10 AS VARCHAR) || '-1' AS c1,
    CASE WHEN o_orderkey % 2 = 0 THEN 'K' || CAST(o_orderkey % 90 + 10 AS VARCHAR) END AS c2
  FROM orders),
parsed AS (
  SELECT *, CAST(try_strptime(reg_text, '%Y%m%d') AS DATE) AS reg_date,
    CAST(try_strptime(CASE WHEN length(died_text) = 7 THEN substr(died_text, 1, 6) || '0' || substr(died_text, 7, 1) ELSE died_text END, '%Y%m%d') AS DATE) AS died
  FROM raw WHERE person_id IS NOT NULL),
single AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY reg_date DESC NULLS LAST, died DESC NULLS LAST, c0 DESC NULLS LAST) AS rn FROM parsed) WHERE rn = 1)"""


@query("parse_text_dates", f"WITH {DEATHS_SQL} SELECT person_id, died_text, died AS died_on, c0 AS cause FROM parsed")
def parse_text_dates(spark, sf):
    return death_records(spark, sf).where(F.col("person_id").isNotNull()).select(
        "person_id", F.col("reg_date_of_death").alias("died_text"), D.parse_compact_date("reg_date_of_death").alias("died_on"),
        F.col("s_cod_code_underlying").alias("cause"),
    )


def _single_deaths(spark, sf):
    return R.latest_registration(death_records(spark, sf), "person_id", "reg_date", "reg_date_of_death", "s_cod_code_underlying")


@query("latest_registration", f"""
WITH {DEATHS_SQL} SELECT person_id, reg_date, died AS reg_date_of_death, c0 AS s_cod_code_underlying FROM single""")
def latest_registration(spark, sf):
    return _single_deaths(spark, sf).select("person_id", "reg_date", "reg_date_of_death", "s_cod_code_underlying")


PUNCT = "regexp_replace({}, '[.,\\-\\s]', '', 'g')"


@query("deaths_long", f"""
WITH {DEATHS_SQL}, causes AS (
  SELECT person_id, died AS date, 'UNDERLYING' AS diag_position, c0 AS cause FROM single
  UNION ALL SELECT person_id, died, 'SECONDARY_1', c1 FROM single
  UNION ALL SELECT person_id, died, 'SECONDARY_2', c2 FROM single)
SELECT person_id, date, diag_position, '4' AS diag_digits, {PUNCT.format('cause')} AS code FROM causes WHERE cause IS NOT NULL AND date IS NOT NULL
UNION ALL
SELECT person_id, date, diag_position, '3', {PUNCT.format('substr(cause, 1, 3)')} FROM causes WHERE cause IS NOT NULL AND date IS NOT NULL""")
def deaths_long(spark, sf):
    single = _single_deaths(spark, sf).drop("reg_date")
    return R.deaths_long(single, "person_id", "reg_date_of_death", "s_cod_code_")


@query("representative_label", """
SELECT code, label FROM (SELECT p_brand AS code, p_name AS label, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS rn FROM part) WHERE rn = 1""")
def representative_label(spark, sf):
    first = first_rows(table(spark, sf, "part"), ["p_brand"], ["p_name", "p_partkey"])
    return first.select(F.col("p_brand").alias("code"), F.col("p_name").alias("label"))
