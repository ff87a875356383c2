"""Queries on imputation, conditional logistic models and pooling."""

from __future__ import annotations

import uuid
import weakref

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.functions import values as V
from matchloom.operators import assembly as A
from matchloom.operators import condlogit as CL
from matchloom.operators import impute as I
from matchloom.operators import matching as M
from matchloom.operators.compare import stack_results
from matchloom.plans.cohorts import SETS_SQL, matched
from matchloom.plans.features import analysis
from matchloom.plans.registry import ORACLES, query
from matchloom.plans.roles import people, stamp, table
from matchloom.session import ensure_checkpoint_dir
from matchloom.sources import batches as B
from matchloom.sources import codelist_files as CF
from matchloom.sources import tables as T

# -- tables written and read back --------------------------------------------


def _scratch(spark, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("save_versioned", """
SELECT 'old' AS version, count(*) AS n, min(o_orderkey) AS low FROM orders
UNION ALL SELECT 'new', count(*), min(o_orderkey) + 1 FROM orders""")
def save_versioned(spark, sf):
    orders, place, name = table(spark, sf, "orders"), _scratch(spark, "saved"), f"Saved_{uuid.uuid4().hex}"
    T.save_table(orders, name, location=place)
    kept = T.save_table(orders.withColumn("o_orderkey", F.col("o_orderkey") + 1), name, location=place)
    versions = [("old", spark.table(kept)), ("new", spark.table(name))]
    return stack_results([
        ({"version": v}, df.agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"))) for v, df in versions
    ])


@query("checkpoint_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def checkpoint_table(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    stored = T.checkpoint_table(orders, f"stored_{uuid.uuid4().hex}", _scratch(spark, "stored"))
    return stored.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("export_csv", """
SELECT o_orderpriority AS priority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY o_orderpriority""")
def export_csv(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))
    path = _scratch(spark, "export")
    T.export_csv(counts, path)
    return spark.read.csv(path, header=True)


@query("read_codelist_csv", """
SELECT 'brand' AS name, 'BRAND' AS terminology, p_brand AS code, min(p_name) AS term FROM part GROUP BY p_brand""")
def read_codelist_csv(spark, sf):
    codes = table(spark, sf, "part").groupBy(F.col("p_brand").alias("code")).agg(F.min("p_name").alias("term"))
    path = _scratch(spark, "codelist")
    T.export_csv(codes.select(F.lit("brand").alias("name"), F.lit("BRAND").alias("terminology"), "code", "term"), path)
    return CF.read_codelist_csv(spark, path)


@query("resume_batches", """
SELECT CAST(o_orderkey % 3 AS INTEGER) AS imp, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""")
def resume_batches(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    path = _scratch(spark, "batches")
    part = lambda i: orders.where(F.col("o_orderkey") % 3 == i)
    B.run_missing(spark, path, [0, 1], part)
    B.run_missing(spark, path, [0, 1, 2], part)
    return B.read_batches(spark, path).groupBy("imp").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


# -- imputation --------------------------------------------------------------


def gappy_people(spark, sf) -> DataFrame:
    """Everybody with a measurement, a score and a region, each missing for some."""
    key = F.col("person_id")
    totals = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("mean_price")
    )
    return people(spark, sf).join(totals, "person_id").select(
        "person_id", "birth_year", V.flag(F.col("sex") == "F").alias("female"), "n_orders",
        F.when(key % 4 != 0, F.round("mean_price", 2)).alias("price"),
        F.when(key % 5 != 1, F.round(F.col("n_orders") * 2.5 + F.col("birth_year") % 7, 1)).alias("score"),
        F.when(key % 6 != 2, F.col("segment")).alias("segment"),
    )


PLAN = I.ImputationPlan(
    targets=("price", "score", "segment"),
    predictors=("birth_year", "female", "n_orders"),
    levels={"segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")},
)


# imputations of a session by its tables and when they changed: several queries read the same copies
_IMPUTED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def imputation(spark, sf) -> I.Imputation:
    done = _IMPUTED.setdefault(spark, {})
    key = (sf, *[stamp(spark, f"{sf}/{name}.parquet") for name in ("customer", "orders")])
    if key not in done:
        done[key] = I.impute_chained(gappy_people(spark, sf), "person_id", PLAN, seed=100)
    return done[key]


@query("imputed_copies")
def imputed_copies(spark, sf):
    return imputation(spark, sf).stacked()


_OBSERVED = """
WITH totals AS (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS mean_price FROM orders GROUP BY o_custkey),
gappy AS (
  SELECT c_custkey AS person_id, CASE WHEN c_custkey % 4 <> 0 THEN round(mean_price, 2) END AS price,
    CASE WHEN c_custkey % 5 <> 1 THEN round(n_orders * 2.5 + (1940 + c_custkey % 60) % 7, 1) END AS score,
    CASE WHEN c_custkey % 6 <> 2 THEN c_mktsegment END AS segment FROM customer JOIN totals ON o_custkey = c_custkey)"""


@query("imputation_checks", _OBSERVED + """
SELECT CAST(i.imp AS INTEGER) AS imp, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_changed, CAST(0 AS BIGINT) AS n_foreign, TRUE AS spread
FROM gappy, range(1, 11) i(imp) GROUP BY i.imp""")
def imputation_checks(spark, sf):
    """Per copy: rows, nulls left, observed cells changed, values no donor has, whether donors vary.

    Donors vary if the imputed prices are at least three in ten of what they could be.
    """
    result = imputation(spark, sf)
    old = result.original.select("person_id", *[F.col(t).alias(f"_{t}") for t in PLAN.targets])
    joined = result.copies.join(old, "person_id")
    for t in PLAN.targets:
        pool = result.original.where(F.col(t).isNotNull()).select(t).distinct().withColumn(f"_in_{t}", F.lit(1))
        joined = joined.join(pool, t, "left")
    total = lambda tests: sum((F.sum(F.when(c, 1).otherwise(0)) for c in tests), F.lit(0)).cast("long")
    return joined.groupBy("imp").agg(
        F.count(F.lit(1)).alias("n_rows"),
        total([F.col(t).isNull() for t in PLAN.targets]).alias("n_null"),
        total([F.col(f"_{t}").isNotNull() & (F.col(f"_{t}") != F.col(t)) for t in PLAN.targets]).alias("n_changed"),
        total([F.col(t).isNotNull() & F.col(f"_in_{t}").isNull() for t in PLAN.targets]).alias("n_foreign"),
        (10 * F.countDistinct(F.when(F.col("_price").isNull(), F.col("price"))) >= 3 * F.count(F.when(F.col("_price").isNull(), 1))).alias("spread"),
    )


@query("imputed_groups")
def imputed_groups(spark, sf):
    copies = imputation(spark, sf).stacked()
    band = V.binned("score", [float("-inf"), 20.0, 25.0, 30.0, float("inf")], ["under 20", "20-24", "25-29", "30 and over"])
    return copies.withColumn("score_band", band).groupBy("imp", "score_band").agg(F.count(F.lit(1)).alias("n"))


@query("imputation_trace")
def imputation_trace(spark, sf):
    return imputation(spark, sf).trace


@query("imputation_trace_counts", _OBSERVED + """,
cells AS (
  SELECT 'price' AS variable, count(*) - count(price) AS n FROM gappy UNION ALL SELECT 'score', count(*) - count(score) FROM gappy
  UNION ALL SELECT 'segment', count(*) - count(segment) FROM gappy)
SELECT CAST(c.cycle AS INTEGER) AS cycle, CAST(i.imp AS INTEGER) AS imp, variable, n AS n_imputed, TRUE AS in_range
FROM cells, range(1, 6) c(cycle), range(1, 11) i(imp)""")
def imputation_trace_counts(spark, sf):
    """Cells imputed per cycle, copy and variable, and whether their mean lies among the observed values."""
    done = imputation(spark, sf)
    bounds = [f(PLAN.response(t)).alias(f"{n}_{t}") for t in PLAN.targets for f, n in ((F.min, "low"), (F.max, "high"))]
    seen = done.original.agg(*bounds).first()
    within = F.lit(None).cast("boolean")
    for t in PLAN.targets:
        within = F.when(F.col("variable") == t, F.col("mean").between(seen[f"low_{t}"], seen[f"high_{t}"])).otherwise(within)
    return done.trace.select("cycle", "imp", "variable", "n_imputed", within.alias("in_range"))


@query("imputation_histogram_observed", _OBSERVED + """
SELECT 'observed' AS kind, CAST(0 AS INTEGER) AS imp, floor(CAST(score AS DOUBLE) / 5) * 5 AS bucket, count(*) AS n
FROM gappy WHERE score IS NOT NULL GROUP BY ALL""")
def imputation_histogram_observed(spark, sf):
    return imputation_histogram(spark, sf).where("kind = 'observed'")


@query("imputed_group_totals", _OBSERVED + """,
bands AS (SELECT CASE WHEN score < 20 THEN 'under 20' WHEN score < 25 THEN '20-24' WHEN score < 30 THEN '25-29' WHEN score IS NOT NULL THEN '30 and over' END AS score_band FROM gappy)
SELECT CAST(0 AS INTEGER) AS imp, score_band, count(*) AS n FROM bands GROUP BY ALL
UNION ALL SELECT CAST(imp AS INTEGER), NULL, (SELECT count(*) FROM gappy) FROM range(1, 11) i(imp)""")
def imputed_group_totals(spark, sf):
    """The groups of the table with its nulls, and the total of each copy."""
    groups = imputed_groups(spark, sf)
    total = groups.where("imp > 0").groupBy("imp").agg(F.lit(None).cast("string").alias("score_band"), F.sum("n").alias("n"))
    return groups.where("imp = 0").unionByName(total)


@query("imputation_histogram")
def imputation_histogram(spark, sf):
    return I.observed_imputed_histogram(imputation(spark, sf), "person_id", "score", 5.0)


PER_SEX = I.ImputationPlan(targets=("price", "score"), predictors=("birth_year", "n_orders"), excluded={"score": ("birth_year",)})


@query("imputation_by_stratum", _OBSERVED + """,
cells AS (SELECT CAST(person_id % 2 = 0 AS INTEGER) AS female, count(*) AS n, count(*) - count(price) AS n_price, count(*) - count(score) AS n_score FROM gappy GROUP BY 1)
SELECT CAST(i.imp AS INTEGER) AS imp, female, n AS n_rows, n_price, n_score, CAST(0 AS BIGINT) AS n_null, CAST(0 AS BIGINT) AS n_changed,
  CAST(0 AS BIGINT) AS n_foreign, CAST(1 AS BIGINT) AS n_dropped FROM cells, range(1, 4) i(imp)""")
def imputation_by_stratum(spark, sf):
    """Both sexes imputed in the same jobs, from donors of their own sex.

    Per copy and sex: rows, cells imputed, nulls left, observed cells changed, values
    that nobody of the sex has, and predictors dropped (a copy of another is).
    """
    people_ = gappy_people(spark, sf).withColumn("again", 2 * F.col("n_orders") + 1)
    plan = I.ImputationPlan(PER_SEX.targets, (*PER_SEX.predictors, "again"), excluded=PER_SEX.excluded)
    result = I.impute_strata(people_, "person_id", plan, "female", copies=(1, 2, 3), cycles=2, seed=7)
    old = result.original.select("person_id", *[F.col(t).alias(f"_{t}") for t in plan.targets])
    joined = result.copies.join(old, "person_id")
    for t in plan.targets:
        pool = result.original.where(F.col(t).isNotNull()).select("female", t).distinct().withColumn(f"_in_{t}", F.lit(1))
        joined = joined.join(pool, ["female", t], "left")
    total = lambda tests: sum((F.sum(F.when(c, 1).otherwise(0)) for c in tests), F.lit(0)).cast("long")
    found = joined.groupBy("imp", "female").agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[total([F.col(f"_{t}").isNull()]).alias(f"n_{t}") for t in plan.targets],
        total([F.col(t).isNull() for t in plan.targets]).alias("n_null"),
        total([F.col(f"_{t}").isNotNull() & (F.col(f"_{t}") != F.col(t)) for t in plan.targets]).alias("n_changed"),
        total([F.col(t).isNotNull() & F.col(f"_in_{t}").isNull() for t in plan.targets]).alias("n_foreign"),
    )
    spare = result.dropped.groupBy("imp", F.col("stratum").cast("int").alias("female")).agg(F.countDistinct(F.when(F.col("predictor").isin("n_orders", "again"), 1)).alias("n_dropped"))
    return found.join(spare, ["imp", "female"], "left").na.fill(0, ["n_dropped"])


# one copy and cycle of one target, predicted from n_orders alone by the predictor matrix
SINGLE = I.ImputationPlan(targets=("price",), predictors=("birth_year", "female", "n_orders"), excluded={"price": ("birth_year", "female")})


def single_imputation(spark, sf) -> I.Imputation:
    """The price is a whole mean of cents, so that every engine has the same number."""
    cents = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )
    whole = F.when(F.col("price").isNotNull(), F.floor(F.col("cents") / F.col("n_orders") / 100).cast("double"))
    exact = gappy_people(spark, sf).join(cents, "person_id").withColumn("price", whole)
    return I.impute_chained(exact, "person_id", SINGLE, copies=(1,), cycles=1, seed=100)


def _hash_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {M.HASH_DIGITS}) AS BIGINT)"


def _normal_sql(name: str) -> str:
    uniform = lambda end: f"({_hash_sql(f"'100|1|price|1||{name}|{end}'")} / {M.HASH_RANGE}.0::DOUBLE)"
    return f"sqrt(-2 * ln(1 - {uniform('a')})) * cos(2 * pi() * {uniform('b')})"


_SINGLE_SQL = _OBSERVED + f""",
cents AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents, count(*) AS n FROM orders GROUP BY o_custkey),
wide AS (
  SELECT person_id, CASE WHEN price IS NOT NULL THEN floor(cents::DOUBLE / n / 100) END AS price, CAST(n AS DOUBLE) AS x
  FROM gappy JOIN cents ON o_custkey = person_id),
sums AS (
  SELECT count(*)::DOUBLE AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(price) AS sy, sum(x * price) AS sxy, sum(price * price) AS syy,
    {_normal_sql('0')} AS z0, {_normal_sql('1')} AS z1, {_normal_sql('sigma')} AS zs FROM wide WHERE price IS NOT NULL),
factor AS (SELECT *, sqrt(n) AS r11, sx / sqrt(n) AS r12, sqrt(sxx - sx / n * sx) AS r22 FROM sums),
fitted AS (SELECT *, (sxy - r12 * (sy / r11)) / r22 / r22 AS b1 FROM factor),
solved AS (SELECT *, (sy / r11 - r12 * b1) / r11 AS b0, n - 2 AS free FROM fitted),
spread AS (SELECT *, sqrt((syy - b0 * sy - b1 * sxy) / (free * power(1 - 2 / (9 * free) + zs * sqrt(2 / (9 * free)), 3))) AS sigma FROM solved),
equation AS (SELECT b0, b1, b1 + sigma * z1 / r22 AS d1, b0 + sigma * (z0 - r12 * (z1 / r22)) / r11 AS d0 FROM spread),
ties AS (SELECT x, b0 + x * b1 AS score, count(*) AS n FROM wide, equation WHERE price IS NOT NULL GROUP BY ALL),
asked AS (SELECT person_id, d0 + x * d1 AS score FROM wide, equation WHERE price IS NULL),
sides AS (
  SELECT person_id, t.x, t.n, abs(t.score - a.score) AS d, t.score AS place_at,
    row_number() OVER (PARTITION BY person_id, t.score > a.score ORDER BY abs(t.score - a.score)) AS place FROM asked a, ties t),
near AS (
  SELECT person_id, x, n, sum(n) OVER (PARTITION BY person_id ORDER BY d, place_at) AS upto, sum(n) OVER (PARTITION BY person_id) AS total FROM sides WHERE place <= 5),
placed AS (SELECT person_id, x, n, upto, {_hash_sql("'100|1|price|1|' || person_id")} % least(5, total) AS place FROM near),
taken AS (SELECT person_id, arg_min(x, upto) AS x, arg_min(n, upto) AS n FROM placed WHERE upto > place GROUP BY person_id),
donors AS (SELECT x, price, row_number() OVER (PARTITION BY x ORDER BY person_id) - 1 AS number FROM wide WHERE price IS NOT NULL),
imputed AS (
  SELECT person_id, d.price FROM taken t JOIN donors d ON d.x = t.x AND d.number = {_hash_sql("'100|1|price|tie|1|' || person_id")} % t.n)"""


@query("imputed_copy_single", _SINGLE_SQL + """
SELECT CAST(1 AS INTEGER) AS imp, w.person_id, coalesce(w.price, i.price) AS price, w.price IS NULL AS imputed FROM wide w LEFT JOIN imputed i USING (person_id)
UNION ALL SELECT CAST(0 AS INTEGER), person_id, price, price IS NULL FROM wide""")
def imputed_copy_single(spark, sf):
    """One copy after one cycle, every value: coefficients, draws, donors and ties as SQL finds them."""
    result = single_imputation(spark, sf)
    asked = result.original.select("person_id", F.col("price").isNull().alias("imputed"))
    return result.stacked().join(asked, "person_id").select("imp", "person_id", "price", "imputed")


@query("imputation_trace_single", _SINGLE_SQL + """
SELECT CAST(1 AS INTEGER) AS cycle, CAST(1 AS INTEGER) AS imp, 'price' AS variable, count(*) AS n_imputed, round(avg(price), 6) AS mean, round(stddev_samp(price), 6) AS sd FROM imputed""")
def imputation_trace_single(spark, sf):
    trace = single_imputation(spark, sf).trace
    return trace.withColumns({c: F.round(c, 6) for c in ("mean", "sd")})


# -- models ------------------------------------------------------------------

TERMS = ["exposed_12m", "statin", "admitted"]


def model_table(spark, sf) -> DataFrame:
    return analysis(spark, sf).select("set", "person_id", "case", *TERMS, "any_source")


def newton_sql(rows: str, terms: list[str], steps: int = 7) -> str:
    """Common tables that fit a conditional logistic model by Newton steps, ending in ``fitted`` (imp, term, estimate, std_error).

    ``rows`` gives ``imp``, ``set``, ``c`` and a column ``x0``, ``x1``, ... per term.
    Each step factors the Hessian by Cholesky, a table per column, with the gradient
    as a last row, and substitutes back, a table per row.
    """
    n = len(terms)
    p = range(n)
    pairs = [(i, j) for i in p for j in p if j <= i]
    add = lambda parts: " + ".join(parts) or "0"
    out = [
        f"given AS MATERIALIZED ({rows})",
        """model AS MATERIALIZED (
  SELECT g.* FROM given g SEMI JOIN (SELECT imp, set FROM given GROUP BY imp, set HAVING sum(c) = 1 AND count(*) > 1) u ON u.imp = g.imp AND u.set = g.set)""",
        f"beta0 AS MATERIALIZED (SELECT imp, {', '.join(f'0.0::DOUBLE AS b{i}' for i in p)} FROM model GROUP BY imp)",
    ]
    for s in range(steps):
        out += [
            f"e{s} AS MATERIALIZED (SELECT m.*, exp({add([f'x{i} * b{i}' for i in p])}) AS w FROM model m JOIN beta{s} USING (imp))",
            f"m{s} AS MATERIALIZED (SELECT imp, set, {', '.join([f'sum(w * x{i}) / sum(w) AS f{i}, sum(c * x{i}) AS c{i}' for i in p] + [f'sum(w * x{i} * x{j}) / sum(w) AS s{i}_{j}' for i, j in pairs])} FROM e{s} GROUP BY imp, set)",
            f"l{s}_0 AS MATERIALIZED (SELECT imp, {', '.join([f'sum(c{i} - f{i}) AS h{n}_{i}' for i in p] + [f'sum(s{i}_{j} - f{i} * f{j}) AS h{i}_{j}' for i, j in pairs])} FROM m{s} GROUP BY imp)",
        ]
        for j in p:
            left = lambda i: f"(h{i}_{j} - ({add([f'l{i}_{k} * l{j}_{k}' for k in range(j)])}))"
            column = [f"sqrt({left(j)}) AS l{j}_{j}", *[f"{left(i)} / sqrt({left(j)}) AS l{i}_{j}" for i in range(j + 1, n + 1)]]
            out.append(f"l{s}_{j + 1} AS MATERIALIZED (SELECT *, {', '.join(column)} FROM l{s}_{j})")
        source = f"l{s}_{n}"
        for i in reversed(p):
            move = f"(l{n}_{i} - ({add([f'l{k}_{i} * d{k}' for k in range(i + 1, n)])})) / l{i}_{i} AS d{i}"
            out.append(f"d{s}_{i} AS MATERIALIZED (SELECT *, {move} FROM {source})")
            source = f"d{s}_{i}"
        out.append(f"beta{s + 1} AS MATERIALIZED (SELECT imp, {', '.join(f'b{i} + d{i} AS b{i}' for i in p)} FROM beta{s} JOIN {source} USING (imp))")
    # the inverse of the factor, a table per row
    source = f"l{steps - 1}_{n}"
    for i in p:
        row = [f"-({add([f'l{i}_{k} * v{k}_{j}' for k in range(j, i)])}) / l{i}_{i} AS v{i}_{j}" for j in range(i)] + [f"1 / l{i}_{i} AS v{i}_{i}"]
        out.append(f"v_{i} AS MATERIALIZED (SELECT *, {', '.join(row)} FROM {source})")
        source = f"v_{i}"
    rows_of = [
        f"SELECT imp, '{t}' AS term, b{i} AS estimate, sqrt({add([f'v{k}_{i} * v{k}_{i}' for k in range(i, n)])}) AS std_error FROM beta{steps} JOIN {source} USING (imp)"
        for i, t in enumerate(terms)
    ]
    out.append("fitted AS MATERIALIZED (" + " UNION ALL ".join(rows_of) + ")")
    return ",\n".join(out)


_RATIOS_SQL = '''round(estimate, 6) AS estimate, round(std_error, 6) AS std_error, round(exp(estimate), 6) AS "OR",
  round(exp(estimate - 1.96 * std_error), 6) AS "OR_lower", round(exp(estimate + 1.96 * std_error), 6) AS "OR_upper"'''
_ANALYSIS_SQL = f"analysed AS MATERIALIZED (SELECT * FROM ({ORACLES['analysis_table']}))"


def _columns_sql(columns: list[str]) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(columns))


def _fit_sql(columns: list[str], terms: list[str], source: str = "analysed") -> str:
    return newton_sql(f'SELECT 0 AS imp, set, "case" AS c, {_columns_sql(columns)} FROM {source}', terms)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, kind in df.dtypes if kind == "double"})


@query("cond_logit", f"WITH {_ANALYSIS_SQL}, {_fit_sql(TERMS, TERMS)} SELECT term, {_RATIOS_SQL} FROM fitted")
def cond_logit(spark, sf):
    fit = CL.fit_conditional_logistic(model_table(spark, sf), TERMS)
    return rounded(CL.odds_ratios(fit.coefficients))


@query("cond_logit_pairs", f"""
WITH RECURSIVE {SETS_SQL},
matched_pairs AS (
  SELECT a.set, CAST(p.c_custkey % 7 < 3 AS INTEGER) AS case_value, CAST(q.c_custkey % 7 < 3 AS INTEGER) AS control_value
  FROM sets a JOIN sets b ON a.set = b.set AND a."case" = 1 AND b."case" = 0 AND b.control_rank = 1
  JOIN customer p ON p.c_custkey = a.person_id JOIN customer q ON q.c_custkey = b.person_id)
SELECT 'three_sevenths' AS term, round(ln(b * 1.0::DOUBLE / c), 6) AS estimate, round(sqrt(1.0::DOUBLE / b + 1.0::DOUBLE / c), 6) AS std_error
FROM (SELECT count(*) FILTER (case_value > control_value) AS b, count(*) FILTER (case_value < control_value) AS c FROM matched_pairs)""")
def cond_logit_pairs(spark, sf):
    """One control per case and one 0/1 term: the odds ratio is that of the discordant pairs."""
    sets = matched(spark, sf).where("case = 1 OR control_rank = 1").select("set", "person_id", "case")
    fit = CL.fit_conditional_logistic(sets.withColumn("three_sevenths", (F.col("person_id") % 7 < 3).cast("int")), ["three_sevenths"])
    return fit.coefficients.select("term", F.round("estimate", 6).alias("estimate"), F.round("std_error", 6).alias("std_error"))


@query("cond_logit_interaction", f"""
WITH {_ANALYSIS_SQL}, {_fit_sql([*TERMS, "exposed_12m * admitted"], [*TERMS, "exposed_12m:admitted"])} SELECT term, {_RATIOS_SQL} FROM fitted""")
def cond_logit_interaction(spark, sf):
    df, names = A.model_terms(model_table(spark, sf), TERMS, interactions=[("exposed_12m", "admitted")])
    return rounded(CL.odds_ratios(CL.fit_conditional_logistic(df, names).coefficients))


# factors of the adjusted model: levels, and the one the others are compared with
GROUPING = ("none", "recent_only", "non_recent_only", "both")
AREAS = tuple(f"area_{i}" for i in range(8))
FACTORS = {"grouping": (GROUPING, "none"), "area": (AREAS, "area_0")}
_FACTOR_TERMS = ["admitted", "statin", *[f"grouping_{g}" for g in GROUPING[1:]], *[f"area_{a}" for a in AREAS[1:]]]
_FACTOR_COLUMNS = ["admitted", "statin", *[f"grouping = '{g}'" for g in GROUPING[1:]], *[f"area = '{a}'" for a in AREAS[1:]]]
_FACTOR_SQL = f"""{_ANALYSIS_SQL},
grouped AS (
  SELECT a.*, 'area_' || (c_nationkey % 8) AS area, CASE WHEN recent_3m = 1 AND (recent_6m = 1 OR recent_12m = 1) THEN 'both'
    WHEN recent_3m = 1 THEN 'recent_only' WHEN recent_6m = 1 OR recent_12m = 1 THEN 'non_recent_only' ELSE 'none' END AS grouping
  FROM analysed a JOIN customer ON c_custkey = person_id)"""


def factor_table(spark, sf) -> DataFrame:
    area = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.concat(F.lit("area_"), (F.col("c_nationkey") % 8).cast("string")).alias("area")
    )
    grouping = V.exposure_group("recent_3m", "recent_6m", "recent_12m").alias("grouping")
    return analysis(spark, sf).select("set", "person_id", "case", "admitted", "statin", grouping).join(area, "person_id")


@query("cond_logit_factors", f"""
WITH {_FACTOR_SQL}, {_fit_sql(_FACTOR_COLUMNS, _FACTOR_TERMS, "grouped")} SELECT term, {_RATIOS_SQL} FROM fitted""")
def cond_logit_factors(spark, sf):
    """Exposure in four groups and an area in eight, against their reference levels, adjusted for two flags."""
    df, names = A.model_terms(factor_table(spark, sf), ["admitted", "statin"], FACTORS)
    return rounded(CL.odds_ratios(CL.fit_conditional_logistic(df, names).coefficients))


_CROSSED = [f"statin:grouping_{g}" for g in GROUPING[1:]]


@query("cond_logit_factor_interaction", f"""
WITH {_FACTOR_SQL}, {_fit_sql(["statin", *_FACTOR_COLUMNS[2:5], *[f"statin * (grouping = '{g}')::INTEGER" for g in GROUPING[1:]]], ["statin", *_FACTOR_TERMS[2:5], *_CROSSED], "grouped")}
SELECT term, {_RATIOS_SQL} FROM fitted""")
def cond_logit_factor_interaction(spark, sf):
    """A flag crossed with every level of a factor."""
    df, names = A.model_terms(factor_table(spark, sf), ["statin"], {"grouping": FACTORS["grouping"]}, [("statin", "grouping")])
    return rounded(CL.odds_ratios(CL.fit_conditional_logistic(df, names).coefficients))


@query("cond_logit_subgroups", f"""
WITH {_FACTOR_SQL}, heads AS (SELECT set, sex FROM grouped WHERE "case" = 1),
given_to AS (SELECT g.*, h.sex AS subgroup FROM grouped g JOIN heads h USING (set)),
{newton_sql(f"SELECT CAST(subgroup = 'F' AS INTEGER) AS imp, set, \"case\" AS c, {_columns_sql(['statin', 'exposed_12m'])} FROM given_to", ['statin', 'exposed_12m'])}
SELECT CASE WHEN imp = 1 THEN 'F' ELSE 'M' END AS subgroup, term, {_RATIOS_SQL} FROM fitted""")
def cond_logit_subgroups(spark, sf):
    """The same model in the sets of each sex, fitted in the same jobs."""
    rows = analysis(spark, sf).select("set", "case", "sex", "statin", "exposed_12m")
    heads = rows.where(F.col("case") == 1).select("set", (F.col("sex") == "F").cast("int").alias("part"))
    fit = CL.fit_conditional_logistic(rows.join(heads, "set"), ["statin", "exposed_12m"], copy="part")
    named = fit.coefficients.withColumn("subgroup", F.when(F.col("imp") == 1, "F").otherwise("M")).drop("imp")
    return rounded(CL.odds_ratios(named))


def _load_sql(copies: int) -> str:
    load = f"(n_orders + {_hash_sql("concat_ws('|', 'load', i.imp, person_id)")} % 5)"
    rows = f"""SELECT CAST(i.imp AS INTEGER) AS imp, set, "case" AS c, CAST({load} AS DOUBLE) AS x0, CAST(person_id % 7 < 3 AS INTEGER)::DOUBLE AS x1
  FROM sets JOIN totals ON o_custkey = person_id, range(1, {copies + 1}) i(imp)"""
    return newton_sql(rows, ["load", "three_sevenths"])


@query("cond_logit_copies", f"""
WITH RECURSIVE {SETS_SQL}, totals AS (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey),
{_load_sql(4)},
pooled AS (
  SELECT term, count(*) AS n_copies, avg(estimate) AS estimate, avg(std_error * std_error) AS within, var_samp(estimate) AS between FROM fitted GROUP BY term),
errors AS (SELECT *, sqrt(within + (1 + 1.0::DOUBLE / n_copies) * between) AS std_error FROM pooled)
SELECT term, n_copies, round(within, 6) AS within, round(between, 6) AS between, {_RATIOS_SQL} FROM errors""")
def cond_logit_copies(spark, sf):
    """Four copies that differ in a term drawn from hashes, fitted together, and pooled."""
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("person_id")).agg(F.count(F.lit(1)).alias("n_orders"))
    copies = matched(spark, sf).select("set", "person_id", "case").join(counts, "person_id").select("*", F.explode(F.array(*[F.lit(i) for i in range(1, 5)])).alias("imp"))
    load = F.col("n_orders") + M.hash_number(F.lit("load"), F.col("imp"), F.col("person_id")) % 5
    terms = copies.withColumn("load", load).withColumn("three_sevenths", (F.col("person_id") % 7 < 3).cast("int"))
    fit = CL.fit_conditional_logistic(terms, ["load", "three_sevenths"], copy="imp")
    pooled = CL.pool_estimates(fit.coefficients).select("term", "estimate", "std_error", "within", "between", "n_copies")
    return rounded(CL.odds_ratios(pooled))


@query("cond_logit_by_copy")
def cond_logit_by_copy(spark, sf):
    """Two copies that differ in an imputed price, fitted together and pooled."""
    sets = matched(spark, sf).select("set", "person_id", "case")
    copies = imputation(spark, sf).copies.select("imp", "person_id", (F.col("price") / 10000).alias("price"), "score")
    fit = CL.fit_conditional_logistic(sets.join(copies, "person_id"), ["price", "score"], copy="imp")
    return CL.odds_ratios(CL.pool_estimates(fit.coefficients))


_COPY_SQL = """copies AS (
  SELECT CAST(l_linenumber % 5 AS INTEGER) AS imp, l_returnflag AS term, avg(l_discount) AS estimate, stddev_samp(l_tax) AS std_error
  FROM lineitem GROUP BY 1, 2)"""


def copy_estimates(spark, sf) -> DataFrame:
    """Estimates per copy and term taken from the line items."""
    return table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 5).alias("imp"), F.col("l_returnflag").alias("term")).agg(
        F.avg("l_discount").alias("estimate"), F.stddev("l_tax").alias("std_error")
    )


@query("pooled_estimates", f"""
WITH {_COPY_SQL}
SELECT term, round(avg(estimate), 8) AS estimate,
  round(sqrt(avg(std_error * std_error) + (1 + 1.0::DOUBLE / count(*)) * var_samp(estimate)), 8) AS std_error,
  round(avg(std_error * std_error), 8) AS within, round(var_samp(estimate), 10) AS between, count(*) AS n_copies,
  round(avg(estimate) / sqrt(avg(std_error * std_error) + (1 + 1.0::DOUBLE / count(*)) * var_samp(estimate)), 6) AS statistic,
  round((count(*) - 1) * power(1 + avg(std_error * std_error) / ((1 + 1.0::DOUBLE / count(*)) * var_samp(estimate)), 2) / 1e6, 3) AS df_millions
FROM copies GROUP BY term""")
def pooled_estimates(spark, sf):
    return CL.pool_estimates(copy_estimates(spark, sf)).withColumns({
        "estimate": F.round("estimate", 8), "std_error": F.round("std_error", 8), "within": F.round("within", 8), "between": F.round("between", 10),
        "statistic": F.round("statistic", 6), "df_millions": F.round(F.col("df") / 1e6, 3),
    }).drop("df", "p_value")


@query("odds_ratios", f"""
WITH {_COPY_SQL}
SELECT imp, term, round(exp(estimate), 8) AS "OR", round(exp(estimate - 1.96 * std_error), 8) AS "OR_lower",
  round(exp(estimate + 1.96 * std_error), 8) AS "OR_upper" FROM copies""")
def odds_ratios(spark, sf):
    out = CL.odds_ratios(copy_estimates(spark, sf)).drop("estimate", "std_error")
    return out.withColumns({c: F.round(c, 8) for c in ("OR", "OR_lower", "OR_upper")})
