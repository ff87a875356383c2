from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from matchloom.functions.values import RECENCY_DAYS_CONTIGUOUS
from matchloom.operators import features as X
from conftest import rows

INDEX = date(2024, 6, 30)


def base(spark, people, sets=(1,)):
    data = [(s, p, INDEX, date(1950, 1, 1)) for p in people for s in sets]
    return spark.createDataFrame(data, "set int, person_id int, index_date date, birth_date date")


def drug(spark, days, code="d"):
    data = [(p, INDEX - timedelta(days=d), code) for p, d in enumerate(days)]
    return spark.createDataFrame(data, "person_id int, date date, code string")


@pytest.fixture
def codes(spark):
    return spark.createDataFrame([("exposed", "d"), ("other", "e")], "name string, code string")


def test_recency_boundaries(spark, codes):
    days = [0, 90, 91, 92, 180, 181, 182, 365, 366, 367]
    out = X.exposure_recency(base(spark, range(10)), drug(spark, days), codes, "exposed")
    got = {days[r.person_id]: (r.exposed_12m, r.recent_3m, r.recent_6m, r.recent_12m) for r in out.collect()}
    assert got == {
        0: (1, 1, 0, 0), 90: (1, 1, 0, 0), 91: (1, 0, 0, 0), 92: (1, 0, 1, 0), 180: (1, 0, 1, 0),
        181: (1, 0, 0, 0), 182: (1, 0, 0, 1), 365: (1, 0, 0, 1), 366: (0, 0, 0, 0),  # the look-back spans 29 February
    }
    whole = X.exposure_recency(base(spark, range(10)), drug(spark, days), codes, "exposed", RECENCY_DAYS_CONTIGUOUS)
    got = {days[r.person_id]: sum((r.recent_3m, r.recent_6m, r.recent_12m)) for r in whole.collect()}
    assert got == {d: 1 for d in days if d <= 366}


def test_features_in_one_pass(spark, codes):
    lab = spark.createDataFrame(
        [
            (1, INDEX, "e", 5.0), (1, INDEX, "e", 3.0), (1, INDEX, "d", 900.0), (1, INDEX + timedelta(days=1), "e", 1.0),
            (2, INDEX - timedelta(days=800), "e", 7.0), (3, INDEX, "e", None), (3, INDEX - timedelta(days=2), "e", 4.0),
        ],
        "person_id int, date date, code string, value double",
    )
    rules = [
        X.Feature("last", "other", ("lab",), "latest", 24, low=1, high=100),
        X.Feature("seen", "other", ("lab",), "flag", 24, end_offset=-1, fill=0),
        X.Feature("ever", "other", ("lab",), "flag", None),
    ]
    out = X.feature_table(base(spark, [1, 2, 3], sets=(1, 2)), {"lab": lab}, codes, rules)
    got = rows(out.select("set", "person_id", "last", "seen", "ever"))
    assert got == [(s, p, v, seen, ever) for s in (1, 2) for p, v, seen, ever in ((1, 3.0, 0, 1), (2, None, 0, 1), (3, 4.0, 1, 1))]


def test_window_belongs_to_the_set(spark, codes):
    members = spark.createDataFrame(
        [(1, 9, date(2020, 1, 1), date(1950, 1, 1)), (2, 9, date(2022, 1, 1), date(1950, 1, 1))],
        "set int, person_id int, index_date date, birth_date date",
    )
    seen = spark.createDataFrame([(9, date(2021, 12, 31), "d")], "person_id int, date date, code string")
    out = X.feature_table(members, {"s": seen}, codes, [X.Feature("f", "exposed", ("s",), "flag", 6)])
    assert rows(out.select("set", "f")) == [(1, None), (2, 1)]


def test_persistent_low(spark):
    readings = spark.createDataFrame(
        [(1, INDEX - timedelta(days=d), v) for d, v in ((0, 50.0), (89, 50.0))]
        + [(2, INDEX - timedelta(days=d), v) for d, v in ((0, 59.0), (40, 70.0), (90, 50.0))]
        + [(3, INDEX, 50.0), (4, INDEX, 50.0), (4, INDEX - timedelta(days=200), 60.0)]
        + [(5, date(1949, 1, 1), 50.0), (5, INDEX, 50.0)],
        "person_id int, date date, value double",
    )
    out = X.persistent_low(base(spark, range(1, 6)), readings, 60, "chronic")
    assert rows(out.select("person_id", "chronic")) == [(1, None), (2, 1), (3, None), (4, None), (5, None)]


def test_any_in_window_and_class_flags(spark, codes):
    records = drug(spark, [0, 1, 400]).unionByName(drug(spark, [0], "e"))
    flagged = X.any_in_window(
        base(spark, range(3)), {"a": (records, codes.where("name = 'exposed'")), "b": (records, codes.where("name = 'other'"))}, "f", 6, end_offset=-1
    )
    assert rows(flagged.select("person_id", "f")) == [(0, None), (1, 1), (2, None)]
    classes = X.class_flags(base(spark, range(3)), records, codes, ["exposed", "other"])
    assert rows(classes) == [(0, 1, 1, 1), (1, 1, 1, 0)]


def test_hot_person_is_reduced_to_days(spark, codes):
    many = spark.range(20000).select(
        F.lit(1).alias("person_id"), F.date_sub(F.lit(INDEX), (F.col("id") % 50).cast("int")).alias("date"), F.lit("d").alias("code"),
        F.col("id").cast("double").alias("value"),
    )
    events = X.feature_events({"s": many}, codes, [X.Feature("f", "exposed", ("s",), "latest", 12)])
    assert events.count() == 50
    out = X.feature_table(base(spark, [1]), {"s": many}, codes, [X.Feature("f", "exposed", ("s",), "latest", 12)])
    assert out.first().f == 0.0
