import random

import pandas as pd
from pyspark.sql import functions as F

from matchloom.operators.asof import latest_in_window, nearest_event
from matchloom.operators.ranking import dense_index, first_rows, running_total
from conftest import rows


def test_running_total_equals_window_with_a_hot_group(spark):
    rng = random.Random(1)
    data = [("hot" if i % 3 else f"g{i % 50}", rng.randint(0, 5) if i % 2 else 7, i, i % 4) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, level int, id long, w int")
    got = running_total(df, ["level", "id"], ["g"], weight=F.col("w"), out="t", splits=40).toPandas()
    want = pd.DataFrame(data, columns=["g", "level", "id", "w"]).sort_values(["g", "level", "id"])
    want["t"] = want.groupby("g").w.cumsum()
    merged = got.merge(want, on=["g", "level", "id"])
    assert len(merged) == 3000
    assert (merged.t_x == merged.t_y).all()


def test_running_total_splits_one_group_over_many_slices(spark):
    df = spark.range(5000).withColumn("g", F.lit(1)).withColumn("same", F.lit(0))
    out = running_total(df, ["same", "id"], ["g"], splits=50)
    plan = out._jdf.queryExecution().toString()
    assert "_slice" in plan
    assert [r.running for r in out.orderBy("id").collect()] == list(range(1, 5001))


def test_running_total_of_nothing(spark):
    assert running_total(spark.range(0), ["id"]).count() == 0


def test_dense_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ("c",)], "k string")
    assert rows(dense_index(df, "k")) == [("a", 1), ("b", 2), ("c", 3)]


def test_first_rows_is_limited_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "a"), (2, 9, "z")], "k int, d int, c string")
    out = first_rows(df, ["k"], ["d", "c"])
    assert rows(out) == [(1, 3, "a"), (2, 9, "z")]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_nearest_event_both_ways(spark):
    events = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "p int, day int, x string")
    probes = spark.createDataFrame([(1, 9, 100), (1, 10, 101), (1, 19, 102), (1, 25, 103), (3, 1, 104)], "p int, at int, id int")
    back = nearest_event(probes, events, ["p"], "at", "day", ["x"]).select("id", "day", "x")
    assert rows(back) == [(100, None, None), (101, 10, "a"), (102, 10, "a"), (103, 20, "b"), (104, None, None)]
    ahead = nearest_event(probes, events, ["p"], "at", "day", ["x"], forward=True).select("id", "day")
    assert rows(ahead) == [(100, 10), (101, 10), (102, 20), (103, None), (104, None)]


def test_latest_in_window_ties_and_bounds(spark):
    base = spark.sql("select * from values (1, 7, date'2020-06-30'), (2, 7, date'2020-02-29') t(set, person_id, index_date)")
    records = spark.sql(
        "select * from values (7, date'2020-06-30', 2, 'b'), (7, date'2020-06-30', 1, 'z'), (7, date'2020-01-29', 1, 'c'),"
        " (7, date'2020-07-01', 1, 'late'), (7, date'2019-01-01', 1, 'early'), (null, date'2020-06-30', 1, 'x') t(person_id, date, source_no, code)"
    )
    window = (F.add_months("index_date", -1), F.col("index_date"))
    out = latest_in_window(base, records, "person_id", window, "date", ["code"], ["source_no"])
    assert [(r.set, r.code) for r in out.orderBy("set").collect()] == [(1, "z"), (2, "c")]
