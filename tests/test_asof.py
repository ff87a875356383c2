"""As-of lookups whose keys are cut into slices."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from conftest import rows
from matchloom.operators import asof as A
from matchloom.operators import features as X

DAY = date(2000, 1, 1)


def hot_table(spark, seed=3):
    """Events and probes of which person 1 owns more than a third, with a null key."""
    rng = random.Random(seed)
    person = lambda: 1 if rng.random() < 0.4 else rng.choice([None, *range(2, 60)])
    events = sorted({(person(), rng.randrange(4000)) for _ in range(3000)}, key=str)
    probes = [(i, person(), rng.randrange(-50, 4050)) for i in range(2000)]
    return events, probes, (
        spark.createDataFrame([(p, DAY + timedelta(days=d), d) for p, d in events], "p int, day date, x int"),
        spark.createDataFrame([(i, p, DAY + timedelta(days=d)) for i, p, d in probes], "id int, p int, at date"),
    )


def test_a_person_with_a_third_of_the_records_over_many_slices(spark):
    events, probes, (event_table, probe_table) = hot_table(spark)
    days = {}
    for p, d in events:
        days.setdefault(p, []).append(d)
    back = {i: max((d for d in days.get(p, []) if d <= at), default=None) for i, p, at in probes}
    ahead = {i: min((d for d in days.get(p, []) if d >= at), default=None) for i, p, at in probes}
    find = lambda forward: A.nearest_event(probe_table, event_table, ["p"], "at", "day", ["x"], forward, slices=40)
    assert {r.id: r.x for r in find(False).collect()} == back
    assert {r.id: r.x for r in find(True).collect()} == ahead
    odd = {r.id: r.x for r in find(F.col("id") % 2 == 1).collect()}
    assert odd == {i: (ahead if i % 2 else back)[i] for i in back}


def test_a_hot_key_really_lies_in_eight_slices_and_little_is_carried(spark, monkeypatch):
    _, _, (events, probes) = hot_table(spark)
    seen = []
    whole = A._carried
    monkeypatch.setattr(A, "_carried", lambda sliced, by: seen.append((sliced, whole(sliced, by))) or seen[0][1])
    A.nearest_event(probes, events, ["p"], "at", "day", slices=40).count()
    sliced, carried = seen[0]
    assert sliced.where("p = 1").select("_slice").distinct().count() >= 8
    n_slices = sliced.select("_slice").distinct().count()
    assert 8 <= carried.count() <= 2 * n_slices


def test_slices_without_events_are_crossed(spark):
    """The carried event may come from several slices away, in both directions."""
    events = spark.createDataFrame([(1, DAY), (1, DAY + timedelta(days=900))], "p int, day date")
    probes = spark.createDataFrame([(i, 1, DAY + timedelta(days=i)) for i in range(1, 900)], "id int, p int, at date")
    both = probes.withColumn("side", F.lit(0)).union(probes.withColumn("side", F.lit(1)))
    out = A.nearest_event(both, events, ["p"], "at", "day", forward=F.col("side") == 1, slices=30)
    got = {(r.side, r.day) for r in out.select("side", "day").distinct().collect()}
    assert got == {(0, DAY), (1, DAY + timedelta(days=900))} and out.count() == 2 * 899


def test_equal_windows_are_looked_up_once_and_every_row_comes_back(spark, monkeypatch):
    base = spark.createDataFrame([(s, 1 + s % 2, DAY, DAY + timedelta(days=30)) for s in range(100)] + [(100, None, DAY, DAY), (101, 1, None, DAY)],
                                 "set int, p int, a date, b date")
    records = spark.createDataFrame([(1, DAY + timedelta(days=d), f"c{d}") for d in (3, 30, 31)], "p int, day date, code string")
    asked = []
    inner = A.nearest_event
    monkeypatch.setattr(A, "nearest_event", lambda probes, *a, **k: asked.append(probes.count()) or inner(probes, *a, **k))
    out = A.latest_in_window(base, records, "p", (F.col("a"), F.col("b")), "day", ["code"])
    assert asked == [2]
    assert rows(out.select("set", "code")) == rows(base.where("p = 1 and a is not null").select("set", F.lit("c30")))


def test_empty_sides(spark):
    events, probes = spark.createDataFrame([], "p int, day date"), spark.createDataFrame([(1, 1, DAY)], "id int, p int, at date")
    assert rows(A.nearest_event(probes, events, ["p"], "at", "day")) == [(1, 1, DAY, None)]
    assert A.nearest_event(probes.where("false"), events, ["p"], "at", "day").count() == 0


def test_sources_of_one_table_share_a_scan_and_flags_need_no_sort(spark, tmp_path):
    data = [(p, DAY + timedelta(days=d), f"a{d % 3}", f"b{d % 2}", float(d)) for p in range(5) for d in range(20)]
    spark.createDataFrame(data, "person_id int, date date, code string, kind string, value double").write.parquet(str(tmp_path / "r"))
    records = spark.read.parquet(str(tmp_path / "r"))
    codes = spark.createDataFrame([("one", "a1"), ("two", "b1")], "name string, code string")
    base = spark.createDataFrame([(1, p, DAY + timedelta(days=15), DAY) for p in range(5)], "set int, person_id int, index_date date, birth_date date")
    flags = [X.Feature("f", "one", ("drug",), "flag", 1), X.Feature("g", "two", ("lab",), "span", None, min_days=12)]
    given = {"drug": X.Source(records), "lab": X.Source(records, code="kind")}
    plan = X.feature_events(given, codes, flags)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert physical.count("FileScan parquet") == 1 and "SortAggregate" not in physical and "HashAggregate" in physical
    out = X.feature_table(base, given, codes, [*flags, X.Feature("v", "two", ("lab",), "latest", 1)])
    assert rows(out.select("person_id", "f", "g", "v")) == [(p, 1, 1, 15.0) for p in range(5)]
