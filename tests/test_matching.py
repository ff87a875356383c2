import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.operators import matching as M
from conftest import rows

RULES = M.MatchRules(exact=("sex", "kind"), near="born")


def people(n=600, seed=3, hot=0.5):
    """People of whom about half share one stratum."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        sex = "F" if rng.random() < hot else rng.choice("MX")
        born = 1950 if rng.random() < 0.6 else rng.randint(1945, 1955)
        start = rng.randint(0, 400)
        length = rng.choice([365, 365, rng.randint(1, 365)])
        out.append((i, int(rng.random() < 0.1), sex, "a" if sex == "F" else rng.choice("ab"), born, length, start, start + length - 1))
    return out


SCHEMA = "person_id long, case int, sex string, kind string, born int, follow_up_days int, start int, end int"


def eligible(data, cases_as_controls=True, tolerance=1):
    found = defaultdict(set)
    for c in data:
        if c[1]:
            found[c[0]] = {
                o[0] for o in data
                if o[0] != c[0] and o[2] == c[2] and o[3] == c[3] and abs(o[4] - c[4]) <= tolerance and o[5] >= c[5]
                and (cases_as_controls or not o[1])
            }
    return found


@pytest.mark.parametrize("cases_as_controls", [True, False])
def test_counts_equal_brute_force(spark, cases_as_controls):
    data = people()
    rules = M.MatchRules(exact=("sex", "kind"), near="born", cases_as_controls=cases_as_controls)
    df = spark.createDataFrame(data, SCHEMA)
    want = {c: len(s) for c, s in eligible(data, cases_as_controls).items()}
    assert {r.person_id: r.n_eligible for r in M.eligible_counts(df, rules).collect()} == want
    assert {r.person_id for r in M.unmatched_cases(df, rules).collect()} == {c for c, n in want.items() if n == 0}


def test_sample_obeys_every_rule_and_ignores_partitioning(spark):
    data = people()
    allowed = eligible(data)
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(M.sample_controls(df, RULES, k=5))
    assert got == rows(M.sample_controls(df.repartition(13, "born"), RULES, k=5))
    per_case = defaultdict(list)
    for case, control, number, rank in got:
        assert control in allowed[case]
        assert 0 <= number < 1
        per_case[case].append((rank, control, number))
    for case, controls in allowed.items():
        members = sorted(per_case[case])
        assert len(members) == min(5, len(controls))
        assert [r for r, _, _ in members] == list(range(1, len(members) + 1))
        assert len({c for _, c, _ in members}) == len(members)
        assert [x for _, _, x in members] == sorted(x for _, _, x in members)
    assert rows(M.sample_controls(df, RULES, k=5, seed=7)) != got


def test_sample_is_even(spark):
    """Each of 20 controls is drawn about equally often by 2000 cases."""
    data = [(i, 0, "F", "a", 1950, 100) for i in range(20)] + [(1000 + i, 1, "F", "a", 1950, 10) for i in range(2000)]
    df = spark.createDataFrame(data, "person_id long, case int, sex string, kind string, born int, follow_up_days int")
    rules = M.MatchRules(exact=("sex", "kind"), near="born", cases_as_controls=False)
    counts = M.sample_controls(df, rules, k=5).groupBy("control_id").count().collect()
    assert len(counts) == 20
    assert all(400 < r["count"] < 600 for r in counts)  # 500 expected, deviation about 19


def test_matched_sets_table(spark):
    data = [
        (1, 1, "F", "a", 1950, 50, "h", "c1"),
        (2, 0, "F", "a", 1951, 50, None, None),   # equal follow-up, a year apart
        (3, 0, "F", "a", 1952, 99, None, None),   # two years apart
        (4, 1, "F", "a", 1950, 80, "h", "c2"),    # a later case may serve case 1
        (5, 1, "M", "a", 1950, 80, "h", "c3"),    # nobody
        (6, 0, "F", None, 1950, 99, None, None),  # unknown stratum never matches
    ]
    df = spark.createDataFrame(data, "person_id long, case int, sex string, kind string, born int, follow_up_days int, source string, code string")
    df = df.withColumn("date", F.when(F.col("case") == 1, F.date_add(F.lit("2020-01-01").cast("date"), F.col("person_id").cast("int"))))
    sets = M.matched_sets(df, RULES, "date", k=10)
    got = {(r.set, r.person_id, r.case, r.source, r.code, str(r.index_date)) for r in sets.collect()}
    assert got == {
        (1, 1, 1, "h", "c1", "2020-01-02"), (1, 2, 0, None, None, "2020-01-02"), (1, 4, 0, None, None, "2020-01-02"),
    }
    assert rows(M.set_size_distribution(sets)) == [(2, 1, 100.0)]


def test_overlap_rule_equals_brute_force(spark):
    data = people(400, seed=5)
    df = spark.createDataFrame(data, SCHEMA)
    by_id = {d[0]: d for d in data}
    allowed = {
        c: {o for o in s if by_id[o][6] <= by_id[c][7] and by_id[o][7] >= by_id[c][6]} for c, s in eligible(data).items()
    }
    got = defaultdict(set)
    for r in M.sample_overlapping(df, RULES, "start", "end", k=1000).collect():
        got[r.case_id].add(r.control_id)
    assert {c: s for c, s in allowed.items() if s} == dict(got)
    few = M.sample_overlapping(df, RULES, "start", "end", k=3).groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in few} == {c: min(3, len(s)) for c, s in allowed.items() if s}


def test_stratum_sizes(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", 0), ("y", None)], "k string, case int")
    assert rows(M.stratum_sizes(df, ["k"])) == [("x", 1, 1, 1), ("y", 0, 2, 0)]
