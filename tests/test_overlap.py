"""Overlap matching from counts: few overlaps in a large cell, ties, bad windows."""

import random
from collections import Counter

from pyspark.sql import functions as F

from conftest import rows
from matchloom.operators import matching as M

RULES = M.MatchRules(exact=("kind",), cases_as_controls=False)
SCHEMA = "person_id long, case int, kind string, follow_up_days int, start int, end int"


def test_two_of_two_thousand_are_found_without_a_walk(spark, monkeypatch):
    people = [(i, 0, "a", 100 + i % 7, 1000, 1100) for i in range(2000)]
    people[17] = (17, 0, "a", 105, 5, 9)
    people[1203] = (1203, 0, "a", 101, 1, 40)
    cases = [(5000 + i, 1, "a", 100, 8, 20) for i in range(20)] + [(6000, 1, "a", 100, 500, 510), (6001, 1, "b", 1, 0, 9)]
    sizes = []
    counts = M.overlap_counts
    monkeypatch.setattr(M, "overlap_counts", lambda c, asked, *a: sizes.append(asked.count()) or counts(c, asked, *a))
    out = M.sample_overlapping(spark.createDataFrame(people + cases, SCHEMA), RULES, "start", "end", k=10)
    got = {}
    for r in out.collect():
        got.setdefault(r.case_id, set()).add(r.control_id)
    assert got == {5000 + i: {17, 1203} for i in range(20)}
    assert sum(sizes) < 22 * 120  # blocks looked at, not the two thousand people of the cell


def test_counts_of_blocks_equal_brute_force(spark):
    rng = random.Random(2)
    window = lambda: sorted((rng.randrange(50), rng.randrange(50)))
    controls = [("c", n, 1000 + n, *window()) for n in range(1, 200)]
    asked = [("c", i, level, rng.randrange(4), *window()) for i, level in enumerate([0, 1, 2] * 30)]
    out = M.overlap_counts(
        spark.createDataFrame(controls, "kind string, _number long, control_id long, _from int, _to int"),
        spark.createDataFrame(asked, "kind string, _id long, _level int, _block long, _from int, _to int"), ["kind"], range(3),
    )
    want = [
        (i, level, block, sum((n - 1) >> (3 * level) == block and a <= end and b >= start for _, n, _, a, b in controls))
        for _, i, level, block, start, end in asked
    ]
    assert rows(out.select("_id", "_level", "_block", "_n")) == rows(spark.createDataFrame(want))


def test_subsets_are_even_own_row_is_left_out_and_bad_windows_overlap_nothing(spark):
    people = [(i, 0, "a", 10, 0, 9) for i in range(6)] + [(50, 0, "a", 10, 9, 0), (51, 0, "a", 10, None, 9), (52, 0, "a", 9, 0, 9), (53, 0, "a", 10, 200, 300)]
    cases = [(100 + i, 1, "a", 10, 5, 100) for i in range(300)] + [(900, 1, "a", 10, 7, 5)]
    df = spark.createDataFrame(people + cases, SCHEMA)
    out = M.sample_overlapping(df, RULES, "start", "end", k=2).collect()
    pairs = {}
    for r in out:
        pairs.setdefault(r.case_id, []).append(r.control_id)
    seen = Counter(tuple(sorted(p)) for p in pairs.values())
    assert len(pairs) == 300 and len(seen) == 15 and min(seen.values()) >= 8
    own = M.sample_overlapping(df, M.MatchRules(exact=("kind",)), "start", "end", k=1000).where("case_id = control_id")
    assert own.isEmpty()
    every = M.sample_overlapping(df.where("person_id < 102"), M.MatchRules(exact=("kind",)), "start", "end", k=1000)
    assert {(r.case_id, r.control_id) for r in every.collect()} == {(c, o) for c in (100, 101) for o in (*range(6), 100, 101) if o != c}
    assert M.sample_overlapping(df.where("case = 0"), RULES, "start", "end").isEmpty()


def test_blocks_below_a_leaf_are_looked_at_and_not_counted(spark, monkeypatch):
    rng = random.Random(5)
    window = lambda: sorted((rng.randrange(40), rng.randrange(40)))
    people = [(i, 0, "ab"[i % 2], rng.randrange(50), *window()) for i in range(700)] + [(2000, 0, "c", 9, 0, 9)]
    cases = [(5000 + i, 1, "abc"[i % 3], rng.randrange(50), *window()) for i in range(40)]
    levels = []
    counts = M.overlap_counts
    monkeypatch.setattr(M, "overlap_counts", lambda c, asked, cell, at: levels.extend(at) or counts(c, asked, cell, at))
    df = spark.createDataFrame(people + cases, SCHEMA)
    got = {(r.case_id, r.control_id) for r in M.sample_overlapping(df, RULES, "start", "end", k=1000).collect()}
    want = {
        (c[0], p[0]) for c in cases for p in people
        if p[2] == c[2] and p[3] >= c[3] and p[4] <= c[5] and p[5] >= c[4]
    }
    assert got == want
    assert levels and min(levels) >= 2  # below, a running count per level of every control and every draw
