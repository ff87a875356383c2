"""Matching of imputed values over slices: the same donors as in one slice, few jobs, no row more."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import impute as I

PLAN = I.ImputationPlan(targets=("y", "kind"), predictors=("x",), levels={"kind": ("a", "b", "c")})


def table(spark, n, tied):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = float(rng.randrange(4) if tied else rng.random() * 9)
        rows.append((i, x, None if i % 4 == 1 else 2 * x + (0 if tied else rng.random()), None if i % 5 == 2 else rng.choice("abc")))
    return spark.createDataFrame(rows, "id long, x double, y double, kind string")


@pytest.mark.parametrize("tied", [False, True])
def test_slices_draw_the_same_donors(spark, monkeypatch, tied):
    df = table(spark, 400, tied).cache()
    fit = lambda: sorted(map(tuple, I.impute_chained(df, "id", PLAN, copies=(1, 2), cycles=2).copies.collect()))
    monkeypatch.setattr(I, "SLICE_ROWS", 10**6, raising=False)
    whole = fit()
    monkeypatch.setattr(I, "SLICE_ROWS", 40, raising=False)
    assert fit() == whole and len(whole) == 800


def test_repeated_keys_stay_as_many(spark):
    df = table(spark, 60, False)
    out = I.impute_chained(df.union(df), "id", PLAN, copies=(1,), cycles=1).copies
    assert out.count() == 120 and out.where(F.col("y").isNull() | F.col("kind").isNull()).isEmpty()


def test_a_step_takes_few_jobs(spark):
    context = spark.sparkContext
    df = table(spark, 200, False).cache()
    count = []
    for cycles in (1, 2):
        context.setJobGroup(f"cycles {cycles}", "imputation")
        I.impute_chained(df, "id", PLAN, copies=(1,), cycles=cycles)
        count.append(len(context.statusTracker().getJobIdsForGroup(f"cycles {cycles}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert count[1] - count[0] <= 40
