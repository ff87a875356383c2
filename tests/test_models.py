import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchloom.operators import condlogit as CL
from matchloom.operators import impute as I
from matchloom.sources import batches as B
from conftest import rows


def newton(sets, p, steps=30):
    """Plain conditional logistic fit, set by set."""
    beta = np.zeros(p)
    for _ in range(steps):
        g, h, ll = np.zeros(p), np.zeros((p, p)), 0.0
        for x, case in sets:
            w = np.exp(x @ beta)
            w /= w.sum()
            mean = w @ x
            g += x[case] - mean
            h += x.T @ (w[:, None] * x) - np.outer(mean, mean)
            ll += math.log(w[case])
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h))), ll


def simulated(n_sets=150, size=5, seed=2):
    rng = np.random.default_rng(seed)
    data, sets = [], []
    for s in range(n_sets):
        x = np.column_stack([rng.integers(0, 2, size).astype(float), rng.normal(100, 15, size)])
        w = np.exp(x @ np.array([0.8, -0.02]))
        case = rng.choice(size, p=w / w.sum())
        sets.append((x, case))
        data += [(s, int(j == case), float(x[j, 0]), float(x[j, 1])) for j in range(size)]
    return data, sets


def test_discordant_pairs_give_the_odds_ratio(spark):
    pairs = [(1, 0)] * 30 + [(0, 1)] * 12 + [(1, 1)] * 5 + [(0, 0)] * 9
    data = [(s, c, x) for s, (a, b) in enumerate(pairs) for c, x in ((1, a), (0, b))]
    data += [(900, 1, 1), (901, 0, 1)]  # a case alone, a control alone
    fit = CL.fit_conditional_logistic(spark.createDataFrame(data, "set int, case int, x int"), ["x"])
    out = CL.odds_ratios(fit.coefficients).first()
    assert out.OR == pytest.approx(30 / 12)
    assert out.std_error == pytest.approx(math.sqrt(1 / 30 + 1 / 12))
    assert out.OR_lower == pytest.approx(2.5 * math.exp(-1.96 * out.std_error))
    assert (fit.n_sets, fit.n_dropped_sets) == (56, 2)


@pytest.mark.parametrize("slices", [None, 1, 60])
def test_fit_equals_plain_newton_also_with_cut_sets(spark, slices, monkeypatch):
    data, sets = simulated()
    df = spark.createDataFrame(data, "set int, case int, a double, b double")
    monkeypatch.setattr(CL, "PIECE", 7)
    fit = CL.fit_conditional_logistic(df, ["a", "b"], slices=slices)
    beta, error, ll = newton(sets, 2)
    got = {r.term: (r.estimate, r.std_error) for r in fit.coefficients.collect()}
    assert got["a"] == pytest.approx((beta[0], error[0]), rel=1e-6)
    assert got["b"] == pytest.approx((beta[1], error[1]), rel=1e-6)
    assert fit.log_likelihood[0] == pytest.approx(ll, rel=1e-9)


def test_one_set_over_all_tasks(spark):
    """Two sets of thousands of members, cut into more slices than sets, and small ones between."""
    rng = np.random.default_rng(5)
    data, sets = [], []
    for s, size in enumerate([4000, *[4] * 40, 6000]):
        x = rng.normal(size=(size, 2))
        w = np.exp(x @ np.array([0.5, -0.3]))
        case = rng.choice(size, p=w / w.sum())
        sets.append((x, case))
        data += [(s, int(j == case), float(x[j, 0]), float(x[j, 1])) for j in range(size)]
    fit = CL.fit_conditional_logistic(spark.createDataFrame(data, "set int, case int, a double, b double"), ["a", "b"], slices=16)
    beta, error, ll = newton(sets, 2)
    got = {r.term: (r.estimate, r.std_error) for r in fit.coefficients.collect()}
    assert got["a"] == pytest.approx((beta[0], error[0]), rel=1e-6) and got["b"] == pytest.approx((beta[1], error[1]), rel=1e-6)
    assert fit.log_likelihood[0] == pytest.approx(ll, rel=1e-9) and fit.n_sets == 42


def test_moments_merge_in_any_order():
    rng = np.random.default_rng(1)
    frame = lambda rows: pd.DataFrame({"imp": 1, "member_set": "s", "case": [int(i == 3) for i in rows], "x": data[rows, 0], "y": data[rows, 1]})
    data, beta = rng.normal(0, 40, size=(30, 2)), {1: np.array([3.0, -2.0])}
    take = lambda rows: CL._Moments(1, "s", *(v[0] for v in CL._moments(frame(rows), ["x", "y"], beta)[2:]))
    whole = take(np.arange(30))
    for parts in ([(0, 7), (7, 20), (20, 30)], [(20, 30), (0, 7), (7, 20)]):
        merged = take(np.arange(*parts[0]))
        for part in parts[1:]:
            merged.add(take(np.arange(*part)), 7)
        assert merged.peak == pytest.approx(whole.peak) and merged.vec == pytest.approx(whole.vec)


def test_copies_are_fitted_together(spark):
    data, sets = simulated(60)
    other, other_sets = simulated(60, seed=9)
    rows_ = [(1, *r) for r in data] + [(2, *r) for r in other]
    fit = CL.fit_conditional_logistic(spark.createDataFrame(rows_, "imp int, set int, case int, a double, b double"), ["a", "b"], copy="imp")
    got = {(r.imp, r.term): r.estimate for r in fit.coefficients.collect()}
    for imp, s in ((1, sets), (2, other_sets)):
        beta, _, _ = newton(s, 2)
        assert (got[imp, "a"], got[imp, "b"]) == pytest.approx(tuple(beta), rel=1e-6)


def test_models_that_cannot_be_fitted(spark):
    schema = "set int, case int, x int, y int"
    separated = spark.createDataFrame([(s, c, c, (s + c) % 2) for s in range(20) for c in (0, 1)], schema)
    with pytest.raises(CL.ModelError):
        CL.fit_conditional_logistic(separated, ["x"])
    with pytest.raises(CL.ModelError, match="no information within sets"):
        CL.fit_conditional_logistic(separated.withColumn("z", F.col("set")), ["z"])
    with pytest.raises(CL.ModelError, match="do not vary"):
        CL.fit_conditional_logistic(separated.withColumn("z", F.lit(1)), ["z"])
    with pytest.raises(CL.ModelError, match="more than one case"):
        CL.fit_conditional_logistic(separated.withColumn("case", F.lit(1)), ["y"])
    with pytest.raises(CL.ModelError, match="no set"):
        CL.fit_conditional_logistic(separated.where("case = 1"), ["y"])


def test_pooling_by_hand(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.5), (2, "a", 2.0, 0.7), (3, "a", 3.0, 0.6), (1, "b", 1.0, 0.5)], "imp int, term string, estimate double, std_error double")
    got = {r.term: r for r in CL.pool_estimates(df).collect()}
    assert got["a"].estimate == 2.0
    assert got["a"].within == pytest.approx((0.25 + 0.49 + 0.36) / 3)
    assert got["a"].between == pytest.approx(1.0)
    assert got["a"].std_error == pytest.approx(math.sqrt((0.25 + 0.49 + 0.36) / 3 + 4 / 3))
    assert (got["b"].std_error, got["b"].n_copies) == (0.5, 1)


PLAN = I.ImputationPlan(targets=("y", "g"), predictors=("x",), levels={"g": ("a", "b", "c")})


def gappy(spark, n=400):
    rng = random.Random(4)
    data = []
    for i in range(n):
        x = rng.gauss(0, 1)
        y = 3 * x + rng.gauss(0, 0.1)
        data.append((i, x, None if i % 4 == 0 else y, None if i % 5 == 0 else ("a" if x < -0.5 else "b" if x < 0.5 else "c")))
    return spark.createDataFrame(data, "id long, x double, y double, g string"), data


def test_imputation_properties(spark):
    df, data = gappy(spark)
    result = I.impute_chained(df, "id", PLAN, copies=(1, 2), cycles=1, seed=5)
    out = result.copies.collect()
    assert Counter(r.imp for r in out) == {1: 400, 2: 400}
    by_id = {d[0]: d for d in data}
    seen_y, seen_g = {d[2] for d in data}, {d[3] for d in data}
    error, moved = [], 0
    for r in out:
        _, x, y, g = by_id[r.id]
        assert r.y is not None and r.g is not None
        assert y is None or r.y == y
        assert g is None or r.g == g
        assert r.y in seen_y and r.g in seen_g
        if y is None:
            error.append(abs(r.y - 3 * x))
    assert sum(error) / len(error) < 0.5  # a random donor would be about 3.4 away
    pairs = {}
    for r in out:
        if by_id[r.id][2] is None:
            pairs.setdefault(r.id, []).append(r.y)
    assert any(a != b for a, b in pairs.values())
    assert rows(result.original) == sorted(data, key=lambda t: tuple((v is None, str(v)) for v in t))
    assert result.stacked().where("imp = 0").count() == 400
    trace = {(r.cycle, r.imp, r.variable): r.n_imputed for r in result.trace.collect()}
    assert trace == {(1, i, v): n for i in (1, 2) for v, n in (("y", 100), ("g", 80))}
    assert I.observed_imputed_histogram(result, "id", "y", 1.0).where("kind = 'imputed'").agg(F.sum("n")).first()[0] == 200


def test_a_copy_alone_equals_the_copy_among_others(spark, tmp_path):
    df, _ = gappy(spark, 120)
    plan = I.ImputationPlan(targets=("y",), predictors=("x",))
    both = I.impute_chained(df, "id", plan, copies=(1, 2), cycles=2, seed=5).copies
    path = str(tmp_path / "copies")
    work = lambda i: I.impute_chained(df.repartition(5), "id", plan, copies=(i,), cycles=2, seed=5).copies.drop("imp")
    B.run_missing(spark, path, [2], work)
    alone = B.read_batches(spark, path).select("imp", "id", "x", "y")
    assert rows(alone) == rows(both.where("imp = 2").select("imp", "id", "x", "y"))


def test_few_donors_and_bad_inputs(spark):
    one = spark.createDataFrame([(1, 1.0, 7.0), (2, 2.0, None), (3, 2.0, None)], "id int, x double, y double")
    plan = I.ImputationPlan(targets=("y",), predictors=("x",))
    assert {r.y for r in I.impute_chained(one, "id", plan, copies=(1,), cycles=1).copies.collect()} == {7.0}
    with pytest.raises(ValueError, match="no observed value"):
        I.impute_chained(one.withColumn("y", F.lit(None).cast("double")), "id", plan, copies=(1,))
    with pytest.raises(ValueError, match="predictors with nulls"):
        I.impute_chained(one, "id", I.ImputationPlan(targets=("x",), predictors=("y",)), copies=(1,))


def test_constant_predictions_still_find_donors(spark):
    """All predictions tie; the pool is every observed value."""
    df = spark.range(300).select("id", F.lit(1.0).alias("x"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("y"))
    plan = I.ImputationPlan(targets=("y",), predictors=("x",))
    out = I.impute_chained(df, "id", plan, copies=(1,), cycles=1).copies
    assert out.where("y is null").count() == 0
    assert out.where("id % 3 = 0").select("y").distinct().count() > 1


def test_p_values_of_students_t():
    from matchloom.operators.condlogit import _two_sided

    for statistic, df, want in ((2.0, 10.0, 0.073388), (12.706, 1.0, 0.05), (1.96, 1e6, 0.04999), (0.0, 5.0, 1.0), (2.5758, None, 0.01)):
        assert abs(_two_sided(statistic, df) - want) < 2e-4


def test_tied_donors_are_all_used(spark):
    import matchloom.operators.impute as I

    rows = [(i, 1.0, float(i) if i < 2000 else None, i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, one double, y double, half int")
    constant = I.impute_chained(df, "id", I.ImputationPlan(("y",), ("one",)), copies=(1, 2), cycles=2)
    chosen = {c: [r.y for r in constant.copies.where(f"imp = {c} AND id >= 2000").orderBy("id").collect()] for c in (1, 2)}
    assert all(len(set(v)) > 600 for v in chosen.values())
    assert chosen[1] != chosen[2]
    binary = I.impute_chained(df, "id", I.ImputationPlan(("y",), ("half",)), copies=(1,), cycles=1)
    assert binary.copies.where("id >= 2000").select("y").distinct().count() > 600
    apart = I.impute_strata(df, "id", I.ImputationPlan(("y",), ("one",)), "half", copies=(1,), cycles=1)
    for half in (0, 1):
        assert {int(r.y) % 2 for r in apart.copies.where(f"id >= 2000 AND half = {half}").collect()} == {half}
