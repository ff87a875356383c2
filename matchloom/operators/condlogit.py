"""Conditional logistic regression over matched sets, and pooling of copies.

With one case per set the exact conditional likelihood is a softmax over the
members of the set. A Newton step needs sums over sets of within-set means and
covariances; tasks compute them with numpy on the rows they hold and only the
p + p*p sums per copy reach the driver, which solves the p-by-p system. A set that
lies in several tasks is put together from their moments (largest predictor, weights,
weighted terms and products), which merge in any order.
"""

from __future__ import annotations

import sys
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.vectors import sum_vectors
from matchloom.session import cut_lineage, discard, local_table

# The task functions travel with the job, so executors need numpy and pandas only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NORMAL_975 = 1.96
#: Rows whose products of terms are held at a time.
PIECE = 4_096
PART_SCHEMA = "imp int, member_set string, peak double, vec array<double>"


class ModelError(ValueError):
    """The model cannot be fitted to these data."""


@dataclass
class ConditionalFit:
    """Coefficients per copy with the facts needed to judge them."""

    coefficients: DataFrame
    log_likelihood: dict[int, float]
    steps: int
    n_sets: int
    n_dropped_sets: int


@dataclass
class _Moments:
    """Sums over members of one set, relative to the largest linear predictor seen.

    ``vec`` holds the sum of weights, of weights times terms and of weights times
    products of terms, then what the case adds: its predictor and its terms. Two
    of them merge by scaling the weights to the larger peak.
    """

    imp: int
    member_set: str
    peak: float
    vec: np.ndarray

    def add(self, other: _Moments, weighted: int) -> None:
        peak = max(self.peak, other.peak)
        mine, theirs = math.exp(self.peak - peak), math.exp(other.peak - peak)
        self.vec[:weighted] = mine * self.vec[:weighted] + theirs * other.vec[:weighted]
        self.vec[weighted:] += other.vec[weighted:]
        self.peak = peak


def _moments(frame: pd.DataFrame, terms: Sequence[str], beta: dict[int, np.ndarray]) -> tuple:
    """Copies, sets, peaks and vectors of the sets of a sorted frame, in order."""
    x, case = frame[list(terms)].to_numpy(dtype=float), frame["case"].to_numpy(dtype=float)
    imp, sets = frame["imp"].to_numpy(), frame["member_set"].to_numpy()
    starts = np.concatenate([[0], np.flatnonzero((imp[1:] != imp[:-1]) | (sets[1:] != sets[:-1])) + 1])
    sizes = np.diff(np.append(starts, len(frame)))
    eta = np.einsum("ij,ij->i", x, np.repeat(np.stack([beta[i] for i in imp[starts]]), sizes, axis=0))
    peak = np.maximum.reduceat(eta, starts)
    weight = np.exp(eta - np.repeat(peak, sizes))
    second = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    rows = np.column_stack([weight, weight[:, None] * x, weight[:, None] * second, case * eta, case[:, None] * x])
    return imp[starts], sets[starts], peak, np.add.reduceat(rows, starts, axis=0)


def _finished(peak: np.ndarray, vec: np.ndarray, p: int) -> np.ndarray:
    """What whole sets add: log likelihood, gradient, negative Hessian."""
    total, mean = vec[:, 0], vec[:, 1 : 1 + p] / vec[:, :1]
    hessian = vec[:, 1 + p : 1 + p + p * p] / vec[:, :1] - (mean[:, :, None] * mean[:, None, :]).reshape(len(vec), -1)
    eta_case, of_case = vec[:, 1 + p + p * p], vec[:, 2 + p + p * p :]
    return np.column_stack([eta_case - peak - np.log(total), of_case - mean, hessian])


def _set_sums(terms: Sequence[str], beta: dict[int, np.ndarray]):
    """Task function over rows sorted by copy and set.

    Sets that end inside the partition are finished and summed per copy. The first
    and the last set may go on in another partition; their moments leave as they are,
    at most two rows per task.
    """
    p = len(terms)
    weighted = 1 + p + p * p

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        first: _Moments | None = None
        last: _Moments | None = None
        for frame in batches:
            if not len(frame):
                continue
            # in pieces, since a row has p * p products
            for at in range(0, len(frame), PIECE):
                imps, sets, peaks, vecs = _moments(frame.iloc[at : at + PIECE], terms, beta)
                begin = 0
                if last is not None and (last.imp, last.member_set) == (int(imps[0]), sets[0]):
                    last.add(_Moments(last.imp, last.member_set, float(peaks[0]), vecs[0]), weighted)
                    begin = 1
                if begin == len(imps):
                    continue
                if last is not None and first is None:
                    first = last
                elif last is not None:
                    sums[last.imp] = sums.get(last.imp, 0) + _finished(np.array([last.peak]), last.vec[None, :], p)[0]
                inner = slice(begin + (first is None and last is None), len(imps) - 1)
                if first is None and last is None and len(imps) > 1:
                    first = _Moments(int(imps[0]), sets[0], float(peaks[0]), vecs[0].copy())
                if inner.start < inner.stop:
                    done = _finished(peaks[inner], vecs[inner], p)
                    for imp in np.unique(imps[inner]):
                        sums[int(imp)] = sums.get(int(imp), 0) + done[imps[inner] == imp].sum(axis=0)
                last = _Moments(int(imps[-1]), sets[-1], float(peaks[-1]), vecs[-1].copy())
        rows = [(imp, None, None, v.tolist()) for imp, v in sums.items()]
        rows += [(m.imp, m.member_set, m.peak, m.vec.tolist()) for m in (first, last) if m is not None]
        if rows:
            yield pd.DataFrame(rows, columns=["imp", "member_set", "peak", "vec"])

    return run


def _joined(moments: DataFrame, p: int) -> DataFrame:
    """What sets add whose moments come from several tasks: ``imp``, ``vec``."""
    weighted = 1 + p + p * p
    key = ["imp", "member_set"]
    peaks = moments.groupBy(*key).agg(F.max("peak").alias("top"))
    scaled = F.transform("vec", lambda v, i: F.when(i < weighted, v * F.exp(F.col("peak") - F.col("top"))).otherwise(v))
    cells = moments.join(peaks, key).select(*key, "top", F.posexplode(scaled).alias("at", "x"))
    whole = (
        cells.groupBy(*key, "top", "at").agg(F.sum("x").alias("x"))
        .groupBy(*key, "top").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda c: c["x"]).alias("v"))
    )
    v = lambda i: F.get("v", i)
    places = F.sequence(F.lit(0), F.lit(p - 1))
    gradient = F.transform(places, lambda i: v(i + 2 + p + p * p) - v(i + 1) / v(F.lit(0)))
    hessian = F.flatten(F.transform(places, lambda i: F.transform(
        places, lambda j: v(i * p + j + 1 + p) / v(F.lit(0)) - v(i + 1) * v(j + 1) / v(F.lit(0)) / v(F.lit(0))
    )))
    fit = F.array(v(F.lit(weighted)) - F.col("top") - F.log(v(F.lit(0))))
    return whole.select("imp", F.concat(fit, gradient, hessian).alias("vec"))


def fit_conditional_logistic(
    df: DataFrame,
    terms: Sequence[str],
    set_column: str = "set",
    case: str = "case",
    copy: str | None = None,
    max_steps: int = 50,
    tolerance: float = 1e-8,
    slices: int | None = None,
) -> ConditionalFit:
    """Fit ``case ~ terms`` within sets, for every copy in the same jobs.

    Rows with a null term are left out; sets without a control or without a
    case then carry no information and are dropped and counted. A set with two
    cases is an error. Rows are range partitioned by (copy, set, row), so a set of any
    size spreads over tasks; ``slices`` sets their number, by default Spark does.
    Non-convergence and separation raise.
    """
    terms = list(terms)
    p = len(terms)
    x = [f"_x{i}" for i in range(p)]
    member = F.col(f"`{set_column}`").cast("string")
    rows = cut_lineage(df.select(
        (F.col(copy) if copy else F.lit(0)).cast("int").alias("imp"),
        member.alias("member_set"),
        F.col(case).cast("int").alias("case"),
        *[F.col(f"`{t}`").cast("double").alias(a) for t, a in zip(terms, x)],
        F.xxhash64(F.monotonically_increasing_id()).alias("_spread"),
    ).na.drop(subset=["imp", "member_set", "case", *x]))
    sizes = rows.groupBy("imp", "member_set").agg(F.count(F.lit(1)).alias("_n"), F.sum("case").alias("_cases"))
    good = (F.col("_cases") == 1) & (F.col("_n") > 1)
    facts = sizes.agg(
        F.count(F.when(good, 1)).alias("used"),
        F.count(F.when(~good, 1)).alias("dropped"),
        F.max("_cases").alias("cases"),
    ).first()
    if (facts["cases"] or 0) > 1:
        raise ModelError("a set has more than one case")
    if not facts["used"]:
        raise ModelError("no set has both its case and a control")
    order = ["imp", "member_set", "_spread"]
    kept = cut_lineage(rows.join(sizes.where(good).select("imp", "member_set"), ["imp", "member_set"], "left_semi"))
    prepared = (
        (kept.repartitionByRange(slices, *order) if slices else kept.repartitionByRange(*order))
        .sortWithinPartitions("imp", "member_set")
        .drop("_spread")
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        spread = prepared.agg(*[F.stddev_pop(c).alias(c) for c in x]).first()
        scale = np.array([spread[c] or 0.0 for c in x])
        flat = [t for t, s in zip(terms, scale) if s < 1e-12]
        if flat:
            raise ModelError(f"terms do not vary: {flat}")
        scaled = prepared.select("imp", "member_set", "case", *[(F.col(c) / float(s)).alias(c) for c, s in zip(x, scale)])

        def evaluate(beta: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
            parts = cut_lineage(scaled.mapInPandas(_set_sums(x, beta), PART_SCHEMA))
            cut = parts.where(F.col("member_set").isNotNull())
            out = sum_vectors(parts.where(F.col("member_set").isNull()).select("imp", "vec").unionByName(_joined(cut, p)))
            discard(parts)
            return out

        copies = [r["imp"] for r in prepared.select("imp").distinct().collect()]
        beta = {i: np.zeros(p) for i in copies}
        now = evaluate(beta)
        for steps in range(1, max_steps + 1):
            move = {i: _solve(now[i], p, terms) for i in copies}
            change = max(np.abs(move[i]).max() for i in copies)
            trial = {i: beta[i] + move[i] for i in copies}
            after = evaluate(trial)
            for _ in range(20):
                worse = [i for i in copies if after[i][0] < now[i][0] - 1e-9 * abs(now[i][0])]
                if not worse:
                    break
                for i in worse:
                    move[i] = move[i] / 2
                    trial[i] = beta[i] + move[i]
                after = evaluate(trial)
            else:
                raise ModelError("the likelihood does not improve along the Newton step")
            beta, now = trial, after
            far = sorted({t for i in copies for t, b in zip(terms, beta[i]) if abs(b) > 30})
            if far:
                raise ModelError(f"estimates run away, the cases may be separated by {far}")
            if change < tolerance:
                break
        else:
            raise ModelError(f"no convergence in {max_steps} steps, last change {change:.3g}")
        out = []
        for i in sorted(copies):
            covariance = np.linalg.inv(now[i][1 + p:].reshape(p, p))
            error = np.sqrt(np.diag(covariance)) / scale
            out += [(i, t, float(b), float(e)) for t, b, e in zip(terms, beta[i] / scale, error)]
    finally:
        prepared.unpersist()
    table = local_table(df.sparkSession, out, "imp int, term string, estimate double, std_error double")
    return ConditionalFit(
        table if copy else table.drop("imp"),
        {i: float(now[i][0]) for i in sorted(copies)},
        steps,
        facts["used"],
        facts["dropped"],
    )


def _solve(sums: np.ndarray, p: int, terms: Sequence[str]) -> np.ndarray:
    gradient, hessian = sums[1:1 + p], sums[1 + p:].reshape(p, p)
    size = np.abs(np.diag(hessian))
    weak = [t for t, d in zip(terms, size) if d < 1e-10]
    if weak:
        raise ModelError(f"terms carry no information within sets: {weak}")
    if np.linalg.cond(hessian) > 1e13:
        raise ModelError("the terms are collinear within sets, or the cases are separated")
    return np.linalg.solve(hessian, gradient)


def pool_estimates(copies: DataFrame, complete_df: float | None = None) -> DataFrame:
    """Rubin's rules over ``imp, term, estimate, std_error`` (Rubin 1987).

    The variance is the mean within-copy variance plus (1 + 1/m) times the
    variance between copies; a single copy has no between part. ``statistic`` is
    the estimate over its error, ``df`` its degrees of freedom (Barnard and Rubin
    1999, with ``complete_df`` those of the complete data, else Rubin's of 1987;
    null where they are infinite), ``p_value`` two-sided.
    """
    m, within, between = F.col("n_copies"), F.col("within"), F.col("between")
    extra = (1 + 1 / m) * between
    share = extra / (within + extra)
    old = F.when((between > 0) & (m > 1), (m - 1) / (share * share))
    if complete_df is None:
        free = old
    else:
        nu = F.lit(float(complete_df))
        observed = (nu + 1) / (nu + 3) * nu * (1 - share)
        free = F.when(old.isNull(), observed).otherwise(old * observed / (old + observed))

    @F.pandas_udf("double")
    def two_sided(statistic: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([_two_sided(t, d) for t, d in zip(statistic, df)], dtype=float)

    return (
        copies.groupBy("term")
        .agg(
            F.count(F.lit(1)).alias("n_copies"),
            F.avg("estimate").alias("estimate"),
            F.avg(F.col("std_error") * F.col("std_error")).alias("within"),
            F.coalesce(F.var_samp("estimate"), F.lit(0.0)).alias("between"),
        )
        .withColumn("std_error", F.sqrt(within + extra))
        .withColumn("statistic", F.col("estimate") / F.col("std_error"))
        .withColumn("df", free)
        .withColumn("p_value", two_sided("statistic", "df"))
        .select("term", "estimate", "std_error", "within", "between", "n_copies", "statistic", "df", "p_value")
    )


def _two_sided(statistic: float, df: float) -> float:
    """P value of Student's t, by the trapezoid rule on the bounded angle; normal without ``df``."""
    if statistic is None or np.isnan(statistic):
        return float("nan")
    if df is None or np.isnan(df):
        return math.erfc(abs(statistic) / math.sqrt(2))
    # with t = sqrt(df) tan(a) the density is cos(a)^(df - 1)
    angle = np.arctan(abs(statistic) / math.sqrt(df))
    grid = np.linspace(0, np.pi / 2, 20_001)
    total = np.trapezoid(np.exp((df - 1) * np.log(np.maximum(np.cos(grid), 1e-300))), grid)
    tail = np.linspace(angle, np.pi / 2, 20_001)
    return float(np.trapezoid(np.exp((df - 1) * np.log(np.maximum(np.cos(tail), 1e-300))), tail) / total)


def odds_ratios(estimates: DataFrame) -> DataFrame:
    """Add the odds ratio and its 95 % interval."""
    b, half = F.col("estimate"), NORMAL_975 * F.col("std_error")
    return estimates.withColumns({"OR": F.exp(b), "OR_lower": F.exp(b - half), "OR_upper": F.exp(b + half)})
