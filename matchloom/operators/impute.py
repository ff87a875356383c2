"""Multiple imputation by chained equations with predictive mean matching.

Method: van Buuren and Groothuis-Oudshoorn, Journal of Statistical Software
45(3), 2011. All copies and strata move together.

State. A row without gaps is the same in every copy, so it is kept once. Only rows
with a gap are held per copy. A variable's step carries them through its sort, so what
comes out is the next state and no join by key is needed.

Equations. Every row gives one vector: the intercept, all predictors, all targets.
The sums of its products are taken once for rows without gaps and, per step, for
the others; an equation is a choice of rows and columns of that matrix, so which
predictors enter is data (``ImputationPlan.matrix``). Constant and collinear
predictors are left out by a pivoted Cholesky factorisation and reported. The driver
sees one matrix per stratum and copy. Random numbers come from hashes.

Matching. Donors are numbered in order of prediction, and donors with one prediction
are a range of numbers. Donors and recipients of a step are range partitioned and sorted once.
Each slice says which ranges lie at its ends; the driver puts these together, a few per
slice and copy, so every slice knows the ranges next to it. A recipient meets the ranges
nearest to its prediction, fills its five places from them, draws a place, and then a donor
of that range at random, so tied donors are all as likely. A donor of the same slice
is read there, one of another slice is joined by its number.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from matchloom.operators.matching import HASH_DIGITS, HASH_RANGE, hash_number
from matchloom.operators.ranking import running_total
from matchloom.operators.vectors import sum_vectors
from matchloom.session import broadcast_if_small, cut_lineage, discard, local_table

# The task functions travel with the job, so executors need numpy, pandas and pyarrow only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DONORS = 5
#: Share of a predictor's own variation below which the others explain it.
COLLINEAR = 1e-9
#: Strata whose equations the driver solves in one step.
MOST_STRATA = 1_000
#: Rows of a slice of sorted predictions, and recipients whose donors are drawn at a time.
SLICE_ROWS, PIECE = 1 << 17, 1 << 14
EDGE_SCHEMA = "_slice int, _cell int, n bigint, low double, high double, scores array<double>, firsts array<bigint>, counts array<bigint>"
EDGE_NAMES = ["_slice", "_cell", "n", "low", "high", "scores", "firsts", "counts"]
EDGE_TYPES = [
    pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())
]


@dataclass(frozen=True)
class ImputationPlan:
    """What is imputed, and from what.

    ``targets`` are imputed in this order. ``predictors`` enter every equation
    (with the other targets) and must be complete. ``levels`` lists the values
    of categorical columns: as predictors they become 0/1 columns without the
    first level, as targets they are matched on their position in the list.
    ``excluded`` names, per target, predictors to leave out.
    """

    targets: tuple[str, ...]
    predictors: tuple[str, ...] = ()
    levels: Mapping[str, Sequence] = field(default_factory=dict)
    excluded: Mapping[str, Sequence[str]] = field(default_factory=dict)

    def inputs(self, target: str) -> list[str]:
        left_out = {target, *self.excluded.get(target, ())}
        return [c for c in (*self.predictors, *self.targets) if c not in left_out]

    def features(self) -> list[tuple[str, str, Column]]:
        """The vector of a row as (column, name, value): intercept, predictors and targets, positions of categorical targets."""
        out = [("", "(intercept)", F.lit(1.0))]
        for name in (*self.predictors, *self.targets):
            if name in self.levels:
                out += [(name, f"{name}={v}", (F.col(name) == v).cast("double")) for v in self.levels[name][1:]]
            else:
                out.append((name, name, F.col(name).cast("double")))
        return out + [(f"position of {t}", t, self.response(t)) for t in self.targets if t in self.levels]

    def matrix(self) -> dict[str, tuple[list[int], int]]:
        """Per target: the places in a row's vector that enter its equation, and the place of its response."""
        owners = [owner for owner, _, _ in self.features()]
        return {
            t: (
                [0] + [i for i, owner in enumerate(owners) if owner in set(self.inputs(t))],
                owners.index(f"position of {t}" if t in self.levels else t),
            )
            for t in self.targets
        }

    def response(self, target: str) -> Column:
        if target not in self.levels:
            return F.col(target).cast("double")
        out = F.lit(None).cast("double")
        for position, value in enumerate(self.levels[target]):
            out = F.when(F.col(target) == value, float(position)).otherwise(out)
        return out


@dataclass
class Imputation:
    """``copies`` holds ``imp`` 1..m completed; ``original`` keeps the nulls.

    ``trace`` has mean and deviation of the imputed cells per cycle; ``dropped`` the
    predictors left out of an equation as constant or collinear.
    """

    copies: DataFrame
    original: DataFrame
    trace: DataFrame
    dropped: DataFrame

    def stacked(self) -> DataFrame:
        """The original as ``imp`` 0 above the completed copies."""
        first = self.original.withColumn("imp", F.lit(0))
        return first.unionByName(self.copies.select(*first.columns))


def _cross_products(columns: Sequence[str]):
    """Task function: Z'Z per stratum and copy, summed over the batches of a partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in batches:
            z, cells = frame[list(columns)].to_numpy(dtype=float), frame["_cell"].to_numpy()
            order = np.argsort(cells, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(cells[order]) != 0]) if len(order) else []
            for cell, rows in zip(cells[order][starts], np.split(order, starts[1:])):
                sums[int(cell)] = sums.get(int(cell), 0) + z[rows].T @ z[rows]
        if sums:
            yield pd.DataFrame({"_cell": list(sums), "vec": [s.ravel().tolist() for s in sums.values()]})

    return run


def _products(rows: DataFrame, plan: ImputationPlan) -> dict[int, np.ndarray]:
    """Sums of products of the vectors of ``rows``, per ``_cell``."""
    names = [f"_z{i}" for i in range(len(plan.features()))]
    vectors = rows.select(F.col("_cell").cast("long"), *[c.alias(n) for n, (_, _, c) in zip(names, plan.features())])
    sums = sum_vectors(vectors.mapInPandas(_cross_products(names), "_cell bigint, vec array<double>"), key="_cell")
    return {cell: s.reshape(len(names), len(names)) for cell, s in sums.items()}


def _hash_numbers(texts: Sequence[str], *parts) -> np.ndarray:
    """``hash_number`` of the parts and each text, which holds the last parts joined."""
    start = hashlib.md5("".join(f"{p}|" for p in parts).encode())

    def one(text: str) -> int:
        digest = start.copy()
        digest.update(text.encode())
        return int(digest.hexdigest()[:HASH_DIGITS], 16)

    return np.fromiter(map(one, texts), dtype=np.int64, count=len(texts))


def normal_draw(*parts) -> float:
    """A standard normal number from the hashes of the parts (Box and Muller, 1958)."""
    uniform = [int(hashlib.md5("|".join(map(str, (*parts, i))).encode()).hexdigest()[:HASH_DIGITS], 16) / HASH_RANGE for i in "ab"]
    return math.sqrt(-2 * math.log(1 - uniform[0])) * math.cos(2 * math.pi * uniform[1])


def chi_square(z: float, free: float) -> float:
    """The chi-square quantile of a standard normal number (Wilson and Hilferty, 1931)."""
    return free * max(1 - 2 / (9 * free) + z * math.sqrt(2 / (9 * free)), 1e-6) ** 3


def independent_columns(products: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Columns kept by a pivoted Cholesky factorisation, in pivot order, and their upper factor.

    The first column, the intercept, is always taken first. A column whose own
    variation is explained by those taken is left out.
    """
    size = len(products)
    left, rows, kept = np.diag(products).astype(float).copy(), [], []
    start = left.copy()
    while len(kept) < size:
        share = np.where(start > 0, left / np.where(start > 0, start, 1), 0)
        share[kept] = -1
        pivot = 0 if not kept else int(np.argmax(share))
        if kept and share[pivot] <= COLLINEAR or left[pivot] <= 0:
            break
        row = (products[pivot] - sum((r[pivot] * r for r in rows), np.zeros(size))) / math.sqrt(left[pivot])
        row[kept] = 0
        rows.append(row)
        left = left - row**2
        kept.append(pivot)
    return kept, np.array([r[kept] for r in rows])


def draw_coefficients(products: np.ndarray, chosen: Sequence[int], response: int, *seeds) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Least-squares coefficients, a draw from their posterior, and the places left out.

    Coefficients are vectors as long as a row's; the draw adds sigma times the inverse
    of the upper factor times normal numbers, sigma from the residual sum over a
    chi-square number.
    """
    chosen = list(chosen)
    xx, xy, yy = products[np.ix_(chosen, chosen)], products[chosen, response], products[response, response]
    kept, upper = independent_columns(xx)
    beta = np.linalg.solve(upper, np.linalg.solve(upper.T, xy[kept]))
    free = max(int(round(xx[0, 0])) - len(kept), 1)
    residual = max(yy - beta @ xy[kept], 0.0)
    sigma = math.sqrt(residual / chi_square(normal_draw(*seeds, "sigma"), free))
    z = np.array([normal_draw(*seeds, i) for i in range(len(kept))])
    fit, draw = np.zeros(len(products)), np.zeros(len(products))
    places = [chosen[k] for k in kept]
    fit[places], draw[places] = beta, beta + sigma * np.linalg.solve(upper, z)
    return fit, draw, [c for c in chosen if c not in places]


def _started(state: DataFrame, rows: DataFrame, key: str, target: str, seed: int) -> DataFrame:
    """Rows with gaps, a random observed value of the stratum in every missing cell of one variable."""
    observed = running_total(rows.where(F.col(target).isNotNull()).select("_stratum", key, target), [key], ["_stratum"], out="_number")
    counts = rows.groupBy("_stratum").agg(F.count(target).alias("_n"))
    drawn = F.pmod(hash_number(F.lit(seed), F.lit("start"), F.lit(target), F.col("imp"), F.col(key)), F.col("_n")) + 1
    missing = state.where(f"`_missing_{target}`").drop(target).join(F.broadcast(counts), "_stratum").withColumn("_number", drawn)
    filled = missing.join(observed.select("_stratum", "_number", target), ["_stratum", "_number"]).drop("_number", "_n")
    return state.where(~F.col(f"_missing_{target}")).unionByName(filled)


class _Slice:
    """A partition of the rows of a step, sorted by cell, prediction, donors first, and id, cut where the cell changes."""

    def __init__(self, batches: Iterator[pa.RecordBatch]) -> None:
        parts = list(batches)
        self.table = pa.Table.from_batches(parts) if parts else None
        self.pieces: list[tuple[int, int, tuple[int, int]]] = []
        if self.table is None or not self.table.num_rows:
            return
        numbers, cells = (self.table[c].to_numpy() for c in ("_slice", "_cell"))
        self.score, self.asks = self.table["_score"].to_numpy(), self.table["_asks"].to_numpy().astype(bool)
        starts = np.flatnonzero(np.r_[True, (np.diff(numbers) != 0) | (np.diff(cells) != 0)])
        for at, end in zip(starts, np.r_[starts[1:], len(cells)]):
            self.pieces.append((int(at), int(end), (int(numbers[at]), int(cells[at]))))

    def ties(self, at: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a piece's donors, and their different predictions with place of the first donor and count."""
        donors = at + np.flatnonzero(~self.asks[at:end])
        return donors, *np.unique(self.score[donors], return_index=True, return_counts=True)


def _edges(places: int):
    """Task function: per piece its range of predictions, number of donors and the outermost tied donors on both ends."""
    edge = places + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = _Slice(batches), []
        for at, end, (number, cell) in part.pieces:
            donors, *ties = part.ties(at, end)
            n = len(ties[0])
            outer = np.arange(n) if n <= 2 * edge else np.r_[0:edge, n - edge : n]
            rows.append((number, cell, len(donors), float(part.score[at]), float(part.score[end - 1]), *[t[outer].tolist() for t in ties]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), EDGE_TYPES)], names=EDGE_NAMES)

    return run


def _surroundings(edges: list, places: int) -> dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece: the donors of its cell before it, and the tied donors on and next to its ends (prediction, low, n).

    Ties that lie in several pieces are put together, so low and n hold for the whole cell.
    """
    edge, cells = places + 1, {}
    for row in sorted(edges, key=lambda r: (r["_cell"], r["_slice"])):
        known, pieces = cells.setdefault(row["_cell"], ([], []))
        base = pieces[-1][-1] if pieces else 0
        for score, first, n in zip(row["scores"], row["firsts"], row["counts"]):
            if known and known[-1][0] == score:
                known[-1][2] += n
            else:
                known.append([score, base + first + 1, n])
        pieces.append((row["_slice"], row["low"], row["high"], base, base + row["n"]))
    out = {}
    for cell, (known, pieces) in cells.items():
        scores, lows, counts = (np.array([k[i] for k in known], dtype=t) for i, t in enumerate((float, np.int64, np.int64)))
        for number, low, high, base, _ in pieces:
            below, above = int(np.searchsorted(scores, low, "right")), int(np.searchsorted(scores, high, "left"))
            near = sorted({*range(max(0, below - edge), below), *range(above, min(above + edge, len(scores)))})
            out[number, cell] = (base, scores[near], lows[near], counts[near])
    return out


def _drawn_numbers(asked: np.ndarray, ties: tuple, place: np.ndarray, tie: np.ndarray, places: int) -> np.ndarray:
    """The donor each recipient draws, as its number in the cell.

    The tied donors nearest to the prediction fill the ``places`` in order of distance; ``place``
    chooses one of the places, ``tie`` a donor of the range that holds it.
    """
    scores, lows, counts = ties
    near = np.searchsorted(scores, asked, "left")[:, None] + np.arange(-places, places)
    there = (near >= 0) & (near < len(scores))
    near = np.where(there, near, 0)
    order = np.argsort(np.where(there, np.abs(scores[near] - asked[:, None]), np.inf), axis=1, kind="stable")
    near, there = np.take_along_axis(near, order, 1), np.take_along_axis(there, order, 1)
    upto = np.cumsum(np.where(there, counts[near], 0), axis=1)
    chosen = near[np.arange(len(near)), np.argmax(upto > (place % np.minimum(places, upto[:, -1]))[:, None], axis=1)]
    return lows[chosen] + tie % counts[chosen]


def _matching(around: dict, seeds: Sequence, target: str, columns: Sequence[str], places: int):
    """Task function: the rows with gaps of a slice, with new values where the donor drawn lies in the
    same slice, else with the donor's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Slice(batches)
        if not part.pieces:
            return
        source = np.arange(part.table.num_rows)
        number, away = np.zeros(len(source), dtype=np.int64), np.zeros(len(source), dtype=bool)
        for at, end, place in part.pieces:
            base, scores, lows, counts = around[place]
            donors, own, firsts, sizes = part.ties(at, end)
            if len(own):
                # an outermost tie may go on in another slice
                left, right = scores < own[0], scores > own[-1]
                firsts = firsts + base + 1
                for end_ in (0, -1):
                    same = np.flatnonzero(scores == own[end_])
                    if len(same):
                        firsts[end_], sizes[end_] = lows[same[0]], counts[same[0]]
                scores, lows, counts = (
                    np.concatenate([c[left], o, c[right]]) for c, o in ((scores, own), (lows, firsts), (counts, sizes))
                )
            rows = at + np.flatnonzero(part.asks[at:end])
            for some in np.array_split(rows, len(rows) // PIECE + 1):
                texts = part.table["_text"].take(pa.array(some)).to_pylist()
                hashes = (_hash_numbers(texts, *seeds, *parts) for parts in ((), ("tie",)))
                drawn = _drawn_numbers(part.score[some], (scores, lows, counts), *hashes, places)
                here = (drawn > base) & (drawn <= base + len(donors))
                source[some[here]] = donors[drawn[here] - base - 1]
                number[some], away[some] = drawn, ~here
        partial = np.flatnonzero(part.table["_partial"].to_numpy())
        kept = part.table.select([*columns, "_cell"]).take(pa.array(partial))
        kept = kept.set_column(columns.index(target), target, part.table[target].take(pa.array(source[partial])))
        yield from kept.append_column("_number", pa.array(number[partial], mask=~away[partial])).to_batches(1 << 16)

    return run


def _outer_donors(sliced: DataFrame, edges: list, places: int) -> DataFrame:
    """The donors of outermost ties, the only ones that other slices draw from."""
    edge = places + 1
    bounds = [
        (r["_slice"], r["_cell"], r["scores"][min(edge, len(r["scores"])) - 1], r["scores"][-min(edge, len(r["scores"]))])
        for r in edges if r["scores"]
    ]
    few = local_table(sliced.sparkSession, bounds, "_slice int, _cell int, _head double, _tail double")
    outer = (F.col("_score") <= F.col("_head")) | (F.col("_score") >= F.col("_tail"))
    return sliced.where("not _asks").join(F.broadcast(few), ["_slice", "_cell"]).where(outer)


def _donor_numbers(around: dict, sizes: dict, heads: dict, target: str):
    """Task function: the outermost donors of the pieces of a slice, with their numbers in the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Slice(batches)
        for at, end, place in part.pieces:
            numbers = around[place][0] + 1 + np.arange(end - at)
            numbers[part.score[at:end] > heads[place]] += sizes[place] - (end - at)
            table = part.table.select(["_cell", target]).slice(at, end - at)
            yield from table.append_column("_number", pa.array(numbers)).to_batches(1 << 16)

    return run


def _matched(scored: DataFrame, columns: Sequence[str], key: str, target: str, seeds: Sequence, slices: int, places: int) -> tuple[DataFrame, list[DataFrame]]:
    """The rows with gaps after the matching of one variable, and the files they lie in.

    ``scored`` has those rows, and those without gaps as donors, with ``_cell``, ``_score``,
    ``_asks`` and ``_partial``. They are sorted once, range partitioned down to the id, so tied
    donors of any number spread over slices.
    """
    order = ["_cell", "_score", "_asks", key]
    sliced = (
        scored.repartitionByRange(slices, *order).sortWithinPartitions(*order)
        .withColumn("_slice", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    )
    try:
        place = ["_slice", "_cell", "_score", "_asks"]
        edges = sliced.select(*place).mapInArrow(_edges(places), EDGE_SCHEMA).collect()
        around = _surroundings(edges, places)
        text = F.concat_ws("|", F.col("imp").cast("string"), F.col(key).cast("string"))
        drawing = sliced.select("*", F.when(F.col("_asks"), text).alias("_text"))
        kept = StructType([*(sliced.schema[c] for c in columns), sliced.schema["_cell"], StructField("_number", LongType())])
        moved = cut_lineage(drawing.mapInArrow(_matching(around, seeds, target, columns, places), kept))
        away = moved.where(F.col("_number").isNotNull())
        done = moved.where(F.col("_number").isNull()).select(*columns)
        if away.isEmpty():
            return done, [moved]
        given = StructType([sliced.schema["_cell"], sliced.schema[target], StructField("_number", LongType())])
        sizes = {(r["_slice"], r["_cell"]): r["n"] for r in edges}
        heads = {(r["_slice"], r["_cell"]): r["scores"][min(places + 1, len(r["scores"])) - 1] for r in edges if r["scores"]}
        outer = _outer_donors(sliced.select(*place, target), edges, places).select(*place, target)
        numbered = outer.mapInArrow(_donor_numbers(around, sizes, heads, target), given)
        fetched = cut_lineage(numbered.join(broadcast_if_small(away.drop(target)), ["_cell", "_number"]).select(*columns))
        return done.unionByName(fetched), [moved, fetched]
    finally:
        sliced.unpersist()


def impute_strata(df: DataFrame, key: str, plan: ImputationPlan, strata: str, **options) -> Imputation:
    """``impute_chained`` with equations and donors of each value of ``strata`` apart, in the same jobs.

    Rows with a null in ``strata`` are left out. More than a thousand values are refused,
    since the driver solves an equation per value and copy.
    """
    return impute_chained(df, key, plan, strata=strata, **options)


def _stratified(df: DataFrame, strata: str | None) -> tuple[DataFrame, dict[int, object]]:
    """Rows with the number of their stratum, and the value of each number."""
    if strata is None:
        return df.withColumn("_stratum", F.lit(0)), {0: ""}
    values = [r[0] for r in df.select(strata).where(F.col(strata).isNotNull()).distinct().limit(MOST_STRATA + 1).collect()]
    if len(values) > MOST_STRATA:
        raise ValueError(f"{strata} has more than {MOST_STRATA} values")
    names = dict(enumerate(sorted(values)))
    kind = df.schema[strata].dataType.simpleString()
    numbers = local_table(df.sparkSession, [(v, i) for i, v in names.items()], f"`{strata}` {kind}, _stratum int")
    return df.join(F.broadcast(numbers), strata), names


def impute_chained(
    df: DataFrame,
    key: str,
    plan: ImputationPlan,
    copies: Sequence[int] = tuple(range(1, 11)),
    cycles: int = 5,
    seed: int = 100,
    donors: int = DONORS,
    strata: str | None = None,
) -> Imputation:
    """Impute ``plan.targets`` in every copy; observed cells never change.

    ``key`` identifies a row. The result depends on data, seed and copy number
    only, so copies may be computed together or one by one. Every stratum needs
    an observed value of every target.
    """
    copies, targets = [int(c) for c in copies], list(plan.targets)
    kept = list(dict.fromkeys([key, *([strata] if strata else []), *plan.predictors, *targets]))
    numbered, names = _stratified(df.select(*kept), strata)
    rows = cut_lineage(numbered)
    original = rows.select(*kept)
    filled = rows.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in (*plan.predictors, *targets)]).collect()
    gaps = [c for c in plan.predictors if any(f[c] < f["_rows"] for f in filled)]
    if gaps:
        raise ValueError(f"predictors with nulls: {gaps}; make them targets or leave them out")
    empty = [t for t in targets if any(not f[t] for f in filled) or not filled]
    if empty:
        raise ValueError(f"no observed value to impute from: {empty}")
    whole = F.lit(True)
    for t in targets:
        whole = whole & F.col(t).isNotNull()
    complete, partial = rows.where(whole), rows.where(~whole)
    each = F.explode(F.array(*[F.lit(c) for c in copies])).alias("imp")
    state = partial.withColumns({f"_missing_{t}": F.col(t).isNull() for t in targets}).select(each, "*")
    for t in targets:
        state = _started(state, rows, key, t, seed)
    state = cut_lineage(state)
    files = [state]
    slices = math.ceil(sum(f["_rows"] for f in filled) * len(copies) / SLICE_ROWS)
    fixed = _products(complete.withColumn("_cell", F.col("_stratum")), plan)
    equations, cell = plan.matrix(), F.col("_stratum") * len(copies) + F.array_position(F.array(*[F.lit(c) for c in copies]), F.col("imp")) - 1
    log, left_out = [], []
    for cycle in range(1, cycles + 1):
        for t in targets:
            moving = _products(state.where(~F.col(f"_missing_{t}")).withColumn("_cell", cell), plan)
            solved = []
            for s, name in names.items():
                for i, imp in enumerate(copies):
                    total = fixed.get(s, 0) + moving.get(s * len(copies) + i, 0)
                    fit, draw, out = draw_coefficients(total, *equations[t], seed, cycle, t, imp, name)
                    solved.append((s, imp, fit.tolist(), draw.tolist()))
                    left_out += [(str(name), imp, cycle, t, plan.features()[c][1]) for c in out]
            scored = _scored(plan, complete, state, solved, key, t).withColumn("_cell", cell.cast("int"))
            before, (state, files) = files, _matched(scored, state.columns, key, t, (seed, cycle, t), slices, donors)
            for spent in before:
                discard(spent)
        log += _trace_rows(state, plan, cycle, names if strata else None)
    spark = df.sparkSession
    trace = local_table(spark, log, "cycle int, imp int, " + ("stratum string, " if strata else "") + "variable string, n_imputed long, mean double, sd double")
    dropped = local_table(spark, left_out, "stratum string, imp int, cycle int, variable string, predictor string")
    completed = complete.select(each, *kept).unionByName(state.select("imp", *kept))
    return Imputation(completed, original, trace, dropped)


def _scored(plan: ImputationPlan, complete: DataFrame, state: DataFrame, solved: list[tuple], key: str, target: str) -> DataFrame:
    """Donors and recipients of one variable in all strata and copies, with their predictions.

    Rows with gaps keep all columns, since the next state is made of them; the others are donors only.
    """
    # a row of 2p numbers per stratum and copy
    coefficients = F.broadcast(
        local_table(state.sparkSession, solved, "_stratum int, imp int, _fit array<double>, _draw array<double>")
    )
    used = sorted({i for _, _, fit, draw in solved for i in range(len(fit)) if fit[i] or draw[i]})
    columns = [c for _, _, c in plan.features()]
    score = lambda b: sum((columns[i] * F.get(F.col(b), F.lit(i)) for i in used), F.lit(0.0))
    needed = ("imp", "_stratum", key, target)
    given = complete.join(coefficients, "_stratum").select(
        *[F.col(c) if c in needed else F.lit(None).cast(state.schema[c].dataType).alias(c) for c in state.columns],
        score("_fit").alias("_score"), F.lit(False).alias("_asks"), F.lit(False).alias("_partial"),
    )
    asks = F.col(f"_missing_{target}")
    moving = state.join(coefficients, ["_stratum", "imp"]).select(
        *state.columns, F.when(asks, score("_draw")).otherwise(score("_fit")).alias("_score"), asks.alias("_asks"), F.lit(True).alias("_partial")
    )
    return given.unionByName(moving)


def _trace_rows(state: DataFrame, plan: ImputationPlan, cycle: int, names: dict[int, object] | None) -> list[tuple]:
    """Mean and deviation of the imputed cells, one row per copy (and stratum) and variable."""
    stats = []
    for i, t in enumerate(plan.targets):
        cell = F.when(F.col(f"_missing_{t}"), plan.response(t))
        stats += [F.count(cell).alias(f"n{i}"), F.avg(cell).alias(f"m{i}"), F.stddev(cell).alias(f"s{i}")]
    by = ["imp", "_stratum"] if names else ["imp"]
    rows = state.groupBy(*by).agg(*stats).collect()
    return [
        (cycle, r["imp"], *([str(names[r["_stratum"]])] if names else []), t, r[f"n{i}"], r[f"m{i}"], r[f"s{i}"])
        for r in sorted(rows, key=lambda r: tuple(r[c] for c in by))
        for i, t in enumerate(plan.targets)
    ]


def observed_imputed_histogram(result: Imputation, key: str, target: str, width: float) -> DataFrame:
    """Counts per value bucket, observed and imputed cells apart."""
    bucket = (F.floor(F.col(target).cast("double") / width) * width).alias("bucket")
    cells = result.original.where(F.col(target).isNotNull()).select(bucket, F.lit("observed").alias("kind"), F.lit(0).alias("imp"))
    missing = result.original.where(F.col(target).isNull()).select(key)
    imputed = result.copies.join(missing, key, "left_semi").select(bucket, F.lit("imputed").alias("kind"), "imp")
    return cells.unionByName(imputed).groupBy("kind", "imp", "bucket").agg(F.count(F.lit(1)).alias("n"))
