"""Approximate nearest neighbours by a permutation index (Chavez, Figueroa and Navarro, 2008).

A vector is represented by its nearest pivots in order. Nearness is the inner
product; vectors get one more coordinate that brings all to the length of the
longest, so the order of pivots is that of distances whatever the lengths. The
index keeps the first ``PREFIX`` of ``PIVOTS`` pivots for every row.

Search. Rows are dealt by hash into shards, queries into blocks, and every pair
of shard and block is one task of bounded size. A shard posts its vectors in one
inverted file per pivot, with the pivot's place. A query adds up, over its own
pivots' files, how far both places lie from the end of the prefix: that is half
of what the footrule distance of the truncated orders is below its largest value,
so the largest sums are the smallest distances. The best tenth of the shard is
ranked anew by exact inner products, and the best of all shards are merged.

Equal vectors are posted once per shard with their smallest ids, of which no more
than the answer's size can ever be returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ShortType

from matchloom.llm.common import column
from matchloom.operators.ranking import first_rows
from matchloom.session import cut_lineage

#: Pivots drawn (the bounded sample the index is fitted on) and kept per vector.
PIVOTS, PREFIX = 256, 64
#: Share of a shard that is ranked by exact products, and the least number.
RERANKED, LEAST = 0.1, 500
SHARD_ROWS, BLOCK_ROWS = 16_384, 1_024


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part.

    Vectors that are null, empty, zero, or hold a null or non-finite number do
    not, nor do those whose length is not the most frequent one.
    """
    v = F.col("vector")
    rows = df.select(column(id).cast("long").alias("id"), column(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists(v, lambda x: x != 0)
    )
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("vector") == (common["n"] if common else 0))


def draw_pivots(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The different vectors with the smallest hashes, lengthened, and the greatest squared length."""
    drawn = rows.withColumn("draw", F.xxhash64("vector"))
    limits = drawn.select("draw").distinct().orderBy("draw").limit(PIVOTS)
    picked = drawn.join(F.broadcast(limits), "draw").groupBy("draw").agg(F.first("vector").alias("vector")).orderBy("draw").collect()
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    longest = rows.agg(F.max(squares)).first()[0] or 0.0
    vectors = np.array([r["vector"] for r in picked], dtype=np.float64)
    return lengthened(vectors, longest) if len(vectors) else vectors, longest


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0.0, longest - (vectors * vectors).sum(axis=1)))
    return np.column_stack((vectors, rest))


def build_index(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The index: ``id``, ``vector`` and two ordered pivot lists per row that takes part, written out.

    ``nearest`` is the list of the row as a candidate, ``asked`` as a query,
    where nothing is added to its length. An empty table gives an empty index.
    """
    rows = usable(df, id, vector)
    pivots, longest = draw_pivots(rows)
    kept = min(PREFIX, len(pivots))

    def order(products: np.ndarray) -> list[np.ndarray]:
        return list(np.argsort(-products, axis=1, kind="stable")[:, :kept].astype(np.int16))

    @F.pandas_udf(ArrayType(ShortType()))
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(order(lengthened(np.stack(vectors), longest) @ pivots.T) if len(vectors) else [], dtype=object)

    @F.pandas_udf(ArrayType(ShortType()))
    def asked(vectors: pd.Series) -> pd.Series:
        return pd.Series(order(np.stack(vectors) @ pivots[:, :-1].T) if len(vectors) else [], dtype=object)

    return cut_lineage(rows.withColumn("nearest", nearest("vector")).withColumn("asked", asked("vector")))


def _classes(ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """First rows of equal vectors, by smallest id, and up to ``k + 1`` smallest ids of each."""
    data = np.ascontiguousarray(vectors)
    whole = data.view(np.dtype((np.void, data.dtype.itemsize * data.shape[1]))).reshape(-1)
    _, first, inverse = np.unique(whole, return_index=True, return_inverse=True)
    by = np.argsort(inverse, kind="stable")
    groups = np.split(ids[by], np.cumsum(np.bincount(inverse))[:-1])
    back = np.argsort(first, kind="stable")
    return first[back], [np.unique(groups[i])[: k + 1] for i in back]


def search_shard(base: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` nearest found in one shard for each query of one block."""
    base = base.sort_values("id", kind="stable")
    vectors, ids = np.stack(base["vector"]), base["id"].to_numpy()
    first, members = _classes(ids, vectors, k)
    vectors, nearest = vectors[first], np.stack(base["nearest"].to_numpy()[first])
    n, kept = nearest.shape
    files: list[tuple[np.ndarray, np.ndarray]] = []
    by_pivot = np.argsort(nearest, axis=None, kind="stable")
    pivots = nearest.reshape(-1)[by_pivot]
    edges = np.searchsorted(pivots, np.arange(int(pivots[-1]) + 2))
    for p in range(len(edges) - 1):
        posted = by_pivot[edges[p] : edges[p + 1]]
        files.append((posted // kept, (kept - posted % kept).astype(np.int32)))
    looked_at = min(n, max(LEAST, int(np.ceil(RERANKED * n))))
    out: list[tuple[int, int, float]] = []
    seen: set[tuple] = set()
    for number, vector, asked in zip(queries["id"], queries["vector"], queries["asked"]):
        if (number, bytes(vector)) in seen:
            continue
        seen.add((number, bytes(vector)))
        near = np.zeros(n, dtype=np.int32)
        for place, pivot in enumerate(asked):
            if pivot < len(files):
                rows, left = files[pivot]
                near[rows] += np.minimum(left, kept - place)
        chosen = np.arange(n)
        if looked_at < n:
            chosen = np.argpartition(-near, looked_at - 1)[:looked_at]
        scores = (vectors[chosen] * vector).sum(axis=1)
        taken = np.lexsort((chosen, -scores))[: k + 1]
        found = [(float(scores[i]), int(x)) for i in taken for x in members[chosen[i]] if x != number]
        found.sort(key=lambda f: (-f[0], f[1]))
        out += [(number, x, s) for s, x in found[:k]]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found for each query, itself aside.

    ``queries`` are rows of the index. A repeated id counts once, with its
    nearest vector; ties go to the smaller id.
    """
    shards = max(1, -(-index.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    deal = lambda n: F.pmod(F.xxhash64("id", "vector"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    base = index.select("id", "vector", "nearest", deal(shards).cast("long").alias("shard"), each(blocks).alias("block"))
    asked = queries.select("id", "vector", "asked", deal(blocks).cast("long").alias("block"), each(shards).alias("shard"))

    def found(base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if base.empty or queries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        return search_shard(base, queries, k)

    pairs = base.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
    best = (
        pairs.applyInPandas(found, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
    )
    return first_rows(best, ["query_id"], [F.desc("score"), F.col("vec_id")], k, rank="rank").select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
