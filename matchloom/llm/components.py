"""Connected components by distributed union-find.

Each round hooks every node's larger neighbours to the smallest node next to it,
then compresses what points to one node onto that node's smallest parent (the
large-star and small-star steps of Kiveris et al., 2014). The rounds grow with
the logarithm of the longest chain. The driver sees two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import cut_lineage, discard


def _lowest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour per node, written so that a hot node's join can be split."""
    return cut_lineage(edges.groupBy("u").agg(F.min("v").alias("low")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 65521)).first())


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable (``root``) for every node of ``edges`` (``u``, ``v``), itself included.

    Nodes may be of any type with an order. Nulls and loops are ignored; without
    edges the result is empty.
    """
    kind = edges.schema["u"].dataType
    now = cut_lineage(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        hooked = cut_lineage(
            both.where(F.col("v") > F.col("u"))
            .join(low.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
            .select(F.col("v").alias("u"), F.least("low", "u").alias("v"))
            .distinct()
        )
        parent = _lowest(hooked)
        compressed = cut_lineage(
            hooked.join(parent.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
            .where(F.col("v") != F.col("low"))
            .select(F.col("v").alias("u"), F.col("low").alias("v"))
            .unionByName(parent.select("u", F.col("low").alias("v")))
            .distinct()
        )
        before, state, old = state, _state(compressed), now
        now = compressed
        for spent in (old, low, hooked, parent):
            discard(spent)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").cast(kind).alias("node"), F.col("v").cast(kind).alias("root")).unionByName(roots)
