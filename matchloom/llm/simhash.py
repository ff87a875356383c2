"""SimHash near-duplicates: pigeonring candidates, Hamming check, components.

A fingerprint of 64 bits lies on a ring of five segments. If two fingerprints
differ in at most ``k`` bits, some segment starts a chain in which the first
``l`` segments together differ in at most ``l * k / 5`` bits, for every ``l``
(the pigeonring principle, Qin and Xiao, 2018). For ``k = 2`` that means: two
neighbouring segments are equal, with the third and fourth at most one bit
differs, in all five at most two. The equal pair is a join key of 25 or 26 bits,
the longer chains prune before the whole distance counts.

Work is done on distinct fingerprints, so exact copies cost one row. A key that
many different fingerprints share would still make pairs with the square of
their number. Such a key's fingerprints are linked instead through the values
one bit away from their remaining segments: two of them share such a value
exactly if they differ in at most two bits, and at most forty share one, so the
way is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from matchloom.llm.common import column, free_name
from matchloom.llm.components import components
from matchloom.session import cut_lineage, discard

SHINGLE, SEED, BITS, DISTANCE = 3, 42, 64, 2
SEGMENTS = (13, 13, 13, 13, 12)
#: Fingerprints of one key are paired directly up to this number; beyond it, through near values.
PAIRED = 64
#: Words and hashes held at a time while a long text is read.
BLOCK = 1 << 16

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """Words of a text in blocks; each block begins with the last two words of the one before."""
    if len(data) < 8 * BLOCK:
        yield data.split()
        return
    carry: list[bytes] = []
    rest = data
    while rest:
        parts = rest.split(None, BLOCK)
        rest = parts.pop() if len(parts) > BLOCK else b""
        yield carry + parts
        carry = (carry + parts)[1 - SHINGLE :]


def fingerprint(text: str | None) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    ones, n = np.zeros(BITS, dtype=np.int64), 0
    few: list[bytes] = []
    for block in _blocks((text or "").encode("utf-8", "surrogatepass").lower()):
        few = block
        if len(block) >= SHINGLE:
            hashes = np.fromiter(
                map(_hash, map(b" ".join, zip(block, block[1:], block[2:]))), dtype="<u8", count=len(block) - SHINGLE + 1
            )
            for at in range(0, len(hashes), 4096):
                part = hashes[at : at + 4096]
                bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.uint16)
            n += len(hashes)
    if not n:
        if not few:
            return 0
        only = _hash(b" ".join(few))
        return only - (1 << 64) if only >> 63 else only
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def with_fingerprint(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """Add the fingerprint of each whole text as a signed long."""
    return docs.withColumn(out, _fingerprints(column(text)))


def as_hex(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _ring(fp: Column) -> Column:
    """For each start: the key (start and two segments) and the other three segments in ring order."""
    offsets = [sum(SEGMENTS[:i]) for i in range(len(SEGMENTS))]
    part = lambda i: F.shiftrightunsigned(fp, offsets[i]).bitwiseAND(F.lit((1 << SEGMENTS[i]) - 1).cast("long"))
    n = len(SEGMENTS)

    def joined(ids: list[int], head: int = 0) -> Column:
        value = F.lit(head).cast("long")
        for i in ids:
            value = F.shiftleft(value, SEGMENTS[i % n]).bitwiseOR(part(i % n))
        return value

    return F.array(*[
        F.struct(
            joined([i, i + 1], i).alias("key"),
            joined([i + 2, i + 3]).alias("near"),
            part((i + 4) % n).alias("last"),
            F.shiftrightunsigned(joined([i + 2, i + 3]), SEGMENTS[(i + 3) % n]).alias("third"),
        )
        for i in range(n)
    ])


def links(fingerprints: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) between the distinct values of ``fp`` that hold their components together."""
    posted = cut_lineage(
        fingerprints.select("fp").distinct().select("fp", F.explode(_ring(F.col("fp"))).alias("r")).select("fp", "r.*")
    )
    sizes = cut_lineage(posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    crowded = posted.join(sizes, "key")
    few = crowded.where(F.col("n") <= PAIRED)
    bits = lambda c: F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")))
    budget = lambda length: length * DISTANCE // len(SEGMENTS)
    paired = (
        few.alias("a")
        .join(
            few.alias("b"),
            (F.col("a.key") == F.col("b.key"))
            & (F.col("a.fp") < F.col("b.fp"))
            & (bits("third") <= budget(3))
            & (bits("near") <= budget(4))
            & (bits("near") + bits("last") <= DISTANCE),
        )
        .select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    )
    rest_bits = max(SEGMENTS) * 3
    many = crowded.where(F.col("n") > PAIRED).withColumn(
        "rest", F.shiftleft(F.col("near"), max(SEGMENTS)).bitwiseOR(F.col("last"))
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(rest_bits)])
    through = (
        many.select("key", "fp", F.explode(F.transform(flips, lambda bit: F.col("rest").bitwiseXOR(bit))).alias("value"))
        .groupBy("key", "value")
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.col("fps")[0].alias("u"), F.explode("fps").alias("v"))
        .where(F.col("u") != F.col("v"))
    )
    return paired.unionByName(through).distinct()


def classes(rows: DataFrame, order: str) -> DataFrame:
    """For every distinct ``fp`` of ``rows``, the smallest ``order`` value of its component."""
    low = cut_lineage(rows.groupBy("fp").agg(F.min(order).alias("low")))
    labels = cut_lineage(components(links(low)))
    linked = labels.join(low.withColumnRenamed("fp", "node"), "node")
    by_root = cut_lineage(linked.groupBy("root").agg(F.min("low").alias("first")))
    moved = cut_lineage(labels.join(by_root, "root").select(F.col("node").alias("fp"), "first"))
    out = cut_lineage(low.join(moved, "fp", "left").select("fp", F.coalesce("first", "low").alias("first")))
    for spent in (low, labels, by_root, moved):
        discard(spent)
    return out


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``id``, ``fingerprint`` and ``component_id``.

    Null and wordless texts have fingerprint zero, which links like any other.
    The component is the smallest id reachable, nulls aside. Repeated rows come
    back repeated; an empty table gives no rows.
    """
    rows = cut_lineage(with_fingerprint(docs.select(column(id).alias("id"), column(text).alias("text")), "fp").drop("text"))
    return rows.join(classes(rows, "id"), "fp").select(
        F.col("id").alias(id), as_hex(F.col("fp")).alias("fingerprint"), F.col("first").alias("component_id")
    )


def one_per_class(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one row left of every component: the one with the smallest id.

    Of repeated rows one stays too. Columns are those of ``docs``.
    """
    fp = free_name(docs.columns, "fp")
    uid = free_name([*docs.columns, fp], "uid")
    marked = cut_lineage(with_fingerprint(docs, fp, text).withColumn(uid, F.monotonically_increasing_id()))
    rows = marked.select(F.col(fp).alias("fp"), F.struct(column(id).alias("id"), F.col(uid).alias("uid")).alias("row"))
    first = classes(rows, "row")
    dropped = cut_lineage(
        rows.join(first, "fp").where(F.col("row.uid") != F.col("first.uid")).select(F.col("row.uid").alias(uid))
    )
    return marked.join(dropped, uid, "left_anti").select(*map(column, docs.columns))
