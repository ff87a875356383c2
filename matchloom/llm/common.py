"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.session import BROADCAST_BYTES, fits

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column has that name (case ignored)."""
    used = {c.lower() for c in taken}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def words(text: Column) -> Column:
    """Words of a text as an array; none for a null text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def quoted(name: str) -> str:
    """A column name as one identifier, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def letters_table(digits: bool) -> bytes:
    """Byte table for ``bytes.translate``: A-Z lower-cased, all else below 0x80 but letters (and digits) to spaces."""
    kept = b"abcdefghijklmnopqrstuvwxyz" + (b"0123456789" if digits else b"")
    return bytes(ord(chr(b).lower()) if b < 0x80 and chr(b).isupper() else b if b >= 0x80 or b in kept else 0x20 for b in range(256))


def mixed_keys(posted: DataFrame, value: str) -> DataFrame:
    """The different rows of ``posted`` whose ``key`` has more than one ``value``, and how many rows the key has (``size``).

    The rows move once, by key, and are counted where they arrive.
    """
    whole = Window.partitionBy("key")
    return (
        posted.repartition("key").distinct()
        .select(
            "*", F.count(F.lit(1)).over(whole).alias("size"),
            F.min(value).over(whole).alias("_low"), F.max(value).over(whole).alias("_high"),
        )
        .where("_low < _high").drop("_low", "_high")
    )


#: Bits of a bitmap for each key, and in one of its rows as a power of two.
KEY_BITS, ROW_BITS = 16, 12


def semi_join(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` whose 64-bit hash ``name`` is in the one column of ``keys``, which has it once.

    Keys too many for a broadcast are first sent as a bitmap, so that few rows without one are moved.
    """
    if fits(keys):
        return df.join(F.broadcast(keys), name, "left_semi")
    return _perhaps_in(df, keys, name, keys.count()).join(keys, name, "left_semi")


def _perhaps_in(df: DataFrame, keys: DataFrame, name: str, n: int) -> DataFrame:
    """``df`` without most rows whose hash is not among the ``n`` ``keys``; none that is there goes."""
    width = max(ROW_BITS, min((n * KEY_BITS).bit_length(), (8 * BROADCAST_BYTES).bit_length() - 1))
    if n >> width - 1:
        return df
    row, word = free_name(df.columns, "_row"), free_name(df.columns, "_word")
    place = F.shiftrightunsigned(column(name), 64 - width)
    at, in_row = F.shiftright(place, ROW_BITS), F.shiftright(place, 6).bitwiseAND(F.lit((1 << ROW_BITS - 6) - 1)).cast("int")
    bit = place.bitwiseAND(F.lit(63)).cast("int")
    bits = (
        keys.select(at.alias(row), in_row.alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit"))
        .groupBy(row, "at").agg(F.bit_or("bit").alias("bits"))
        .groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("held"))
        .select(row, F.transform(F.sequence(F.lit(0), F.lit((1 << ROW_BITS - 6) - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("long"))).alias(word))
    )
    held = df.withColumn(row, at).join(F.broadcast(bits), row)
    return held.where(F.call_function("shiftright", F.get(word, in_row), bit).bitwiseAND(F.lit(1)) == 1).drop(row, word)
