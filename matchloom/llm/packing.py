"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are the binary digits of its
length, largest first, none above the sequence length. Every piece is a whole
sequence of its own, so nothing is padded and no sequence crosses documents;
pieces of one length form a bucket that is trained on together.

Each task numbers its own sequences after its partition number, so there is no
shuffle, and one source or document may hold any share of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from matchloom.llm.common import column
from matchloom.llm.tokenization import encoder as encoder_of

LENGTH, END_ID = 2048, 1
#: Bytes of ids handed on at a time.
HANDED = 4 << 20


def binary_lengths(n: int, longest: int = LENGTH) -> Iterator[int]:
    """``n`` as full lengths and then its remaining binary digits, largest first."""
    for _ in range(n // longest):
        yield longest
    size, rest = longest >> 1, n % longest
    while size:
        if rest & size:
            yield size
        size >>= 1


def decompose(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    longest: int = LENGTH,
    id: str = "doc_id",
    text: str = "text",
    literal: bool = False,
) -> DataFrame:
    """One row per sequence: ``id``, ``start``, ``length``, ``doc_tokens``, ``sequence_id``, ``ids``.

    ``ids`` holds unsigned 32-bit little-endian numbers; ``start`` counts the
    document's ids before the piece, ``doc_tokens`` all of them, the closing
    ``end_id`` included. A null or empty text is that one id. Repeated rows are
    packed each. ``longest`` must be a power of two. ``literal`` takes the names of
    special tokens in a text as text; the library by itself does not.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the sequence length must be a power of two")
    rows = docs.select(column(id).alias("id"), column(text).alias("text"))
    out = StructType([
        StructField(id, rows.schema["id"].dataType),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("doc_tokens", LongType()),
        StructField("sequence_id", LongType()),
        StructField("ids", BinaryType()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = encoder_of(tokenizer, literal), TaskContext.get().partitionId() << 40
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            held, size = ([], [], [], [], [], []), 0
            kind = batch.schema.field(0).type

            def full():
                types = (kind, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(held, types)], names=out.names)

            encoded = encoder.encode_all(value.as_py() for value in batch.column(1))
            for key, ids in zip(batch.column(0).to_pylist(), encoded):
                ids += end
                total, start = len(ids) >> 2, 0
                for length in binary_lengths(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    for values, x in zip(held, (key, start, length, total, number, piece)):
                        values.append(x)
                    start, number, size = start + length, number + 1, size + len(piece)
                    if size > HANDED:
                        yield full()
                        held, size = ([], [], [], [], [], []), 0
            if held[0]:
                yield full()

    return rows.mapInArrow(pack, out)


def write_buckets(sequences: DataFrame, path: str) -> None:
    """Write sequences as Parquet, a folder for each length."""
    sequences.write.partitionBy("length").parquet(path)


def with_digest(sequences: DataFrame) -> DataFrame:
    """Add ``ids_crc32`` and ``offset``: a piece fills its sequence, so it lies at 0."""
    return sequences.withColumns({"ids_crc32": F.crc32("ids"), "offset": F.lit(0).cast("long")})
