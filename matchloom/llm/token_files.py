"""Token files: one array of ids per shard, document boundaries in Elias-Fano code.

A shard file holds the ids of its documents end to end (two bytes each if the
vocabulary allows, else four), then the ends of the documents and their numbers,
both ascending and both in Elias-Fano code, then a footer. The code takes about
two bits and the logarithm of the mean gap per document; the place of every
256th set bit is kept, so an end is found by reading a few bytes, without a table
of 64-bit offsets.

Documents are range partitioned by their number, and every task streams its
share into a file of its own. The manifest, one row per finished shard, is what
counts: a task that is run again writes a new file, and only the file named in
the manifest is read.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import column
from matchloom.llm.tokenization import encoder as encoder_of
from matchloom.session import cut_lineage

MAGIC, END_ID = b"MLTOKEN1", 0
#: A select sample for every so many set bits; bytes of ids handed on at a time.
SAMPLED, HANDED = 256, 4 << 20
_FOOTER = struct.Struct("<QQQqQB7x8s")
_HEAD = struct.Struct("<QBxxxIQ")


@dataclass(frozen=True)
class EliasFano:
    """Ascending whole numbers from 0 on, in Elias-Fano code."""

    n: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        high = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(high[-1]) + 1 if n else 0, dtype=np.uint8)
        bits[high] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1)
        pack = lambda b: np.packbits(b, bitorder="little")
        return cls(n, low_bits, pack(low), pack(bits), high[::SAMPLED].astype("<u4"))

    def __getitem__(self, i: int) -> int:
        """The ``i``-th number: a sample, then bytes of the high part up to its bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLED])
        left, byte = i % SAMPLED, at >> 3
        left += int(self.high[byte] & ((1 << (at & 7)) - 1)).bit_count()
        while left >= (ones := int(self.high[byte]).bit_count()):
            left, byte = left - ones, byte + 1
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        value = 8 * byte + int(bits[left]) - i
        for b in range(self.low_bits):
            place = i * self.low_bits + b
            value = value if b else value << self.low_bits
            value |= (int(self.low[place >> 3]) >> (place & 7) & 1) << b
        return value

    def span(self, start: int, end: int) -> np.ndarray:
        """The numbers from ``start`` to before ``end``: the high part is read between two select samples."""
        if start >= end:
            return np.zeros(0, np.uint64)
        first, after = start // SAMPLED, -(-end // SAMPLED)
        byte = int(self.samples[first]) >> 3
        stop = (int(self.samples[after]) >> 3) + 1 if after < len(self.samples) else len(self.high)
        bits = 8 * byte + np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little"))
        at = int(np.searchsorted(bits, int(self.samples[first]))) + start - first * SAMPLED
        values = (bits[at : at + end - start] - np.arange(start, end)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            place, stop = start * self.low_bits, end * self.low_bits
            low = np.unpackbits(self.low[place >> 3 : -(-stop >> 3)], bitorder="little")[place & 7 :]
            low = low[: stop - place].reshape(end - start, -1)
            for b in range(self.low_bits):
                values |= low[:, b].astype(np.uint64) << np.uint64(b)
        return values

    def decode(self) -> np.ndarray:
        """All numbers."""
        return self.span(0, self.n)

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low_bits, len(self.samples), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, samples, high = _HEAD.unpack_from(data)
        at, cut = _HEAD.size, -(-n * low_bits // 8)
        part = lambda start, size: np.frombuffer(data, np.uint8, size, start)
        return cls(n, low_bits, part(at, cut), part(at + cut, high), np.frombuffer(data, "<u4", samples, at + cut + high))


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ShardWriter:
    """Streams documents, ascending by number with nulls first, into one file."""

    def __init__(self, path: str, width: int):
        system, place = _open(path)
        system.create_dir(place.rpartition("/")[0], recursive=True)
        self.file, self.width = system.open_output_stream(place), width
        self.file.write(MAGIC)
        self.ends: list[int] = []
        self.numbers: list[int] = []
        self.nulls = self.total = 0

    def add(self, number: int | None, parts: Iterator[bytes]) -> None:
        for ids in parts:
            self.total += len(ids) // 4
            self.file.write(ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
        self.ends.append(self.total)
        if number is None:
            self.nulls += 1
        else:
            self.numbers.append(number)

    def close(self) -> None:
        base = self.numbers[0] if self.numbers else 0
        ends = EliasFano.encode(np.array(self.ends, dtype=np.uint64)).to_bytes()
        numbers = EliasFano.encode(np.array([x - base for x in self.numbers], dtype=np.uint64)).to_bytes()
        self.file.write(ends)
        self.file.write(numbers)
        self.file.write(_FOOTER.pack(self.total, len(ends), len(numbers), base, self.nulls, self.width, MAGIC))
        self.file.close()


class Shard:
    """A shard file opened for reading."""

    def __init__(self, path: str):
        system, place = _open(path)
        self.file = system.open_input_file(place)
        size = self.file.size()
        foot = self.file.read_at(_FOOTER.size, size - _FOOTER.size)
        self.total, ends, numbers, self.base, self.nulls, self.width, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        at = size - _FOOTER.size - numbers
        self.numbers = EliasFano.from_bytes(self.file.read_at(numbers, at))
        self.ends = EliasFano.from_bytes(self.file.read_at(ends, at - ends))

    def ids(self, start: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - start) * self.width, len(MAGIC) + start * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def document(self, i: int) -> np.ndarray:
        """Ids of the ``i``-th document, found by two selects."""
        return self.ids(self.ends[i - 1] if i else 0, self.ends[i])

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Number, start in the shard and ids of each document.

        Boundaries are found by select, some hundreds at a time, and ids read some megabytes at a time.
        """
        start = 0
        for at in range(0, self.ends.n, SAMPLED):
            ends = self.ends.span(at, min(at + SAMPLED, self.ends.n)).astype(np.int64).tolist()
            low, high = max(0, at - self.nulls), max(0, at + len(ends) - self.nulls)
            numbers = [None] * (len(ends) - high + low) + [self.base + x for x in self.numbers.span(low, high).tolist()]
            i = 0
            while i < len(ends):
                last = max(i + 1, bisect_right(ends, start + HANDED // 4))
                block, first = self.ids(start, ends[last - 1]), start
                for k in range(i, last):
                    yield numbers[k], start, block[start - first : ends[k] - first].tobytes()
                    start = ends[k]
                i = last

    def close(self) -> None:
        self.file.close()


def write_tokens(
    docs: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int = END_ID,
    id: str = "doc_id",
    text: str = "text",
    literal: bool = False,
) -> DataFrame:
    """Encode whole texts, write shards under ``folder`` and return the manifest.

    The manifest has ``shard``, ``path``, ``n_docs``, ``n_tokens`` and ``start``,
    the number of ids before the shard. Documents are in ascending order of
    ``id``, a whole number, with nulls first; ``end_id`` closes each. A null text
    is empty. Repeated numbers stay separate documents; an id that many rows
    share is still split over shards. An empty table gives an empty manifest.
    ``folder`` must be one that all executors share. ``literal`` takes the names of
    special tokens in a text as text; the library by itself does not.
    """
    rows = docs.select(column(id).cast("long").alias("id"), column(text).alias("text")).withColumn(
        "nth", F.monotonically_increasing_id()
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, writer, encoder, end = TaskContext.get().partitionId(), None, None, end_id.to_bytes(4, "little")
        path = f"{folder}/shard-{shard:07d}-{uuid.uuid4().hex}.tok"
        for batch in batches:
            if writer is None and batch.num_rows:
                encoder = encoder_of(tokenizer, literal)
                width = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
                writer = ShardWriter(path, width)
            numbers, texts = batch.column(0).to_pylist(), (value.as_py() for value in batch.column(1))
            for number, ids in zip(numbers, encoder.encode_all(texts) if numbers else ()):
                writer.add(number, (ids, end))
        if writer is not None:
            writer.close()
            made = ([shard], [path], [len(writer.ends)], [writer.total])
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(made, types)], names=["shard", "path", "n_docs", "n_tokens"]
            )

    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), "nth").sortWithinPartitions(F.asc_nulls_first("id"), "nth")
    made = cut_lineage(
        ordered.select("id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_tokens long")
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_tokens(manifest: DataFrame, id: str = "doc_id") -> DataFrame:
    """Documents of the shards: ``id``, ``start`` over all shards, ``n_tokens`` and ``ids``.

    ``ids`` holds unsigned 32-bit little-endian numbers. One task reads a shard.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=[id, "start", "n_tokens", "ids"]
            )

        for given in batches:
            for row in given.to_pylist():
                shard, held, size = Shard(row["path"]), [], 0
                for number, start, ids in shard.documents():
                    held.append((number, row["start"] + start, len(ids) // 4, ids))
                    size += len(ids)
                    if size > HANDED:
                        yield batch(held)
                        held, size = [], 0
                if held:
                    yield batch(held)
                shard.close()

    shards = max(1, manifest.count())
    return manifest.select("path", "start").repartition(shards).mapInArrow(
        read, f"`{id}` long, start long, n_tokens long, ids binary"
    )
