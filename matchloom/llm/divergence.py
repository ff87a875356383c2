"""Divergence between the sources of a language, from word counts made by single-pass indexing.

Blocks. A task reads whole texts and counts terms per (language, source) in memory.
When the block holds ``ENTRIES`` counts it is spilled: sorted by term, cut into
hash shards, and each shard's run into chunks of at most ``CHUNK`` entries.

Merge. Chunks are dealt out by shard and arrive in order of their first term, so a
shard's runs are merged by a heap that opens a chunk when its first term is due
and holds one chunk per run. Terms in fewer than ``LEAST_DOCS`` documents of the
language end here; the others leave with their counts per source.

Corrections. Smoothed probabilities of two sources differ from those of two
sources without any count only where one has the term. What a source's own terms add
against every other source's zero count is summed from a histogram of its counts;
what is left are terms that two sources share. Tasks stream the merged terms and
add these corrections per pair of sources, so only sums leave them.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import column, letters_table
from matchloom.operators.ranking import first_rows
from matchloom.session import broadcast_if_small, cut_lineage

#: Counts in a block before it is spilled, terms in a chunk of a run, documents that make a term count.
ENTRIES, CHUNK, LEAST_DOCS = 1_000_000, 5_000, 3
#: Merged terms that are summed together.
MERGED = 4_096
#: Shards for each shuffle partition, so that partitions get about as many terms each.
SHARDS_EACH = 4
#: Pairs of sources whose sums a task holds before it passes them on.
HELD = 1_000_000
SCALE = 1_000_000_000
TOP = 200

_TABLE = letters_table(digits=False)
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20


def _words(text: str) -> Iterator[list[bytes]]:
    """The terms of a whole text, lower-cased in A-Z, a bounded number of bytes at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Block:
    """Counts in memory: words per (language, source), and per language the documents of each term."""

    def __init__(self, shards: int) -> None:
        self.shards, self.counts, self.docs = shards, {}, {}

    def add(self, lang: str, source: str, text: str) -> None:
        seen: set[bytes] = set()
        counts = self.counts.setdefault((lang, source), Counter())
        for words in _words(text):
            counts.update(words)
            seen.update(words)
        self.docs.setdefault(lang, Counter()).update(seen)

    def size(self) -> int:
        return sum(map(len, self.counts.values())) + sum(map(len, self.docs.values()))

    def runs(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        """Chunks (shard, language, first term, contents) of the block, in term order within a shard."""
        for lang in sorted(self.docs, key=_utf8):
            docs = self.docs.pop(lang)
            terms = sorted(docs)
            place = {t: i for i, t in enumerate(terms)}
            sources = sorted(s for g, s in self.counts if g == lang)
            own = [self.counts.pop((lang, s)) for s in sources]
            at = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in own])
            number = np.repeat(np.arange(len(own)), [len(c) for c in own])
            count = np.concatenate([np.fromiter(c.values(), np.int64, len(c)) for c in own])
            order = np.lexsort((number, at))
            number, count = number[order], count[order]
            ends = np.cumsum(np.bincount(at, minlength=len(terms)))
            n_docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            shard = np.fromiter(map(zlib.crc32, terms), np.int64, len(terms)) % self.shards
            for of in range(self.shards):
                mine = np.flatnonzero(shard == of)
                for begin in range(0, len(mine), CHUNK):
                    part = mine[begin : begin + CHUNK]
                    sizes = ends[part] - np.where(part > 0, ends[part - 1], 0)
                    cells = np.repeat(ends[part] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())
                    words = [terms[i] for i in part]
                    yield of, _utf8(lang), words[0], pickle.dumps((words, n_docs[part], sizes, sources, number[cells], count[cells]), protocol=5)


def _utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _spilled(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(shards)

        def spill() -> Iterator[pa.RecordBatch]:
            for chunks in itertools.batched(block.runs(), 64):
                yield _batch(chunks, ("shard", "lang", "first", "entries"), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                block.add(lang, source, text)
                if block.size() >= ENTRIES:
                    yield from spill()
        yield from spill()

    return run


def _batch(rows: Sequence[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=list(names))


class _Run:
    """An open chunk: its terms, where each one's counts begin, and how far it is merged."""

    def __init__(self, entries: bytes) -> None:
        self.words, self.docs, sizes, sources, self.number, self.count = pickle.loads(entries)
        self.sources, self.sizes = np.array(sources, dtype=object), sizes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.done, self.at = 0, 0
        self.groups: list[int] = []


class _Merge:
    """Runs of one shard and language, merged by a heap of their next terms."""

    def __init__(self) -> None:
        self.heap: list[tuple[bytes, int]] = []
        self.runs: dict[int, _Run] = {}
        self.words: list[bytes] = []
        self.opened = 0

    def open(self, entries: bytes) -> None:
        self.opened += 1
        run = self.runs[self.opened] = _Run(entries)
        heapq.heappush(self.heap, (run.words[0], self.opened))

    def upto(self, limit: bytes | None) -> Iterator[tuple]:
        """Terms below ``limit`` (all without one): batches of words, documents, and (word, source, count)."""
        heap, runs, words = self.heap, self.runs, self.words
        while heap and (limit is None or heap[0][0] < limit):
            word, number = heap[0]
            if not words or words[-1] != word:
                if len(words) >= MERGED:
                    yield self._joined()
                words.append(word)
            run = runs[number]
            run.groups.append(len(words) - 1)
            run.at += 1
            if run.at < len(run.words):
                heapq.heapreplace(heap, (run.words[run.at], number))
            else:
                heapq.heappop(heap)
        # the last term may go on in a chunk that is not open yet only if it is not below the limit
        if words:
            yield self._joined()

    def _joined(self) -> tuple:
        """The terms merged so far with the sums of their documents and counts."""
        names: dict[str, int] = {}
        docs = np.zeros(len(self.words), dtype=np.int64)
        words, sources, counts = [], [], []
        for number, run in list(self.runs.items()):
            if run.groups:
                groups, part = np.array(run.groups), slice(run.done, run.at)
                docs[groups] += run.docs[part]
                cells = slice(run.starts[run.done], run.starts[run.at])
                ids = np.array([names.setdefault(s, len(names)) for s in run.sources], dtype=np.int64)
                words.append(np.repeat(groups, run.sizes[part]))
                sources.append(ids[run.number[cells]])
                counts.append(run.count[cells])
                run.done, run.groups = run.at, []
            if run.done == len(run.words):
                del self.runs[number]
        key = np.concatenate(words) * len(names) + np.concatenate(sources)
        cell, back = np.unique(key, return_inverse=True)
        total = np.zeros(len(cell), dtype=np.int64)
        np.add.at(total, back, np.concatenate(counts))
        out = self.words[:], docs, cell // len(names), np.array(list(names), dtype=object)[cell % len(names)], total
        self.words.clear()
        return out


def _merged_terms(chunks: Iterator[tuple[int, bytes, bytes, bytes]]) -> Iterator[tuple]:
    """Chunks in order of shard, language and first term, merged: (language, words, documents, word, source, count)."""
    for (_, lang), same in itertools.groupby(chunks, key=lambda c: c[:2]):
        merge = _Merge()
        for _, _, first, entries in same:
            for part in merge.upto(first):
                yield lang, *part
            merge.open(entries)
        for part in merge.upto(None):
            yield lang, *part


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms that count, with their counts per source."""
    chunks = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in range(4))))
    for lang, words, docs, word, source, count in _merged_terms(chunks):
        kept = np.flatnonzero(docs >= LEAST_DOCS)
        if not len(kept):
            continue
        cells = np.isin(word, kept)
        ends = np.concatenate([[0], np.cumsum(np.bincount(word[cells], minlength=len(words))[kept])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang.decode("utf-8", "replace")] * len(kept), pa.string()),
                pa.array([words[i].decode("utf-8", "replace") for i in kept], pa.string()),
                pa.ListArray.from_arrays(ends, pa.array(source[cells], pa.string())),
                pa.ListArray.from_arrays(ends, pa.array(count[cells], pa.int64())),
            ],
            names=["lang", "term", "sources", "counts"],
        )


def term_counts(docs: DataFrame) -> DataFrame:
    """Terms in at least three documents of their language: ``lang``, ``term``, ``sources``, ``counts``.

    ``docs`` has ``lang``, ``source`` and ``text`` without nulls. Written out, and
    read back.
    """
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("lang", "source", "text").mapInArrow(
        _spilled(partitions * SHARDS_EACH), "shard int, lang binary, first binary, entries binary"
    )
    dealt = runs.repartition(partitions, "shard").sortWithinPartitions("shard", "lang", "first")
    return cut_lineage(dealt.mapInArrow(_frequencies, "lang string, term string, sources array<string>, counts array<bigint>"))


def _part(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far each ``x`` of a term is from each ``y`` of it, terms in the first axis."""
    return (x[:, :, None] - y[:, None, :]) ** 2 // y[:, None, :]


class _Sums:
    """Sums per pair of sources, as a square that grows."""

    def __init__(self) -> None:
        self.at: dict[str, int] = {}
        self.square = np.zeros((16, 16), dtype=np.int64)

    def add(self, names: list[str], number: np.ndarray, value: np.ndarray) -> None:
        """Add ``value`` (term, source, source) of the sources ``number`` (term, source)."""
        places = np.array([self.at.setdefault(s, len(self.at)) for s in names], dtype=np.int64)
        if len(self.at) > len(self.square):
            wider = np.zeros((2 * len(self.at),) * 2, dtype=np.int64)
            wider[: len(self.square), : len(self.square)] = self.square
            self.square = wider
        at = places[number]
        np.add.at(self.square, (at[:, :, None], at[:, None, :]), value)

    def rows(self, lang: str) -> list[tuple]:
        names = list(self.at)
        return [(lang, names[i], names[j], int(self.square[i, j])) for i, j in zip(*np.nonzero(self.square)) if i != j]


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections per pair of sources, summed over the terms that both have.

    Each row has, for one term, its sources with their probabilities ``p`` and what
    these are without a count, ``zero``. Two sources that share the term have been
    counted as each against the other's zero. Terms with as many sources are taken
    together.
    """
    sums: dict[str, _Sums] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = [r for lang, s in sums.items() for r in s.rows(lang)]
        sums.clear()
        if rows:
            yield _batch(rows, ("lang", "source", "item", "value"), (pa.string(), pa.string(), pa.string(), pa.int64()))

    for batch in batches:
        langs, of = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1)
        cells = of.flatten()
        source = cells.field("source").dictionary_encode()
        names, number = source.dictionary.to_pylist(), np.asarray(source.indices)
        p, zero = (np.asarray(cells.field(c)) for c in ("p", "zero"))
        ends = np.asarray(of.offsets) - of.offsets[0].as_py()
        sizes = np.diff(ends)
        for lang in np.unique(langs):
            for size in np.unique(sizes[langs == lang]):
                rows = np.flatnonzero((langs == lang) & (sizes == size))
                step = max(1, HELD // int(size) ** 2)
                for begin in range(0, len(rows), step):
                    at = ends[rows[begin : begin + step], None] + np.arange(size)
                    x, z = p[at], zero[at]
                    value = _part(x, x) - _part(x, z) - _part(z, x) + _part(z, z)
                    sums.setdefault(str(lang), _Sums()).add(names, number[at], value)
        if sum(len(s.at) ** 2 for s in sums.values()) >= HELD:
            yield from out()
    yield from out()


def _probability(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 1) / (total + terms))``, exact."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, F.nullif(total + terms, F.lit(0)).cast("decimal(20,0)")) + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _group_facts(docs: DataFrame, terms: DataFrame, counted: DataFrame) -> DataFrame:
    """Per (lang, source) that occurs: its words ``n``, those of the language ``n_lang``, kept terms ``v``, ``zero``."""
    groups = docs.select("lang", "source").distinct()
    own = counted.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n_lang"))
    return cut_lineage(
        groups.join(own, ["lang", "source"], "left")
        .join(broadcast_if_small(cut_lineage(kept)), "lang", "left")
        .na.fill(0, ["n", "v", "n_lang"])
        .withColumn("zero", _probability(F.lit(0), F.col("n"), F.col("v")))
    )


def _pairs(facts: DataFrame, marked: DataFrame) -> DataFrame:
    """Distance of every source from every other source of its language: ``lang``, ``source``, ``item``, ``value``."""
    side = lambda c, *more: facts.select("lang", F.col("source").alias(c), F.col("zero").alias(f"zero_{c}"), *more)
    base = side("source", "v").join(side("item"), "lang").where("source <> item").select(
        "lang", "source", "item", F.coalesce(F.col("v") * _distance(F.col("zero_source"), F.col("zero_item")), F.lit(0)).alias("value")
    )
    counts = cut_lineage(marked.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("m")))
    others = broadcast_if_small(side("other"))
    met = counts.join(others, "lang").where("source <> other")
    zero, far = F.col("zero"), F.col("zero_other")
    one_sided = met.select("lang", F.explode(F.array(
        F.struct("source", F.col("other").alias("item"), (F.col("m") * (_distance(F.col("p"), far) - _distance(zero, far))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("item"), (F.col("m") * (_distance(far, F.col("p")) - _distance(far, zero))).alias("value")),
    )).alias("x")).select("lang", "x.*")
    shared = marked.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("of")).where(F.size("of") > 1)
    both = shared.select("lang", "of").mapInArrow(_pair_sums, "lang string, source string, item string, value bigint")
    total = base.unionByName(one_sided).unionByName(both)
    return total.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """Distances between the sources of each language, and the terms that set a source apart.

    Gives ``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``. In part
    ``pair`` the item is another source of the language, and all are ranked; in part
    ``term`` it is a term more likely in the source than in its language, up to rank
    200. Nulls in the three columns count as empty texts; a repeated row is a
    document of its own. A language without a term in three documents has pairs of
    value 0. An empty table gives no rows.
    """
    plain = docs.select(*[F.coalesce(column(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    terms = term_counts(plain)
    each = F.explode(F.arrays_zip("sources", "counts")).alias("x")
    in_all = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("in_lang")
    counted = terms.select("lang", "term", in_all, each).select("lang", "term", "in_lang", F.col("x.sources").alias("source"), F.col("x.counts").alias("count"))
    facts = _group_facts(plain, terms, counted)
    marked = cut_lineage(
        counted.join(broadcast_if_small(facts), ["lang", "source"]).select(
            "lang", "term", "source", "zero",
            _probability(F.col("count"), F.col("n"), F.col("v")).alias("p"),
            _probability(F.col("in_lang"), F.col("n_lang"), F.col("v")).alias("q"),
        )
    )
    apart = marked.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df, n: first_rows(df, ["lang", "source"], [F.col("value").desc(), "item"], n, rank="rank")
    parts = [("pair", ranked(_pairs(facts, marked), 2**31 - 1)), ("term", ranked(apart, TOP))]
    out = [df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, df in parts]
    return out[0].unionByName(out[1])
