"""Ranked lexical search for many queries at once, with their common parts computed once.

Queries are sets of terms. Terms that stand in the same queries are one atom; then
the two parts that most queries share become one part, again and again, as long as
two queries share a pair. The result is a graph: atoms add up terms, inner nodes add
two parts, a query adds the parts left to it. For a block of documents every node's
partial scores are computed once, from its two parts, and used by all queries above
it, so a common term set is added up once and not once per query.

Documents are read once: their counts of query terms are written with the length,
document frequencies are summed from that, and the second pass scores. Each task
keeps the best of every query, so ``TOP`` rows per task and query are shuffled.
Queries are taken in blocks of bounded size, documents are never paired with them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import column, letters_table
from matchloom.operators.ranking import first_rows
from matchloom.session import cut_lineage, discard

TOP = 50
#: Queries and their terms that are scored together.
QUERIES, TERMS = 2_000, 400_000
#: Cells of partial scores that a task holds.
CELLS = 8_000_000
#: Bytes of a text that are cut into words at a time.
SLICE = 1 << 20

_TABLE = letters_table(digits=True)


def _words(text: str) -> Iterator[list[bytes]]:
    data = text.encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def _term_counts(text: str | None) -> tuple[int, Counter]:
    """Terms of a whole text with repeats, and how often each occurs."""
    counts: Counter = Counter()
    for words in _words(text or ""):
        counts.update(words)
    return counts.total(), counts


@dataclass(frozen=True)
class SharingGraph:
    """``atoms``: term numbers per atom. ``pairs``: the two nodes that each further node adds. ``queries``: nodes per query."""

    atoms: list[list[int]]
    pairs: list[tuple[int, int]]
    queries: list[list[int]]


def sharing_graph(queries: Sequence[frozenset[int]]) -> SharingGraph:
    """Common term sets of the queries, by repeatedly joining the pair of parts that most queries share."""
    where: dict[int, list[int]] = defaultdict(list)
    for q, terms in enumerate(queries):
        for t in sorted(terms):
            where[t].append(q)
    same: dict[tuple[int, ...], list[int]] = defaultdict(list)
    for t in sorted(where):
        same[tuple(where[t])].append(t)
    atoms = list(same.values())
    parts: list[set[int]] = [set() for _ in queries]
    holders: list[set[int]] = []
    for a, at in enumerate(same):
        holders.append(set(at))
        for q in at:
            parts[q].add(a)
    pairs: list[tuple[int, int]] = []
    shared = [n for n in range(len(holders)) if len(holders[n]) > 1]
    # widest first: a node meets the nodes left in the queries it stands in
    waiting = sorted(shared, key=lambda n: (-len(holders[n]), n))
    while waiting:
        node = waiting.pop(0)
        if len(holders[node]) < 2:
            continue
        met = Counter(other for q in holders[node] for other in parts[q] if other != node)
        best = max(met.items(), key=lambda x: (x[1], -x[0]), default=(0, 0))
        if best[1] < 2:
            continue
        both = holders[node] & holders[best[0]]
        made = len(holders)
        pairs.append((node, best[0]))
        holders.append(both)
        for old in (node, best[0]):
            holders[old] = holders[old] - both
        for q in both:
            parts[q] = (parts[q] - {node, best[0]}) | {made}
        waiting = [made, node, *waiting]
    return SharingGraph(atoms, pairs, [sorted(p) for p in parts])


def _counted(vocabulary: dict[bytes, int]):
    """Task function: length and counts of the query terms of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ids, counts = [], [], []
            for text in batch.column("text").to_pylist():
                n, found = _term_counts(text)
                known = [(vocabulary[w], c) for w, c in found.items() if w in vocabulary]
                lengths.append(n)
                ids.append([k for k, _ in known])
                counts.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "counts"],
            )

    return run


class _Best:
    """The best documents of one query so far: score descending, then id."""

    def __init__(self, top: int) -> None:
        self.top, self.least = top, 1
        self.scores, self.ids, self.null = (np.empty(0, dtype=t) for t in (np.int64, np.int64, bool))

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.least)
        if not len(good):
            return
        self.scores = np.concatenate([self.scores, scores[good]])
        self.ids, self.null = np.concatenate([self.ids, ids[good]]), np.concatenate([self.null, null[good]])
        order = np.lexsort((self.ids, self.null, -self.scores))[: self.top]
        self.scores, self.ids, self.null = self.scores[order], self.ids[order], self.null[order]
        if len(order) == self.top:
            self.least = int(self.scores[-1])


def _scored(graph: SharingGraph, weights: np.ndarray, items: list, n_docs: int, n_words: int, top: int):
    """Task function: the best documents of every query among those of the partition."""
    n_atoms = len(graph.atoms)
    atom_of = np.zeros(len(weights), dtype=np.int64)
    for a, terms in enumerate(graph.atoms):
        atom_of[terms] = a
    width = max(1, min(2048, CELLS // max(1, n_atoms + len(graph.pairs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(top) for _ in items]
        nodes = np.zeros((n_atoms + len(graph.pairs), width), dtype=np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, width):
                batch = whole.slice(at, width)
                ids = batch.column("id")
                null = np.asarray(ids.is_null())
                numbers = np.asarray(ids.fill_null(0)).astype(np.int64)
                sizes = np.diff(np.asarray(batch.column("terms").offsets))
                terms, counts = (np.asarray(batch.column(c).flatten()).astype(np.int64) for c in ("terms", "counts"))
                length = [100 - 50 + 50 * n * n_docs // n_words for n in batch.column("n").to_pylist()]
                doc = np.repeat(np.arange(batch.num_rows), sizes)
                part = weights[terms] * (1_000_000_000 * counts // (1000 * counts + 20 * np.array(length, dtype=np.int64)[doc]))
                nodes[:n_atoms] = 0
                np.add.at(nodes, (atom_of[terms], doc), part)
                for i, (a, b) in enumerate(graph.pairs, n_atoms):
                    np.add(nodes[a], nodes[b], out=nodes[i])
                for q, parts in enumerate(graph.queries):
                    if parts:
                        best[q].add(nodes[parts, : batch.num_rows].sum(axis=0), numbers, null)
        rows = [
            (items[q], None if missing else int(d), int(s)) for q, b in enumerate(best) for s, d, missing in zip(b.scores, b.ids, b.null)
        ]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)], names=["item_id", "doc_id", "score"]
            )

    return run


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, frozenset[bytes]]]]:
    """Queries in blocks of bounded size, a block at a time on the driver."""
    block, held = [], 0
    for item, text in queries.toLocalIterator():
        terms = frozenset(w for words in _words(text or "") for w in words)
        if block and (len(block) >= QUERIES or held + len(terms) > TERMS):
            yield block
            block, held = [], 0
        block.append((item, terms))
        held += len(terms)
    if block:
        yield block


def ranked_search(
    docs: DataFrame, queries: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", top: int = TOP
) -> DataFrame:
    """The ``top`` documents of every query: ``item_id``, ``rank``, ``doc_id``, ``score``.

    Ids are integers. Scores are the integer form of BM25 (k1 1, b 0.5) over whole
    texts; documents that score nothing are left out, equal scores come in order of
    the id, a null id last. Null texts have no terms. A repeated document is ranked
    twice; a query that is repeated under one id is ranked as often, its rows
    sharing the ranks. Without documents or queries there are no rows.
    """
    plain = docs.select(column(id).cast("long").alias("id"), column(text).alias("text"))
    asked = queries.select(column(item).cast("long").alias("item"), column(query).alias("text")).orderBy("item", "text")
    found: DataFrame | None = None
    for block in _blocks(asked):
        scored = _search_block(plain, block, top)
        found = scored if found is None else found.unionByName(scored)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    ranked = first_rows(found, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], top, rank="rank")
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, block: list[tuple[int, frozenset[bytes]]], top: int) -> DataFrame:
    names = sorted(set().union(*(terms for _, terms in block)))
    vocabulary = {w: i for i, w in enumerate(names)}
    graph = sharing_graph([frozenset(vocabulary[w] for w in terms) for _, terms in block])
    counted = cut_lineage(docs.mapInArrow(_counted(vocabulary), "id bigint, n bigint, terms array<int>, counts array<bigint>"))
    total = counted.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words")).first()
    if not total["docs"]:
        return docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    # a number per term of the block
    frequency = dict(counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1))).toLocalIterator())
    weights = np.array([
        math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(len(names))
    ], dtype=np.int64)
    task = _scored(graph, weights, [item for item, _ in block], total["docs"], total["words"], top)
    out = cut_lineage(counted.mapInArrow(task, "item_id bigint, doc_id bigint, score bigint"))
    discard(counted)
    return out
