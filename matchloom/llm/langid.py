"""Language identification by averaged hashed subword embeddings.

A text is the average of the embeddings of its character 2- to 4-grams, each
found by a hash; a linear softmax on the average gives the language (the model
of Joulin et al., 2016). It is trained in numpy by stochastic gradient descent on
a bounded sample of labelled rows: per language, the rows with the smallest
hashes of their ids. The last fifth of the sample is not trained on but sets the
temperature of the softmax and the score under which a prediction is rejected.

For prediction embeddings and output layer collapse into one table of a number
per (hash, language), so a text costs a sum of table rows. Tables are a few
hundred kilobytes and go out with the tasks.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from matchloom.llm.common import column, free_name
from matchloom.operators.ranking import first_rows
from matchloom.session import cut_lineage

#: Size of the hash table, of an embedding, of the n-grams.
BUCKETS, DIMENSION, GRAMS = 1 << 14, 16, (2, 3, 4)
#: Bound of the training sample: rows per language, and languages (the most frequent ones).
SAMPLE_ROWS, LANGUAGES = 400, 256
EPOCHS, RATE, BATCH, SEED = 8, 20.0, 16, 42
CALIBRATION_SHARE, ALLOWED_ERROR = 5, 0.01
UNKNOWN = "und"
#: Characters hashed at a time while a long text is read.
BLOCK = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def _hashes(text: str) -> Iterator[np.ndarray]:
    """Table places of the n-grams of a whole text, in blocks; none if it has no letter.

    Letters are lower-cased, everything else is one kind of gap, so an n-gram
    knows where words begin and end.
    """
    lowered = text.lower()
    for at in range(0, len(lowered), BLOCK):
        part = lowered[max(0, at - GRAMS[-1] + 1) : at + BLOCK]
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        codes = np.where(_letters()[codes], codes, 32).astype(np.uint32)
        if at == 0:
            codes = np.concatenate((np.full(1, 32, np.uint32), codes))
        if at + BLOCK >= len(lowered):
            codes = np.concatenate((codes, np.full(1, 32, np.uint32)))
        gap = codes == 32
        if gap.all():
            continue
        value = codes * np.uint32(2654435761)
        for n in range(2, GRAMS[-1] + 1):
            value = value[:-1] * np.uint32(16777619) ^ codes[n - 1 :] * np.uint32(2654435761)
            if n in GRAMS:
                mixed = value ^ (value >> np.uint32(15))
                mixed = mixed * np.uint32(2246822519)
                inside = ~(gap[: len(mixed)] & gap[1 : len(mixed) + 1])
                if at:
                    inside[: GRAMS[-1] - n] = False  # met in the block before
                yield (mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside]


def bag(text: str | None) -> np.ndarray | None:
    """Counts of a text's n-grams by place; None without letters."""
    total = None
    for places in _hashes(text or ""):
        counted = np.bincount(places, minlength=BUCKETS)
        total = counted if total is None else total + counted
    return total


@dataclass(frozen=True)
class Model:
    """Languages, a number per (place, language), softmax bias and temperature, least accepted score."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return counts @ self.table / max(1, counts.sum()) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        counts = bag(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0, False
        scores = softmax(self.logits(counts) / self.temperature)
        best = int(scores.argmax())
        score = float(min(1.0, scores[best]))
        return self.languages[best], score, score >= self.least


def softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return powers / powers.sum(axis=-1, keepdims=True)


Bag = tuple[np.ndarray, np.ndarray]


def dense(bags: list[Bag]) -> np.ndarray:
    """Shares of the n-grams of some texts, a row each."""
    out = np.zeros((len(bags), BUCKETS), np.float32)
    for row, (places, counts) in zip(out, bags):
        row[places] = counts / counts.sum()
    return out


def fit(bags: list[Bag], labels: list[str]) -> Model:
    """Train on rows ((places, counts), language); every fifth row of a language calibrates.

    Rows stay sparse but for the batch at hand, and must come in a fixed order. Few languages or rows are no error: without
    any the model knows nothing, with one it predicts that one.
    """
    languages = tuple(sorted(set(labels)))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in labels])
    nth = np.zeros(len(y), dtype=int)
    for k in range(len(languages)):
        nth[y == k] = np.arange((y == k).sum())
    held = nth % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    rng = np.random.default_rng(SEED)
    embedding = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32) / DIMENSION
    output, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    rows = np.flatnonzero(~held)
    step, steps = 0, EPOCHS * -(-len(rows) // BATCH)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(rows), -(-len(rows) // BATCH)):
            rate = RATE * (1 - step / steps)
            x = dense([bags[i] for i in part])
            hidden = x @ embedding
            error = softmax(hidden @ output + bias)
            error[np.arange(len(part)), y[part]] -= 1
            error /= len(part)
            back = error @ output.T
            output -= rate * hidden.T @ error
            bias -= 0.05 * rate * error.sum(axis=0)
            embedding -= rate * x.T @ back
            step += 1
    table = embedding @ output
    shares = [bags[i][1] / bags[i][1].sum() @ table[bags[i][0]] for i in np.flatnonzero(held)]
    logits = np.array(shares, dtype=np.float64).reshape(len(shares), len(languages)) + bias
    temperature, least = calibrate(logits, y[held])
    return Model(languages, table, bias, temperature, least)


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature with the best likelihood, where one more row may be wrong than was seen, and the least score that keeps errors within the allowed share.

    The score is the smallest at which accepted held-back rows, those with that
    score or more, are wrong in at most ``ALLOWED_ERROR`` of cases.
    """
    if not len(y):
        return 1.0, 0.0
    choices, unsure = np.geomspace(0.05, 20, 61), 1 / (len(y) + 2)

    def cost(t: float) -> float:
        p = softmax(logits / t)[np.arange(len(y)), y].clip(1e-12, 1 - 1e-12)
        return float(-((1 - unsure) * np.log(p) + unsure * np.log(1 - p)).mean())

    loss = [cost(t) for t in choices]
    temperature = float(choices[int(np.argmin(loss))])
    scores = softmax(logits / temperature)
    top, right = scores.max(axis=1), scores.argmax(axis=1) == y
    order = np.argsort(-top, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= ALLOWED_ERROR)
    if not len(good):
        return temperature, float(top.max())
    return temperature, 0.0 if good[-1] == len(y) - 1 else float(top[order[good[-1]]])


def sample(docs: DataFrame, id: str, text: str, lang: str) -> DataFrame:
    """At most ``SAMPLE_ROWS`` labelled rows with letters per language, by hash of the id.

    First only ids and labels are read, to find each language's largest hash;
    texts are read for rows up to that hash.
    """
    usable = docs.select(
        F.xxhash64(column(id)).alias("draw"), column(lang).alias("label"), column(text).alias("text")
    ).where(F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labels = docs.select(F.xxhash64(column(id)).alias("draw"), column(lang).alias("label")).where("label is not null")
    # rows without a letter cannot be drawn, so a quarter more ids are looked at
    frequent = labels.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).select("label")
    wide = first_rows(labels, ["label"], ["draw"], SAMPLE_ROWS + SAMPLE_ROWS // 4)
    limits = cut_lineage(wide.groupBy("label").agg(F.max("draw").alias("limit")).join(frequent, "label"))
    near = usable.join(F.broadcast(limits), "label").where(F.col("draw") <= F.col("limit")).drop("limit")
    return first_rows(near, ["label"], ["draw", "text"], SAMPLE_ROWS)


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit a model on a bounded sample of ``docs``; what reaches the driver are sparse n-gram counts."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [bag(t) for t in batch["text"]]
            places = [np.zeros(0, int) if b is None else np.flatnonzero(b) for b in bags]
            counts = [[] if b is None else b[p] for b, p in zip(bags, places)]
            yield pd.DataFrame({"label": batch["label"], "draw": batch["draw"], "places": places, "counts": counts})

    rows = (
        sample(docs, id, text, lang)
        .mapInPandas(counted, "label string, draw long, places array<int>, counts array<long>")
        .where(F.size("places") > 0)
        .toPandas()
        .sort_values(["draw", "label"], kind="stable")
    )
    bags = [(np.asarray(p), np.asarray(c, np.float32)) for p, c in zip(rows["places"], rows["counts"])]
    return fit(bags, list(rows["label"]))


def identify(docs: DataFrame, model: Model, out: str = "language", text: str = "text") -> DataFrame:
    """Add a struct ``out``: ``lang``, ``score`` from 0 to 1, ``accepted``.

    A null text or one without a letter is ``und`` with score 0 and not accepted.
    Only the text is looked at. Other columns, whatever their names, pass through.
    """
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("accepted", BooleanType())])

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([model.predict(t) for t in batch], columns=["lang", "score", "accepted"])

    return docs.withColumn(out, predict(column(text)))


def keep_identified(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the labelled rows and drop documents whose language is not recognised."""
    at = free_name(docs.columns, "language")
    return identify(docs, train(docs, id, text, lang), at, text).where(F.col(at)["accepted"]).drop(at)
