"""Toxicity scores by a word classifier that may not react to the exchange of identity terms."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import cut, labelled_sample

#: At most so many labelled documents are learnt from, with so many features.
SAMPLE, VOCABULARY = 10_000, 2_000
#: A feature must occur in so many of the sample's documents.
LEAST = 4
#: Lengths of the word beginnings that are features besides whole words.
BEGINNINGS = (4, 5)
#: A document counts as toxic from this score on.
TOXIC = 0.3

#: Groups of terms for people; a swap puts another of its group in a term's place.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"), ("female", "male"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"), ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"), ("gay", "lesbian", "straight", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("mexican", "american", "chinese", "indian", "german", "french", "polish", "turkish"),
    ("old", "young"), ("disabled", "blind", "deaf"), ("poor", "rich"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
)
GROUP = {term: (group, i) for group in IDENTITY for i, term in enumerate(group)}

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features(own: set[str]) -> set[str]:
    """Words, marked by "=", and the beginnings of longer ones."""
    out = {f"={w}" for w in own}
    for k in BEGINNINGS:
        out |= {w[:k] for w in own if len(w) > k}
    return out


def swapped(own: set[str]) -> list[set[str]]:
    """The words with every identity term exchanged, once for each other term of the largest group; none without a term."""
    terms = [w for w in own if w in GROUP]
    if not terms:
        return []
    other = lambda w, k: GROUP[w][0][(GROUP[w][1] + k) % len(GROUP[w][0])]
    rest = own.difference(terms)
    return [rest | {other(w, k) for w in terms} for k in range(1, max(len(GROUP[w][0]) for w in terms))]


class Rows:
    """A matrix that is almost empty: for each entry its row, column and value."""

    def __init__(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, shape: tuple[int, int]):
        self.row, self.column, self.value, self.shape = row, column, value, shape

    @classmethod
    def of(cls, x: np.ndarray | Rows) -> Rows:
        if isinstance(x, Rows):
            return x
        row, column = np.nonzero(x)
        return cls(row, column, x[row, column].astype(float), x.shape)

    @classmethod
    def build(cls, rows: list[dict[int, float]], width: int) -> Rows:
        sizes = [len(r) for r in rows]
        column = np.fromiter((c for r in rows for c in r), np.int64, sum(sizes))
        value = np.fromiter((v for r in rows for v in r.values()), float, sum(sizes))
        return cls(np.repeat(np.arange(len(rows)), sizes), column, value, (len(rows), width))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column] * self.value, self.shape[0])

    def back(self, g: np.ndarray) -> np.ndarray:
        """The transposed matrix times g."""
        return np.bincount(self.column, g[self.row] * self.value, self.shape[1])


@dataclass(frozen=True)
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        own = words(text)
        total = self.bias
        for w in own:
            total += self.weights.get(f"={w}", 0.0)
        for k in BEGINNINGS:
            for w in {w[:k] for w in own if len(w) > k}:
                total += self.weights.get(w, 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


def train(x: np.ndarray | Rows, y: np.ndarray, change: np.ndarray | Rows, share: np.ndarray | None = None, fairness: float = 20.0, ridge: float = 2e-3, steps: int = 400, rate: float = 0.3) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression.

    change: the features of a sentence with identity terms less those of a counterfactual, a row
    for each; share: the weight of each row, one in all (None: equal). The loss adds `fairness`
    times the weighted mean square of the score changes that the weights make of them. Minimised by
    gradient steps with momentum and per-weight rates, from zero.
    """
    x, change = Rows.of(x), Rows.of(change)
    n, width = x.shape
    share = np.full(change.shape[0], 1 / max(1, change.shape[0])) if share is None else share
    rate_of = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(width), float(np.log(rate_of / (1 - rate_of)))
    if not n or y.min() == y.max():
        return w, b
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.dot(w) + b, -40, 40)))
        grad = x.back(p - y) / n + ridge * w
        if change.shape[0]:
            grad += 2 * fairness * change.back(share * change.dot(w))
        g = np.append(grad, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate / (1 + 0.02 * t) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE, vocabulary: int = VOCABULARY, fairness: float = 20.0) -> Classifier:
    """A classifier of labels.toxic from the texts of at most `sample` labelled documents that `allowed` lets in.

    Labels, ids and texts that are null do not count; of several labels of an id the largest holds,
    of several texts the least. Without rows, or with labels of one kind, it knows its bias only.

    Executors count in how many toxic and other documents each feature occurs; the `vocabulary`
    features that tell the two apart most surely, and those of identity terms, are all that the
    driver gets of a document.
    """
    chosen = cut(labelled_sample(docs, labels, "toxic", sample, allowed))
    total, toxic = chosen.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = sorted(features(words(text.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], names=["feature", "label"])

    seen = chosen.select("doc_id", "label", "text").mapInArrow(every, "feature string, label int")
    seen = seen.groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("k")).where(F.col("n") >= LEAST)
    share = toxic / max(1, total)
    surely = F.abs(F.col("k") - F.col("n") * share) / F.sqrt(F.col("n") * max(1e-9, share * (1 - share)))
    names = [r.feature for r in seen.orderBy(F.desc(surely), "feature").limit(vocabulary).collect()]
    names = sorted({*names, *features(set(GROUP))})
    place = {f: i for i, f in enumerate(names)}

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, others = [], []
            for text in batch.column(2):
                own = words(text.as_py())
                places = lambda x: sorted(place[f] for f in features(x) & place.keys())
                rows.append(places(own))
                others.append([places(x) for x in swapped(own)])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind), pa.array(others, pa.list_(kind))], names=["id", "label", "x", "others"])

    own = chosen.select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(known, "id string, label int, x array<int>, others array<array<int>>")
    rows = sorted((tuple(r) for r in own.collect()), key=lambda r: r[0])  # bounded by `sample`
    changes, share = [], []
    for _, _, has, others in rows:
        for other in others:
            changes.append({k: float((k in has) - (k in other)) for k in {*has} ^ {*other}})
            share.append(1 / len(others))
    x = Rows.build([dict.fromkeys(r[2], 1.0) for r in rows], len(names))
    w, b = train(x, np.array([r[1] for r in rows], float), Rows.build(changes, len(names)), np.array(share) / max(1e-9, sum(share)), fairness)
    return Classifier({f: float(w[i]) for f, i in place.items() if w[i]}, b)


def scored(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row, from the whole text and nothing else. Null and empty texts get the bias's score."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([model.score(x.as_py()) for x in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), got], names=["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4; ids that are null aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
