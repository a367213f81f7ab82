"""Benchmark items in training documents: BM25 over the items with block-max WAND, then overlap.

The items are few and the passages many, so the index holds the items and each passage is a
query. Impacts are divided by the score that an item gives itself; so one threshold, a share of
that score, holds for all items. Items are cut into shards of bounded size, and each shard's
index goes to the executors whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import cut, tidy

K1, B = 1.2, 0.75
#: Share of an item's own score from which a passage is retrieved, and of its shingles that must overlap.
RETRIEVE, OVERLAP = 0.65, 0.8
SHINGLE = 5
#: Items to a block of the index, and characters of items to a shard.
BLOCK, SHARD = 4, 8_000_000
_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"(?<=[.?!:])\s+|\n")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all sentences but the last, and of the last; a single sentence is all question."""
    parts = [x for x in map(words, _ANSWER.split(text)) if x]
    return (sum(parts[:-1], []), parts[-1]) if len(parts) > 1 else (sum(parts, []), [])


def shingles(ids: list[int], width: int = SHINGLE) -> set[tuple[int, ...]]:
    return {tuple(ids[i : i + width]) for i in range(max(1, len(ids) - width + 1))} if ids else set()


@dataclass
class Index:
    """Postings of one shard, term by term, cut into blocks of items.

    items and impacts hold the postings; entry e of the block table is term e's or a later
    term's share of one block: its block, its greatest impact and where its postings lie. The
    entries of term k are those from first[k] to first[k + 1].
    """

    ids: list = field(default_factory=list)
    terms: dict[str, int] = field(default_factory=dict)
    items: list[int] = field(default_factory=list)
    impacts: list[float] = field(default_factory=list)
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, int))
    block: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    begin: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    end: np.ndarray = field(default_factory=lambda: np.zeros(0, int))
    longest: int = 0
    parts: list[tuple[set, set, set]] = field(default_factory=list)

    @classmethod
    def of(cls, rows: list[tuple[object, str]], all_items: tuple[int, float, dict[str, int]] | None = None) -> Index:
        """Items without a word can't be found and are left out.

        all_items: number and mean length of all items, and how many have each term, where rows are
        a share of them only; so an item's impacts don't depend on the share it is in.
        """
        own = cls()
        bags = [(i, t, words(t)) for i, t in rows]
        bags = sorted((x for x in bags if x[2]), key=lambda x: (len(x[2]), str(x[0])))  # similar lengths share blocks: tighter bounds
        if not bags:
            return own
        counts = [Counter(w) for _, _, w in bags]
        number, mean, df = all_items or (len(bags), sum(len(w) for _, _, w in bags) / len(bags), Counter(t for c in counts for t in c))
        postings: dict[str, list[tuple[int, float]]] = {}
        for place, ((_, _, w), c) in enumerate(zip(bags, counts, strict=True)):
            raw = {t: float(np.log1p((number - df[t] + 0.5) / (df[t] + 0.5))) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean)) for t, n in c.items()}
            whole = sum(raw.values())
            for t, x in raw.items():
                postings.setdefault(t, []).append((place, x / whole))
        own.ids, own.longest = [i for i, _, _ in bags], max(len(w) for _, _, w in bags)
        own.terms = {t: k for k, t in enumerate(postings)}
        first, table = [0], []
        for x in postings.values():
            for block, group in groupby(x, lambda y: y[0] // BLOCK):
                group = list(group)
                table.append((block, max(y[1] for y in group), len(own.items), len(own.items) + len(group)))
                own.items += [y[0] for y in group]
                own.impacts += [y[1] for y in group]
            first.append(len(table))
        own.first = np.array(first)
        own.block, own.most, own.begin, own.end = (np.array(x) for x in zip(*table, strict=True))
        for _, text, _ in bags:
            question, answer = question_and_answer(text)
            own.parts.append(tuple(shingles([own.terms[w] for w in x]) for x in (question, answer, question + answer)))
        return own

    def rare(self, share: float = RETRIEVE) -> np.ndarray:
        """Terms without any of which no item can reach its threshold: for each item, its strongest ones, as many as leave less than that to the rest."""
        by_item: list[list[tuple[float, int]]] = [[] for _ in self.ids]
        for k in range(len(self.terms)):
            for j in range(self.begin[self.first[k]], self.end[self.first[k + 1] - 1]):
                by_item[self.items[j]].append((self.impacts[j], k))
        out = np.zeros(len(self.terms) + 1, bool)  # the last stands for words outside of the index
        for own in by_item:
            rest = 1.0
            for s, k in sorted(own, reverse=True):
                if rest < share - 1e-6:
                    break
                out[k], rest = True, rest - s
        return out

    def wand(self, query: np.ndarray, share: float = RETRIEVE) -> list[tuple[int, float]]:
        """Every (place, score) with a score of at least `share`, for the distinct terms of a passage.

        The greatest impacts of the terms in a block bound the scores of its items. Blocks whose
        bound stays below the threshold are skipped whole; in the others the lists advance item
        by item, and an item is scored if the bounds of the lists up to it reach the threshold.
        """
        share -= 1e-6  # sums in another order differ in the last digits
        sizes = self.first[query + 1] - self.first[query]
        entries = np.repeat(self.first[query] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        if not len(entries):
            return []
        block, most = self.block[entries], self.most[entries]
        live = np.bincount(block, most) >= share
        if not live.any():
            return []
        stay = np.flatnonzero(live[block])
        stay = stay[np.argsort(block[stay], kind="stable")]
        found: list[tuple[int, float]] = []
        rows = zip(block[stay].tolist(), self.begin[entries[stay]].tolist(), self.end[entries[stay]].tolist(), most[stay].tolist(), strict=True)
        for _, group in groupby(rows, lambda x: x[0]):
            found += self._in_block([[self.items[lo], lo, hi, bound] for _, lo, hi, bound in group], share)
        return found

    def _in_block(self, lists: list[list], share: float) -> Iterator[tuple[int, float]]:
        while lists:
            lists.sort()
            bound, at = 0.0, -1
            for x in lists:
                bound += x[3]
                if bound >= share:
                    at = x[0]
                    break
            if at < 0:
                return
            if lists[0][0] == at:
                score = sum(self.impacts[x[1]] for x in lists if x[0] == at)
                if score >= share:
                    yield at, score
                at += 1
            for x in lists:  # all lists before the pivot, one step or more
                while x[0] < at:
                    x[1] += 1
                    x[0] = self.items[x[1]] if x[1] < x[2] else 1 << 62
            lists = [x for x in lists if x[1] < x[2]]


class Finder:
    """Finds the items of one shard in texts."""

    def __init__(self, index: Index, retrieve: float = RETRIEVE, overlap: float = OVERLAP):
        self.index, self.retrieve, self.overlap = index, retrieve, overlap
        self.stride = max(1, index.longest)
        self.rare = index.rare(retrieve) if index.ids else np.zeros(1, bool)

    def __call__(self, text: str | None) -> list[tuple[int, float, float, float]]:
        """(place, score, share of the question, share of the answer) of each item, from the passage that has most of it.

        A passage is twice as long as the longest item and begins every such length, so that one
        holds any item whole. An item is found if its score reaches its bound, and the share of its
        shingles, or else both parts' shares, theirs: items need not have an answer of their own, and
        one word takes much of a short last sentence. Parts may stand apart from each other.
        """
        if not self.index.ids:
            return []
        known = self.index.terms
        ids = np.array([known.get(w, -1) for w in words(text)], np.int64)
        hits = np.flatnonzero(self.rare[ids])
        found: dict[int, tuple[int, float, float, float]] = {}
        windows = sorted({w for h in set((hits // self.stride).tolist()) for w in (h, h - 1) if w >= 0})
        for w in windows:
            part = ids[w * self.stride : (w + 2) * self.stride]
            hit = self.index.wand(np.unique(part[part >= 0]), self.retrieve)
            own = {tuple(run[i : i + k]) for run in [part.tolist()] for k in range(1, SHINGLE + 1) for i in range(len(run) - k + 1)} if hit else set()
            for place, score in hit:
                q, a, whole = (len(x & own) / len(x) if x else 1.0 for x in self.index.parts[place])
                if max(whole, min(q, a)) >= self.overlap and (place not in found or found[place][1:] < (score, q, a)):
                    found[place] = (place, score, q, a)
        return [found[p] for p in sorted(found)]


def _terms(items: DataFrame) -> DataFrame:
    """(size, term): a row for each item, its number of words as size, and one for each of its different words, as term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [w for w in (words(x.as_py()) for x in batch.column(0)) if w]
            terms = [t for w in bags for t in set(w)]
            yield pa.RecordBatch.from_arrays([pa.array([*map(len, bags), *[None] * len(terms)], pa.int64()), pa.array([*[None] * len(bags), *terms], pa.string())], names=["size", "term"])

    return items.select("text").mapInArrow(run, "size bigint, term string")


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard: int = SHARD) -> Iterator[Index]:
    """Indexes over all items with a text, each of at most so many characters or of one item, one after the other.

    The driver holds one shard of texts at a time; the statistics of items that don't fit into one
    are counted by the executors, and a shard gets those of its own terms. Repeated rows count once.
    """
    own = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col(text_col).isNotNull()).distinct()
    told = None
    if (own.agg(F.sum(F.length("text"))).first()[0] or 0) > shard:
        found = cut(_terms(own))
        number, mean = found.agg(F.count("size"), F.avg("size")).first()
        told = number, mean or 1.0, cut(found.where("term is not null").groupBy("term").agg(F.count("*").alias("n")))

    def made(rows: list[tuple[object, str]]) -> Index:
        if told is None:
            return Index.of(rows)
        terms = own.sparkSession.createDataFrame([(t,) for t in sorted({t for _, x in rows for t in words(x)})], "term string")
        return Index.of(rows, (told[0], told[1], dict(map(tuple, told[2].join(F.broadcast(terms), "term").select("term", "n").collect()))))

    rows, size = [], 0
    for r in own.orderBy("id", "text").toLocalIterator():
        if rows and size + len(r[1]) > shard:
            yield made(rows)
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += len(r[1])
    if rows:
        yield made(rows)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """(id, item, score, question, answer): one row for each row of docs and item found in it.

    Every passage of every whole text is searched. Null texts and items have no match; no items
    give no rows. Null ids stay, repeated rows are rows of their own, further columns are ignored.
    Items with the same words are all found.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    shape = f"id {kind}, item {item_kind.simpleString()}, score double, question double, answer double"
    out = docs.sparkSession.createDataFrame([], shape)
    for index in indexes(items, item_col):
        held = docs.sparkSession.sparkContext.broadcast(index)  # bounded by SHARD

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            find = Finder(held.value, retrieve, overlap)
            for batch in batches:
                got = [(row, *hit) for row, text in enumerate(batch.column(1)) for hit in find(text.as_py())]
                cols = [batch.column(0).take(pa.array([g[0] for g in got], pa.int64())), pa.array([find.index.ids[g[1]] for g in got], batch_kind)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array([g[k] for g in got], pa.float64()) for k in (2, 3, 4))], names=["id", "item", "score", "question", "answer"])

        from pyspark.sql.pandas.types import to_arrow_type

        batch_kind = to_arrow_type(item_kind)
        out = out.unionByName(own.mapInArrow(run, shape))
    return out


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", retrieve: float = RETRIEVE, overlap: float = OVERLAP) -> DataFrame:
    """The rows of docs, whole and with all columns, in which matches() finds no item."""
    place = docs.columns.index(text_col)
    for index in indexes(items, item_col):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            find = Finder(held.value, retrieve, overlap)
            for batch in batches:
                yield batch.filter(pa.array([not find(text.as_py()) for text in batch.column(place)], pa.bool_()))
            tidy()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
