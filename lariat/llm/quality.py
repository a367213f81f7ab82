"""Quality rules: statistics of whole texts, and boosted trees over them with monotonic constraints."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import labelled_sample, tidy

#: At most so many labelled documents train the trees.
SAMPLE = 12_000
#: A document stays if the trees give it at least this probability of good quality.
KEEP = 0.5

SPACES, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_UPPER = re.compile("[A-Z]")
_DIGIT = re.compile("[0-9]")
_MARK = re.compile(r"[!?]")

#: Name of each feature, and how the probability of good quality may move with it (0: freely).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_lines": -1, "repeat_words": -1,
    "upper": -1, "digits": 0, "marks_per_word": -1, "distinct_words": 0, "mean_line": 0, "top_word": -1,
}


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Positions that lie in a window of three that occurs more than once."""
    n = len(ids) - 2
    if n < 2:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds >= 1 << 21:
        pair = np.unique(pair, return_inverse=True)[1]
    _, at, count = np.unique(pair[:n] * kinds + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(len(ids), bool)
    start = np.flatnonzero(count[at] > 1)
    for k in range(3):
        covered[start + k] = True
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), and the features of FEATURES.

    Words are runs of characters other than space and \\t to \\r. A null text has no words.
    """
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes.split() knows these six spaces only
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    repeat = _repeated(ids, max(1, len(known)))
    top = int(np.bincount(ids).max()) if n else 0
    m, c = max(1, n), max(1, chars)
    features = [
        float(np.log1p(n)), chars / m, symbols / m, dup / max(1, len(lines)), repeat / m, len(_UPPER.findall(text)) / c, len(_DIGIT.findall(text)) / c,
        len(_MARK.findall(text)) / m, len(known) / m, chars / max(1, len(lines)), top / m,
    ]
    return (n, chars, symbols, dup, repeat), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    """The plain rules: too short, or more than half of the words in repeated windows."""
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass(frozen=True)
class Trees:
    """Flattened trees: arrays over all nodes. A leaf points to itself and holds a value."""

    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values for the rows of x."""
        out = np.full(len(x), self.bias)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            rows, node = np.arange(len(part))[:, None], np.broadcast_to(self.root, (len(part), len(self.root)))
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 10) -> Trees:
    """Newton boosting of the logistic loss on histograms.

    A split on a feature of sign s must order its children's values by s, and passes the middle
    between them down as a bound that no value below may cross; so the whole ensemble moves with
    the feature in that direction only. Without rows or with one class, the bias is all.
    """
    n, width = x.shape
    rate_of = (y.sum() + 1) / (len(y) + 2)
    nodes: list[list[float]] = []
    roots: list[int] = []
    bias = float(np.log(rate_of / (1 - rate_of)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    code = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1) if n else np.zeros((0, width), int)
    margin = np.full(n, bias)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float, deep: int) -> int:
        at, own = len(nodes), float(np.clip(-g[rows].sum() / (h[rows].sum() + ridge), low, high))
        nodes.append([0, 0.0, at, at, own * rate])
        best = (1e-6, -1, 0, 0.0, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for j in range(width if deep else 0):
            size = len(cuts[j]) + 1
            c = code[rows, j]
            sg, sh, sn = (np.cumsum(np.bincount(c, w, size))[:-1] for w in (g[rows], h[rows], None))
            if not len(sg):
                continue
            a, b = np.clip(-sg / (sh + ridge), low, high), np.clip(-(total_g - sg) / (total_h - sh + ridge), low, high)
            worth = lambda w, gg, hh: -(2 * gg * w + (hh + ridge) * w * w)
            gain = worth(a, sg, sh) + worth(b, total_g - sg, total_h - sh) - worth(own, total_g, total_h)
            gain[(sn < least) | (len(rows) - sn < least) | ((b - a) * signs[j] < 0)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k, float(a[k]), float(b[k]))
        _, j, k, a, b = best
        if j >= 0:
            go, middle = code[rows, j] <= k, (a + b) / 2
            bound = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[signs[j]]
            left = grow(rows[go], g, h, *bound[0], deep - 1)
            right = grow(rows[~go], g, h, *bound[1], deep - 1)
            nodes[at] = [j, float(cuts[j][k]), left, right, 0.0]
        return at

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(n), p - y, p * (1 - p), -np.inf, np.inf, depth))
        flat = _flat(nodes, roots[-1:], 0.0, depth)
        margin += flat.margin(x)
    return _flat(nodes, roots, bias, depth)


def _flat(nodes: list[list[float]], roots: list[int], bias: float, depth: int) -> Trees:
    a = np.array(nodes or [[0, 0.0, 0, 0, 0.0]], float)
    return Trees(np.array(roots, int), a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4], bias, depth)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees that tell labels.quality from the features of at most `sample` labelled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(x.as_py())[1] for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.list_(pa.float64()))], names=["id", "label", "x"])

    chosen = labelled_sample(docs, labels, "quality", sample)
    rows = sorted(tuple(r) for r in chosen.select(F.col("doc_id").cast("string"), "label", "text").mapInArrow(run, "id string, label int, x array<double>").collect())
    x = np.array([r[2] for r in rows], float).reshape(len(rows), len(FEATURES))
    return train(x, np.array([r[1] for r in rows], float), list(FEATURES.values()))


def judged(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept) for each row.

    kept is false where the plain rules fail, else whether quality, the trees' probability,
    reaches `keep`. A null text counts as empty and so fails. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, verdict = _verdicts(batch.column(1), model, keep)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, k]) for k in range(5)), *map(pa.array, verdict)], names=["id", *names, "base_failed", "quality", "kept"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    return own.mapInArrow(run, f"id {kind}, {', '.join(f'{x} bigint' for x in names)}, base_failed boolean, quality double, kept boolean")


def _verdicts(texts: pa.Array, model: Trees, keep: float) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    got = [statistics(x.as_py()) for x in texts]
    counts = np.array([c for c, _ in got], np.int64).reshape(-1, 5)
    quality = model.probability(np.array([f for _, f in got], float).reshape(-1, len(FEATURES)))
    failed = np.array([base_failed(int(c[0]), int(c[4])) for c in counts], bool)
    return counts, (failed, quality, ~failed & (quality >= keep))


def keep_good(docs: DataFrame, model: Trees, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """The rows of docs, whole and with all columns, that judged() keeps."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_verdicts(batch.column(place), model, keep)[1][2]))
        tidy()

    return docs.mapInArrow(run, docs.schema)
