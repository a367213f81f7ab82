"""SentencePiece encoding and decoding, in parallel inside of giant documents too.

A segmentation is a path through a lattice whose edges are pieces. In the max-plus semiring an
edge of a unigram model weighs its score. In a BPE model it weighs 0 if the piece may follow the
one before, and minus infinity if not: a sequence of pieces is what the merges make of a text if
and only if each two neighbours are what the merges make of the two alone, because the first
merge across a border would also happen between these two. So the one path of weight 0 is the
model's own encoding.

A text longer than a chunk is cut anywhere. The state at a cut is the piece that ends at it or
lies across it, and how far it reaches into the next chunk. Each chunk gives a matrix of the best
weights from each state at its begin to each at its end. Products of matrices associate: a task
multiplies a few neighbours, another the products of these, until one matrix stands for the text.
Its best end goes back down the same way: a task that knows the states at both ends of its
neighbours finds those between. Then each chunk is traced back for itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lariat.llm.common import cut, text_key, tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters to a chunk.
CHUNK = 1 << 15
#: Matrices that one task multiplies.
FAN = 16
#: A worker forgets its words, and which pairs of pieces may follow each other, when it knows so many.
KNOWN, PAIRS = 150_000, 250_000
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 21

SPACE = "▁"
_UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_BORDER = re.compile(f"(?<=[^{SPACE}]){SPACE}")
_KNOWN: dict[bytes, Model] = {}
State = tuple[int, str]
Matrix = dict[State, dict[State, float]]


class _Memo(dict):
    def __init__(self, make, most: int = KNOWN):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class _Table:
    """Numbers from 0 on and a value of each, looked up many at once: open addressing, at most half full."""

    def __init__(self, most: int):
        self.bits = max(4, (2 * most).bit_length())
        self.clear()

    def clear(self) -> None:
        self.keys, self.values, self.size = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 for numbers that are not there."""
        out, at, left = np.full(len(keys), -1, np.int64), self._home(keys), np.arange(len(keys))
        while len(left):
            seen = self.keys[at]
            hit = seen == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (seen >= 0)
            left, at = left[on], (at[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different numbers that are not there yet."""
        self.size += len(keys)
        at = self._home(keys)
        while len(keys):
            first = np.zeros(len(keys), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.keys[at] < 0
            self.keys[at[first]], self.values[at[first]] = keys[first], values[first]
            keys, values, at = keys[~first], values[~first], (at[~first] + 1) & (len(self.keys) - 1)


class _Paths:
    """The only paths of many short units of a BPE model at once.

    Sorted units share their begins, and the last piece of a begin does not depend on what
    follows; so each different begin is looked at once. It is the piece that ends there and may
    follow the last piece of the begin before it. Pieces that end at a place are read backwards in
    a trie, and what is known of pairs is kept.
    """

    #: Units of more characters are left to the search of single ones.
    WIDEST = 48

    def __init__(self, model: Model):
        self.model, self.pieces = model, [p for p, whole in model._table.items() if whole]
        self.ids, self.sizes = np.array([model.ids[p] for p in self.pieces], "<i4"), np.array([*map(len, self.pieces)], np.int64)
        chars = {c: k for k, c in enumerate(sorted({c for p in self.pieces for c in p}), 1)}
        self.kinds, self.code = len(chars) + 1, np.zeros(0x110000, np.int32)
        for c, k in chars.items():
            self.code[ord(c)] = k if c in model.ids else 0  # what can't stand alone is no case for this
        steps: dict[int, int] = {}
        ends, nodes = {}, 1
        for k, p in enumerate(self.pieces):
            node = 0
            for c in reversed(p):
                key = node * self.kinds + chars[c]
                if key not in steps:
                    steps[key] = nodes
                    nodes += 1
                node = steps[key]
            ends[node] = k
        self.steps = _Table(len(steps))
        self.steps.add(np.array([*steps], np.int64), np.array([*steps.values()], np.int64))
        self.ends = np.full(nodes, -1, np.int64)
        self.ends[[*ends]] = [*ends.values()]
        self.known = _Table(PAIRS)
        self.halves, self.falls = self._merges()
        self.spines = (_Memo(lambda k: self._spine(k, 1), 5000), _Memo(lambda k: self._spine(k, 0), 5000))

    def _merges(self) -> tuple[dict[str, tuple[str, str]], list[bool]]:
        """The two parts that each piece is merged from, and for each whether merges on the way to it come in the order of scores.

        They do if scores fall from a part to what it is merged into, and are a merge's own; else
        only their course tells which happen.
        """
        scores, halves, own = self.model.scores, {}, []
        often = {x for x, n in Counter(scores.values()).items() if n > 1}
        for p in self.pieces:
            parts, falls = [*p], True
            while len(parts) > 1:
                score, k = max((scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores)
                a, b = parts[-k], parts[1 - k]
                falls = falls and score not in often and all(len(x) == 1 or scores[x] > score for x in (a, b))
                halves[a + b] = (a, b)
                parts[-k : 2 - k] = [a + b]
            own.append(falls)
        return halves, own

    def _spine(self, piece: int, side: int) -> list[tuple[str, float]]:
        """The parts of a piece that meet a border at its end (side 1) or begin (0) while it is merged, from the character to the piece, each with the score of the merge that takes it up."""
        x, taken, spine = self.pieces[piece], -np.inf, []
        while len(x) > 1:
            spine.append((x, taken))
            taken, x = self.model.scores[x], self.halves[x][side]
        return [(x, taken), *reversed(spine)]

    def _may(self, a: int, b: int) -> bool:
        """Whether no merge crosses the border between two pieces: the parts on both sides grow in the order of scores."""
        if not (self.falls[a] and self.falls[b]):
            return self.model._merged(self.pieces[a] + self.pieces[b]) == [self.pieces[a], self.pieces[b]]
        left, right, scores = self.spines[0][a], self.spines[1][b], self.model.scores
        i = j = 0
        while True:
            (x, taken), (y, gone) = left[i], right[j]
            cross = scores.get(x + y)
            if cross is not None and cross > taken and cross >= gone:  # of equal merges the leftmost comes first
                return False
            if taken == gone == -np.inf:  # both are whole
                return True
            if taken >= gone:
                i += 1
            else:
                j += 1

    def follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the one before it."""
        keys = before * len(self.pieces) + piece
        may = self.known.get(keys)
        if len(fresh := np.unique(keys[may < 0])):
            if self.known.size + len(fresh) > PAIRS:
                self.known.clear()
                fresh = np.unique(keys)
            told = np.array([self._may(*divmod(k, len(self.pieces))) for k in fresh.tolist()], np.int64)
            if len(fresh) <= PAIRS:
                self.known.add(fresh, told)
            may = np.where(may < 0, told[np.minimum(np.searchsorted(fresh, keys), len(fresh) - 1)], may)
        return may > 0

    def __call__(self, units: list[str], lead: str = "") -> tuple[list[str], list[bytes], list[str]]:
        """Units, the ids of lead and each of them, as 32-bit numbers, and the units that have a character that is no piece."""
        if not units:
            return [], [], []
        units = sorted(units)
        size = np.fromiter(map(len, units), np.int64, len(units))
        codes = self.code[np.array(units, f"U{size.max()}").view("<u4").reshape(len(units), -1)]
        inside = np.arange(codes.shape[1]) < size[:, None]
        if not (good := ~((codes == 0) & inside).any(1)).all():
            rest = [u for u, x in zip(units, good.tolist(), strict=True) if not x]
            return *self([u for u, x in zip(units, good.tolist(), strict=True) if x], lead)[:2], rest
        codes = np.where(inside, codes, 0)
        codes = np.concatenate([np.broadcast_to(self.code[[ord(c) for c in lead]].reshape(1, -1), (len(units), len(lead))), codes], 1)
        size, width = size + len(lead), codes.shape[1]
        common = np.concatenate([np.zeros(min(1, len(units)), int), np.cumprod(codes[1:] == codes[:-1], 1).sum(1)])
        last = np.full((len(units), width + 1), -1, np.int64)
        for end in range(1, width + 1):
            live = size >= end
            fresh = live & (common < end)
            rows = np.flatnonzero(fresh)
            found, at, node = np.full(len(rows), -1), np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for k in range(1, end + 1):
                node = self.steps.get(node * self.kinds + codes[rows[at], end - k])
                at, node = at[node >= 0], node[node >= 0]
                if not len(at):
                    break
                piece = self.ends[node]
                fits = piece >= 0
                if k < end:
                    fits[fits] = self.follow(last[rows[at[fits]], end - k], piece[fits])
                found[at[fits]] = piece[fits]
                at, node = at[~fits], node[~fits]
            last[live, end] = found[np.cumsum(fresh)[live] - 1]
        out, fill, left = np.zeros((len(units), width), "<i4"), np.full(len(units), width), size.copy()
        rows = np.arange(len(units))
        while len(rows):
            piece = last[rows, left[rows]]
            fill[rows] -= 1
            out[rows, fill[rows]] = self.ids[piece]
            left[rows] -= self.sizes[piece]
            rows = rows[left[rows] > 0]
        data, ends = out.tobytes(), 4 * width * np.arange(1, len(units) + 1)
        begins = ends - 4 * (width - fill)
        return units, [data[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], []


class Model:
    """A model file's pieces. Texts are not normalised but for the space mark that the file asks for."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(data)
        norm, own = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or own.treat_whitespace_as_suffix or own.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models without normalisation of their own are known")
        self.data, self.prefix, self.merges = data, SPACE * norm.add_dummy_prefix, own.model_type == 2
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.scores = {p.piece: float(p.score) for p in proto.pieces if p.type in (1, 4)}
        if any(SPACE in p.strip(SPACE) or p != p.rstrip(SPACE) and p.strip(SPACE) for p in self.ids):
            raise ValueError("pieces with a space mark after other characters are not known")
        self.longest = max(map(len, self.ids), default=1)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.penalty = min(self.scores.values(), default=0.0) - 10
        raw = {i: p.piece.encode() for p, i in zip(proto.pieces, range(len(proto.pieces)), strict=True) if p.type in (1, 4)}
        self.raw = [raw.get(i, b"") for i in range(len(proto.pieces))]
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        self._pairs, self._own = _Memo(lambda ab: self._merged(ab[0] + ab[1]) == [*ab]), _Memo(lambda p: self._merged(p) == [p])
        self._table = dict.fromkeys((p[:k] for p in self.ids for k in range(1, len(p))), False)
        self._table |= {p: len(p) == 1 or not self.merges or self._own[p] for p in self.ids}
        proper = {p[:k] for p in self.ids for k in range(1, len(p))}
        self._begins = _Memo(lambda g: (tuple(g[:k] for k in range(1, len(g) + 1) if k == 1 or self._table.get(g[:k])), len(g) == 4 and g in proper))
        self._bytes = _Memo(lambda p: np.array(self.piece_ids(p), "<i4").tobytes())
        self._inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._units, self._words = _Memo(self._encode_unit), _Memo(self._word)
        self._plain = bool(self.prefix) and not any("\n" in p for p in self.ids)
        self._newline = self._packed(["\n"])
        self._paths: _Paths | None = None
        self._size = np.array([*map(len, self.raw)])
        self._at, self._blob = np.cumsum(self._size) - self._size, np.frombuffer(b"".join(self.raw), np.uint8)

    @classmethod
    def known(cls, data: bytes) -> Model:
        """The worker's own copy, which keeps what it has learnt from one task to the next."""
        if data not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[data] = cls(data)
        return _KNOWN[data]

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def _cut(self, marked: str) -> list[str] | None:
        """The words of a text that begins with a space mark and has no more of them than one between words; else None."""
        if not self._plain or marked[:1] != SPACE or marked[-1] == SPACE or SPACE + SPACE in marked or SPACE + "\n" in marked:
            return None
        return marked[1:].replace("\n", SPACE + "\n").split(SPACE)

    def forget(self) -> None:
        """Drops the words of a task, so that waiting workers stay small."""
        self._words.clear()
        self._units.clear()
        tidy()

    def learn(self, texts: list[list[str] | None]) -> None:
        """Looks up the words of texts that are cut up, as _cut() does, all at once; results do not depend on it."""
        if not self.merges or not self._plain:
            return
        words = set().union(*filter(None, texts)).difference(self._words)
        if len(words) + len(self._words) > KNOWN:
            self._words.clear()
            words = set().union(*filter(None, texts))
        if self._paths is None:
            self._paths = _Paths(self)
        spaced = [w for w in words if w and w[0] != "\n" and len(w) < _Paths.WIDEST]
        for at in range(0, len(spaced), 1 << 13):
            self._words.update(zip(*self._paths(spaced[at : at + (1 << 13)], SPACE)[:2], strict=True))
        lines = [w[1:] for w in words if 1 < len(w) <= _Paths.WIDEST and w[0] == "\n" and "\n" not in w[1:]]
        units, ids, _ = self._paths(lines)
        self._words.update(zip(map("\n".__add__, units), map(self._newline.__add__, ids), strict=True))

    def _merged(self, text: str) -> list[str]:
        """What the merges make of a short text: always the pair of the best score, of equals the leftmost."""
        out = list(text)
        while True:
            best = max(((self.scores[a + b], -k) for k, (a, b) in enumerate(zip(out, out[1:], strict=False)) if a + b in self.scores), default=None)
            if best is None:
                return out
            out[-best[1] : 2 - best[1]] = ["".join(out[-best[1] : 2 - best[1]])]

    def pieces(self, text: str, at: int) -> Iterator[str]:
        """The pieces that can begin there. A character that is in no piece stands alone."""
        some = False
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            p = text[at:end]
            if p in self.ids and (len(p) == 1 or not self.merges or self._own[p]):
                some = some or len(p) == 1
                yield p
        if not some:
            yield text[at]

    def weight(self, before: str, piece: str) -> float | None:
        """Of the edge; None: minus infinity."""
        if not self.merges:
            return self.scores.get(piece, self.penalty)
        return 0.0 if not before or self._pairs[before, piece] else None

    def piece_ids(self, piece: str) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def spread(self, text: str, seeds: dict[int, dict[str, dict]], stop: int) -> dict[int, dict[str, dict]]:
        """Best weights of the paths from the seeds: place, last piece, seed's name -> (weight, place and piece before).

        Pieces begin before `stop` only and may reach beyond. Of equal paths the one with the
        longer last piece stays. After a unigram model's piece only the place matters.
        """
        table = {p: {k: dict(v) for k, v in x.items()} for p, x in seeds.items()}
        for at in range(min(table, default=stop), stop):
            if at not in table:
                continue
            for piece in self.pieces(text, at):
                last = piece
                for before, seen in table[at].items():
                    if (w := self.weight(before, piece)) is None:
                        continue
                    cell = table.setdefault(at + len(piece), {}).setdefault(last, {})
                    for name, (total, _) in seen.items():
                        if name not in cell or cell[name][0] < total + w:
                            cell[name] = (total + w, (at, before))
        return table

    @staticmethod
    def trace(table: dict, place: int, piece: str, name: object) -> list[str]:
        """The pieces from the seed of that name to a place."""
        out = []
        while (back := table[place][piece][name][1]) is not None:
            out.append(piece)
            place, piece = back
        return out[::-1]

    @staticmethod
    def best(table: dict, place: int, name: object) -> str:
        """The last piece of the best path to a place; of equals the longest."""
        return max((x for x in table[place].items() if name in x[1]), key=lambda x: (x[1][name][0], len(x[0])))[0]

    def _encode_unit(self, unit: str) -> bytes:
        if self.merges:
            return self._packed(self._only_path(unit))
        table = self.spread(unit, {0: {"": {0: (0.0, None)}}}, len(unit))
        return self._packed(self.trace(table, len(unit), self.best(table, len(unit), 0), 0))

    def _only_path(self, unit: str) -> list[str]:
        """The path of weight 0 in a BPE model's lattice.

        Each begin of a unit has one encoding, so one last piece: the first found that may follow
        the last piece before it. The pieces of up to 4 characters that can begin at a place are
        known from the 4 characters there.
        """
        if self._table.get(unit):
            return [unit]
        begins, table, pairs, size = self._begins, self._table, self._pairs, len(unit)
        last: list[str | None] = [""] + [None] * size
        for at in range(size):
            before = last[at]
            pieces, more = begins[unit[at : at + 4]]
            if more:
                pieces = list(pieces)
                for end in range(at + 5, size + 1):
                    if (whole := table.get(unit[at:end])) is None:
                        break
                    if whole:
                        pieces.append(unit[at:end])
            for piece in pieces:
                end = at + len(piece)
                if last[end] is None and (not at or pairs[before, piece]):
                    last[end] = piece
        out, end = [], size
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def _packed(self, pieces: list[str]) -> bytes:
        return b"".join(map(self._bytes.__getitem__, pieces))

    def _word(self, word: str) -> bytes:
        """The ids of what stands between two spaces, or of a line end and what follows it up to one."""
        if word[:1] == "\n":
            return self._newline + (self._split(word[1:]) if word[1:] else b"")
        return self._split(SPACE + word)

    def _split(self, unit: str) -> bytes:
        """The ids of a unit, cut where two characters meet that do so in no piece; no piece reaches across."""
        inside, at, out = self._inside, 0, []
        for k in range(1, len(unit)):
            if unit[k - 1 : k + 1] not in inside:
                out.append(self._part(unit[at:k]))
                at = k
        return b"".join([*out, self._part(unit[at:])]) if at else self._encode_unit(unit)

    def _part(self, part: str) -> bytes:
        return self._words[part[1:]] if part[0] == SPACE else self._units[part]

    def units(self, marked: str) -> bytes:
        """The ids of a text that begins and ends where units do, as 32-bit numbers."""
        if (words := self._cut(marked)) is not None:
            return b"".join(map(self._words.__getitem__, words))
        return b"".join(map(self._split, _UNIT.findall(marked)))

    def marked(self, text: str) -> str:
        return self.prefix + text.replace(" ", SPACE) if text else ""

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for an empty one."""
        return np.frombuffer(self.units(self.marked(text)), "<i4") if text else np.zeros(0, "<i4")

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """encode() of each, their words looked up together."""
        marked = [self.marked(t) for t in texts]
        words = [self._cut(t) for t in marked]
        self.learn(words)
        for t, w in zip(marked, words, strict=True):
            yield np.frombuffer(self.units(t) if w is None else b"".join(map(self._words.__getitem__, w)), "<i4")

    def spelt(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        size = self._size[ids]
        ends = np.cumsum(size)
        return self._blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self._at[ids] - ends + size, size)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, space marks turned back, the first one dropped if the model adds it."""
        text = self.spelt(np.asarray(ids, np.int64)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text[:1] == " " else text

    def entries(self, before: str, text: str) -> list[State]:
        """All states that a cut between the two can have; an empty `before` is the begin of the text."""
        if not before:
            return [(0, "")]
        out = set()
        for k in range(1, min(len(before), self.longest) + 1):
            for piece in self.pieces(before[len(before) - k :] + text[: self.longest], 0):
                if len(piece) >= k:
                    out.add((len(piece) - k, piece))
        return sorted(out)

    def _seeds(self, begin: list[State]) -> dict[int, dict[str, dict]]:
        seeds: dict[int, dict[str, dict]] = {}
        for state in begin:
            seeds.setdefault(state[0], {}).setdefault(state[1], {})[state] = (0.0, None)
        return seeds

    def _borders(self, text: str, size: int) -> tuple[int, int] | None:
        """The first and the last place in a chunk at which a unit begins, beyond what a piece from before can reach."""
        first = _BORDER.search(text, 1, size)
        if first is None:
            return None
        last = size - 1
        while text[last] != SPACE or text[last - 1] == SPACE:
            last -= 1
        return first.start(), last

    def matrix(self, before: str, text: str, after: str) -> Matrix:
        """Best weights from the states at a chunk's begin to those at its end.

        Units do not depend on each other; so where a chunk has a border of units, only what lies
        before its first and after its last one differs from path to path, and the weight of the
        units between, the same for all, is left out.
        """
        whole, size = text + after, len(text)
        begin, inner = self.entries(before, whole), self._borders(text, size)
        if inner is None:
            return self._ends(self.spread(whole, self._seeds(begin), size), size, begin)
        head, tail = self.spread(whole, self._seeds(begin), inner[0]), self.spread(whole, {inner[1]: {"": {0: (0.0, None)}}}, size)
        last = self._ends(tail, size, [0])[0]
        out: Matrix = {}
        for state in begin:
            if got := [seen[state][0] for seen in head.get(inner[0], {}).values() if state in seen]:
                out[state] = {end: max(got) + w for end, w in last.items()}
        return out

    @staticmethod
    def _ends(table: dict, size: int, names: list) -> dict:
        out: dict = {name: {} for name in names}
        for place, pieces in table.items():
            for piece, seen in pieces.items() if place >= size else ():
                for name, (w, _) in seen.items():
                    out[name][place - size, piece] = w
        return out

    def chunk(self, text: str, after: str, begin: State, end: State) -> np.ndarray:
        """The ids of the pieces that begin in a chunk, given the states at its cuts."""
        whole, size = text + after, len(text)
        inner = self._borders(text, size)
        if inner is None:
            table = self.spread(whole, self._seeds([begin]), size)
            return np.frombuffer(self._packed(self.trace(table, size + end[0], end[1], begin)), "<i4")
        head = self.spread(whole, self._seeds([begin]), inner[0])
        tail = self.spread(whole, {inner[1]: {"": {0: (0.0, None)}}}, size)
        first = self.trace(head, inner[0], self.best(head, inner[0], begin), begin)
        last = self.trace(tail, size + end[0], end[1], 0)
        return np.frombuffer(self._packed(first) + self.units(whole[inner[0] : inner[1]]) + self._packed(last), "<i4")


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for i, row in a.items():
        for k, w in row.items():
            for j, v in b.get(k, {}).items():
                own = out.setdefault(i, {})
                if j not in own or own[j] < w + v:
                    own[j] = w + v
    return out


def last_state(m: Matrix) -> State:
    """Where the best path of a whole text ends; no piece may reach on. Of equal paths the longest last piece."""
    return max((w, len(p), (o, p)) for (o, p), w in m[0, ""].items() if not o)[2]


def cuts(matrices: list[Matrix], begin: State = (0, ""), end: State | None = None) -> list[State]:
    """The states of the best path from one state to another, at these and at each cut between the matrices.

    Without `end` it is that of a whole text. Products from the end say how well each state can
    lead there; then each cut takes the state that the one before makes best.
    """
    end = last_state(reduce(product, matrices)) if end is None else end
    ends: list[dict[State, float]] = [{end: 0.0}]
    for m in reversed(matrices):
        after: dict[State, float] = {}
        for state, row in m.items():
            if got := [w + ends[-1][k] for k, w in row.items() if k in ends[-1]]:
                after[state] = max(got)
        ends.append(after)
    ends.reverse()
    out: list[State] = [begin]
    for m, onward in zip(matrices, ends[1:], strict=True):
        out.append(max(((w + onward[k], len(k[1]), k) for k, w in m[out[-1]].items() if k in onward))[2])
    return out


def cuts_in_levels(matrices: list[Matrix], fan: int = FAN) -> list[State]:
    """cuts() of a whole text as tasks find them that hold `fan` matrices each."""
    levels = [matrices]
    while len(levels[-1]) > 1:
        levels.append([reduce(product, levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    states = [(0, ""), last_state(levels[-1][0])]
    for level in reversed(levels[:-1]):
        inner = [cuts(level[fan * i : fan * (i + 1)], a, b) for i, (a, b) in enumerate(zip(states, states[1:], strict=False))]
        states = [states[0], *(x for part in inner for x in part[1:])]
    return states


def encode_in_chunks(model: Model, text: str, size: int) -> np.ndarray:
    """encode() by way of chunks, on one machine."""
    marked = model.marked(text)
    if not marked:
        return np.zeros(0, "<i4")
    parts = _parts(marked, model.longest, size)
    states = cuts_in_levels([model.matrix(*p) for p in parts])
    return np.concatenate([model.chunk(t, after, a, b) for (_, t, after), a, b in zip(parts, states, states[1:], strict=False)])


def _parts(marked: str, longest: int, size: int) -> list[tuple[str, str, str]]:
    """(characters before, chunk, characters after); a short rest belongs to the chunk before it."""
    size = max(size, longest + 1)
    starts = list(range(0, max(1, len(marked) - longest), size))
    return [(marked[max(0, a - longest) : a], marked[a:b], marked[b : b + longest]) for a, b in zip(starts, [*starts[1:], len(marked)], strict=True)]


def _flat(m: Matrix) -> list[tuple[int, str, int, str, float]]:
    return [(a[0], a[1], b[0], b[1], w) for a, row in m.items() for b, w in row.items()]


def _matrix(rows: list) -> Matrix:
    out: Matrix = {}
    for r in rows:
        a, x, b, y, w = (r[k] for k in ("a", "x", "b", "y", "w"))
        out.setdefault((a, x), {})[b, y] = w
    return out


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Begin and end of rows in order that have at most TOGETHER characters together, or are one row."""
    a, total = 0, 0
    for k, size in enumerate(sizes):
        if k > a and total + size > TOGETHER:
            yield a, k
            a, total = k, 0
        total += size
    if a < len(sizes):
        yield a, len(sizes)


_STATES = "a int, x string, b int, y string"
_MATRIX = "m array<struct<a: int, x: string, b: int, y: string, w: double>>"


def _rows(m: Matrix) -> list[dict]:
    return [dict(zip("axbyw", r, strict=True)) for r in _flat(m)]


def _chosen(known: DataFrame, most: int, fan: int) -> DataFrame:
    """(g, no, a, x, b, y): the states at both ends of each chunk of each text.

    known: (g, no, m) the chunks' matrices, no from 0 to `most` at the most.
    """

    def combine(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame({"g": x["g"], "no": x["up"], "m": [_rows(reduce(product, [_matrix(m["m"]) for m in ms])) for ms in x["ms"]]})

    def ends(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            got = [last_state(reduce(product, [_matrix(m["m"]) for m in ms])) for ms in x["ms"]]
            yield pd.DataFrame({"g": x["g"], "no": x["up"], "a": 0, "x": "", "b": [s[0] for s in got], "y": [s[1] for s in got]})

    def between(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            out = []
            for r in x.itertuples():
                states = cuts([_matrix(m["m"]) for m in r.ms], (int(r.a), r.x), (int(r.b), r.y))
                out += [(r.g, m["no"], *s, *t) for m, s, t in zip(r.ms, states, states[1:], strict=False)]
            yield pd.DataFrame(out, columns=["g", "no", "a", "x", "b", "y"])

    levels, level = [], known
    while True:
        levels.append(cut(level.groupBy("g", F.floor(F.col("no") / fan).cast("int").alias("up")).agg(F.sort_array(F.collect_list(F.struct("no", "m"))).alias("ms"))))
        most //= fan
        if not most:
            break
        level = levels[-1].mapInPandas(combine, f"g bigint, no int, {_MATRIX}")
    states = levels[-1].mapInPandas(ends, f"g bigint, no int, {_STATES}")
    for own in reversed(levels):
        above = states.withColumnRenamed("no", "up")
        states = cut(own.join(above, ["g", "up"]).mapInPandas(between, f"g bigint, no int, {_STATES}"))
    return states


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(id, ids, n_tokens, round_trip) for each row, of whole texts.

    round_trip: whether decode() gives the text again; it does unless the text has the space mark
    itself, or characters that a model without byte pieces lacks. Null and empty texts have no
    ids. Null ids and repeated rows stay; no rows give no rows; further columns are ignored. Texts
    of up to `chunk` characters are encoded where they are read; only the chunks of longer ones are
    shuffled, and no task holds more of such a text than a chunk, or `fan` matrices, until its ids
    are put together, which one row of the result has to hold. Of equal paths of a unigram model
    the one with the longer last piece stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(model.data)  # a model file has a fixed size
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shape = f"id {kind}, ids array<int>, n_tokens bigint, round_trip boolean"

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.known(held.value)
        for batch in batches:
            for a, b in _slices(pc.utf8_length(batch.column(1)).to_pylist()):
                got, back, texts = [], [], batch.column(1).slice(a, b - a).to_pylist()
                for text, ids in zip(texts, model.encode_all(texts), strict=True):
                    got.append(ids)
                    back.append(model.decode(ids) == text)
                sizes = np.array([0, *map(len, got)])
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(got)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), ids, pa.array(sizes[1:], pa.int64()), pa.array(back, pa.bool_())], names=["id", "ids", "n_tokens", "round_trip"])
        model.forget()

    def matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.known(held.value)
        for x in parts:
            yield x[["g", "no"]].assign(m=[_rows(model.matrix(*row)) for row in zip(x["before"], x["part"], x["after"], strict=True)])

    def trace(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Model.known(held.value)
        for whole in parts:
            for a, b in _slices([*map(len, whole["part"])]):
                x = whole.iloc[a:b]
                model.learn([model._cut(f"{SPACE}{part.strip(SPACE)}") for part in x["part"]])
                got = [model.chunk(r.part, r.after, (int(r.a), r.x), (int(r.b), r.y)) for r in x.itertuples()]
                yield x[["g", "no"]].assign(ids=got, raw=[model.spelt(g) for g in got])
        model.forget()

    long = F.length("text") > chunk
    out = own.where(~long).mapInArrow(plain, shape)
    giant = cut(own.where(long).withColumn("tk", text_key()))
    if giant.isEmpty():
        return out
    size, reach = max(chunk, model.longest + 1), model.longest
    marked = F.concat(F.lit(model.prefix), F.translate("text", " ", SPACE))
    rows = giant.dropDuplicates(["id", "tk"]).select("id", "tk", F.monotonically_increasing_id().alias("g"), marked.alias("t"), F.length(marked).alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("n") - reach - 1), F.lit(size))
    rows = rows.select("id", "tk", "g", "t", "n", F.posexplode(starts).alias("no", "at"), F.element_at(starts, -1).alias("last"))
    end = F.when(F.col("at") == F.col("last"), F.col("n")).otherwise(F.col("at") + size)
    back = F.least(F.col("at"), F.lit(reach))
    rows = rows.select(
        "id", "tk", "g", "no", F.col("t").substr(F.col("at") - back + 1, back).alias("before"),
        F.col("t").substr(F.col("at") + 1, end - F.col("at")).alias("part"), F.col("t").substr(end + 1, F.lit(reach)).alias("after"),
    )
    rows = cut(rows.repartition("g", "no"))
    known = rows.select("g", "no", "before", "part", "after").mapInPandas(matrices, f"g bigint, no int, {_MATRIX}")
    chosen = _chosen(known, rows.agg(F.max("no")).first()[0], fan)
    traced = rows.select("g", "no", "part", "after").join(chosen, ["g", "no"]).mapInPandas(trace, "g bigint, no int, ids array<int>, raw binary")
    whole = traced.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("no", "ids", "raw"))).alias("parts"))
    latin = F.array_join(F.transform("parts", lambda p: F.decode(p["raw"], "ISO-8859-1")), "")  # bytes as characters, to compare
    whole = whole.select("g", F.flatten(F.col("parts.ids")).alias("ids"), latin.alias("raw")).join(rows.where("no = 0").select("g", "id", "tk"), "g")
    expected = F.decode(F.encode(marked, "UTF-8"), "ISO-8859-1")
    match = F.col("g.id").eqNullSafe(F.col("w.id")) & (F.col("g.tk") == F.col("w.tk"))
    own_mark = F.contains("text", F.lit(SPACE))
    more = giant.alias("g").join(whole.alias("w"), match).select(F.col("g.id").alias("id"), "w.ids", F.size("w.ids").cast("bigint").alias("n_tokens"), ((expected == F.col("w.raw")) & ~own_mark).alias("round_trip"))
    return out.unionByName(more)


def decode(tokens: DataFrame, model: Model, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text) for each row: the text of its ids.

    Ids that are null, or not of the model, stand for nothing; null or empty lists are empty texts.
    Null row ids and repeated rows stay; no rows give no rows; further columns are ignored.
    """
    held = tokens.sparkSession.sparkContext.broadcast(model.data)
    kind = tokens.schema[id_col].dataType.simpleString()
    pieces = len(model.raw)
    good = F.filter(F.coalesce(F.col(ids_col), F.array().cast("array<int>")), lambda i: i.isNotNull() & (i >= 0) & (i < pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.known(held.value)
        for batch in batches:
            texts = [model.decode(np.asarray(x.values, np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), good.alias("ids")).mapInArrow(run, f"id {kind}, text string")
