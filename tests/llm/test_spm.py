from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from lariat.llm import spm

with open(spm.MODEL, "rb") as f:
    BPE = f.read()


def unigram():
    proto = pb.ModelProto()
    proto.ParseFromString(BPE)
    proto.trainer_spec.model_type = 1
    rnd = random.Random(1)
    for p in proto.pieces:
        if p.type == 1:
            p.score = -len(p.piece) ** 0.5 - rnd.random() * 3
    return proto.SerializeToString()


UNI = unigram()


def same(model, a, b):
    """BPE has one answer; two best paths of a unigram model may differ in the order of their pieces."""
    if model.merges or a == b:
        return a == b
    by = {i: model.scores[p] for p, i in model.ids.items()}
    return abs(sum(by.get(i, 0) for i in a) - sum(by.get(i, 0) for i in b)) < 1e-3 and sum(i not in by for i in a) == sum(i not in by for i in b)


TEXTS = [
    "", " ", "  ", "a", "Hello world", " lead", "trail ", "two  spaces   and    more", "line\nbreak\n\nend\n", "tab\tand\rcr", "日本語のテキスト 漢字𐍈", "naïve café – “quotes”…",
    "x" * 300, "ab" * 100, "the cat sat on the mat " * 30, "a▁b", "é  nb", "\x00\x01", "internationalization antidisestablishmentarianism", " \n ", "▁",
]


def random_text(rnd, n):
    return "".join(rnd.choice(["the", "ing", " ", " ", "  ", "é", "漢", "\n", "zq", "er", "Z", "0", "...", "aa", "𐍈", "tion"]) for _ in range(n))


@pytest.mark.parametrize("data", [BPE, UNI])
def test_library_agrees(data):
    own, library = spm.Model(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    rnd = random.Random(2)
    for text in [*TEXTS, *(random_text(rnd, rnd.randrange(80)) for _ in range(300))]:
        ids = own.encode(text)
        assert same(own, ids.tolist(), library.encode(text)), text
        assert own.decode(ids) == text or spm.SPACE in text


@pytest.mark.parametrize("data", [BPE, UNI])
@pytest.mark.parametrize("size", [1, 18, 25, 64])
def test_chunks_change_nothing(data, size):
    model, rnd = spm.Model(data), random.Random(3)
    for text in [*TEXTS, *(random_text(rnd, rnd.randrange(150)) for _ in range(40))]:
        assert same(model, spm.encode_in_chunks(model, text, size).tolist(), model.encode(text).tolist()), text


def test_products_associate():
    model = spm.Model(BPE)
    parts = spm._parts(model.marked("unbelievableness " * 3 + "abcdefghij" * 12), model.longest, 20)
    m = [model.matrix(*p) for p in parts]
    assert len(m) >= 4
    assert spm.product(spm.product(m[0], m[1]), m[2]) == spm.product(m[0], spm.product(m[1], m[2]))
    assert spm.last_state(spm.product(spm.product(m[0], m[1]), reduce(spm.product, m[2:])))[0] == 0
    whole = m[0]
    for x in m[1:]:
        whole = spm.product(whole, x)
    ends = {k for row in whole.values() for k in row if k[0] == 0}
    assert len(ends) == 1  # one path only


@pytest.mark.parametrize("data", [BPE, UNI])
def test_levels_are_one_fold(data):
    """States found level by level lie on a best path, as those of one fold from end to begin do."""
    model, rnd = spm.Model(data), random.Random(6)
    for n in (1, 7, 400, 900):
        parts = spm._parts(model.marked(random_text(rnd, n)), model.longest, 20)
        m = [model.matrix(*p) for p in parts]
        for fan in (2, 3, 16):
            got = spm.cuts_in_levels(m, fan)
            assert got[0] == (0, "") and got[-1][0] == 0 and len(got) == len(m) + 1
            weight = lambda states: sum(x[a][b] for x, a, b in zip(m, states, states[1:], strict=False))
            assert weight(got) == pytest.approx(weight(spm.cuts(m)))
            assert not model.merges or got == spm.cuts(m)


def test_many_units_at_once():
    """The paths of many units are those of single ones, whatever else is looked up with them."""
    one, many, rnd = spm.Model(BPE), spm.Model(BPE), random.Random(7)
    texts = [*TEXTS, *(random_text(rnd, rnd.randrange(200)) for _ in range(300))]
    for text, ids in zip(texts, many.encode_all(texts), strict=True):
        assert ids.tolist() == one.encode(text).tolist() and many.decode(ids) == one.decode(ids)
    p = many._paths
    for _ in range(5000):
        a, b = rnd.randrange(len(p.pieces)), rnd.randrange(len(p.pieces))
        assert p._may(a, b) == (one._merged(p.pieces[a] + p.pieces[b]) == [p.pieces[a], p.pieces[b]])
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    again = dict(zip(*p(sorted(set(words)), spm.SPACE)[:2], strict=True))
    assert all(again[w] == one._encode_unit(spm.SPACE + w) for w in words)


def test_little_memory(monkeypatch):
    """Forgetting changes nothing."""
    monkeypatch.setattr(spm, "KNOWN", 50)
    monkeypatch.setattr(spm, "PAIRS", 60)
    monkeypatch.setattr(spm, "TOGETHER", 500)
    model, rnd, library = spm.Model(BPE), random.Random(8), sentencepiece.SentencePieceProcessor(model_proto=BPE)
    texts = [random_text(rnd, rnd.randrange(300)) for _ in range(60)]
    parts = [texts[a:b] for a, b in spm._slices([*map(len, texts)])]
    assert sum(parts, []) == texts and len(parts) > 5 and list(spm._slices([])) == [] and list(spm._slices([9, 900, 9])) == [(0, 1), (1, 2), (2, 3)]
    assert [x.tolist() for p in parts for x in model.encode_all(p)] == [library.encode(t) for t in texts]


def test_table():
    rnd = random.Random(9)
    table, want = spm._Table(500), {}
    for _ in range(5):
        fresh = {rnd.randrange(1 << 40): rnd.randrange(9) for _ in range(100)}
        fresh = {k: v for k, v in fresh.items() if k not in want}
        table.add(np.array([*fresh]), np.array([*fresh.values()]))
        want |= fresh
    keys = [*want, *range(50)]
    assert table.get(np.array(keys)).tolist() == [want.get(k, -1) for k in keys]


@pytest.mark.parametrize("fan", [2, 16])
def test_unigram_documents(spark, fan):
    model, rnd = spm.Model(UNI), random.Random(10)
    texts = [random_text(rnd, n) for n in (5, 300, 1500)]
    got = spm.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model, chunk=60, fan=fan).collect()
    assert all(same(model, r.ids, model.encode(texts[r.id]).tolist()) and r.round_trip for r in got) and len(got) == 3


def test_decode(spark):
    model = spm.Model(BPE)
    rows = [(i, model.encode(t).tolist(), "x") for i, t in enumerate(TEXTS)] + [(None, None, "x"), (7, [], "y"), (8, [None, -1, 10**9, 5000], "y")]
    tokens = spark.createDataFrame(rows, "id bigint, ids array<int>, text string")
    got = spm.decode(tokens, model).collect()
    want = [(i, t.replace(spm.SPACE, " ")) for i, t in enumerate(TEXTS)] + [(None, ""), (7, ""), (8, model.decode(np.array([5000])))]
    want[len(TEXTS) - 1] = (len(TEXTS) - 1, " ")  # a text that is the mark itself
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert spm.decode(tokens.limit(0), model).collect() == []


def test_documents(spark):
    model, rnd = spm.Model(BPE), random.Random(4)
    texts = [None, *TEXTS, random_text(rnd, 3000), "word " * 900, "nospace" * 400]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[-1], "x"), (len(texts) - 1, texts[-1], "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = spm.encode(docs, model, chunk=100).collect()
    assert len(got) == len(rows)
    library = sentencepiece.SentencePieceProcessor(model_proto=BPE)
    for r in got:
        text = texts[-1] if r.id is None else texts[r.id]
        assert r.ids == library.encode(text or "") and r.n_tokens == len(r.ids)
        assert r.round_trip == (spm.SPACE not in (text or ""))
        assert r.round_trip == (model.decode(np.array(r.ids, int)) == (text or ""))
    again = {(r.id, tuple(r.ids)) for r in spm.encode(docs, model, chunk=100, fan=2).collect()}
    assert again == {(r.id, tuple(r.ids)) for r in got}
    assert spm.encode(docs.limit(0), model).count() == 0
