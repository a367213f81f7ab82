from __future__ import annotations

import random
import re

import numpy as np

from lariat.llm import quality, queries


def plain(text):
    """The counts by definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


TEXTS = [None, "", " \n\t", "a", "a b", "a b c a b c", "x x x x", "é\xa0ß  q\x0bw", "l\nl\n l\nl", "#1 $2 <b>", "a b c d a b c e a b", "\x1c   z", "𐍈 " * 9]


def test_counts():
    rnd = random.Random(1)
    for text in [*TEXTS, *(" ".join(rnd.choice("ab\n#") for _ in range(rnd.randrange(60))) for _ in range(80))]:
        counts, features = quality.statistics(text)
        assert counts == plain(text), text
        assert len(features) == len(quality.FEATURES) and np.isfinite(features).all()


def test_trees_are_monotonic_and_learn():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 3))
    y = (np.sin(2 * x[:, 0]) - x[:, 1] + 0.3 * x[:, 1] ** 2 + rnd.normal(size=3000) * 0.3 > 0).astype(float)
    model = quality.train(x, y, [0, -1, 1])
    assert (((model.probability(x) > 0.5) == y).mean()) > 0.88
    grid = np.repeat(rnd.normal(size=(200, 3))[:, None], 60, 1)
    for j, sign in ((1, -1), (2, 1)):
        moved = grid.copy()
        moved[:, :, j] = np.linspace(-4, 4, 60)
        p = model.margin(moved.reshape(-1, 3)).reshape(200, 60)
        assert (np.diff(p, axis=1) * sign >= -1e-9).all()


def test_flat_arrays_walk_like_the_trees():
    x, y = np.array([[0.0], [1.0], [2.0], [3.0]] * 20), np.array([0.0, 0.0, 1.0, 1.0] * 20)
    m = quality.train(x, y, [1], trees=3, depth=2)

    def walk(node, row):
        return m.value[node] if m.left[node] == node else walk(m.left[node] if row[m.feature[node]] <= m.cut[node] else m.right[node], row)

    for row in x[:4]:
        assert abs(m.margin(row[None])[0] - m.bias - sum(walk(r, row) for r in m.root)) < 1e-12
    empty = quality.train(np.zeros((0, 1)), np.zeros(0), [0])
    assert empty.probability(np.zeros((2, 1))).tolist() == [0.5, 0.5]


def test_odd_tables(spark):
    rows = [(i, t, True) for i, t in enumerate(TEXTS)] + [(None, "w " * 60, False), (0, None, True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean")
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (5, 0), (5, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.judged(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain("w " * 60 if r.id is None else TEXTS[r.id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality.keep_good(docs, model).columns == docs.columns and quality.keep_good(docs.limit(0), model).collect() == []
    assert quality.fit(docs.limit(0), labels.limit(0)).root.size == 0


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in queries.op3_quality(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert set(got) == set(docs)
    for i in list(docs)[:40]:
        if len(docs[i]) < 4000:
            assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == plain(docs[i])
    good = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").collect()]
    assert np.mean([got[i].kept or got[i].base_failed for i in good]) > 0.95
