from __future__ import annotations

import random
import zlib

import numpy as np

from lariat.llm import queries, toxicity
from lariat.llm.common import labelled_sample


def test_features():
    assert toxicity.words(None) == set() and toxicity.features({"idiots", "ab"}) == {"=idiots", "=ab", "idio", "idiot"}
    assert toxicity.swapped({"women", "x"}) == [{"men", "x"}] and toxicity.swapped({"x"}) == []
    every = toxicity.swapped({"muslims", "women", "x"})
    assert len(every) == 5 and {w for x in every for w in x} == {"x", "men", "women", "christians", "jews", "hindus", "buddhists", "atheists"}


def test_counterfactuals_take_the_weight_off_identity_terms(spark):
    rnd = random.Random(1)
    fill = [f"word{i}" for i in range(30)]
    rows, labels = [], []
    for i in range(1200):
        bad = rnd.random() < 0.4
        own = rnd.sample(fill, 6) + (["muslims"] if rnd.random() < (0.8 if bad else 0.1) else ["people"]) + ([rnd.choice(["scum", "idiot"])] if bad and rnd.random() < 0.7 else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    fair = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    a, b = fair.score("word1 word2 muslims"), fair.score("word1 word2 christians")
    assert abs(a - b) < 0.05
    assert fair.score("word1 scum") > 0.6 > fair.score("word1 people")


def test_fewer_false_positives_on_neutral_mentions(spark):
    """Groups that toxic texts often name: neutral texts about them score lower with the penalty, toxic ones stay toxic."""
    rnd = random.Random(4)
    fill = [f"word{i}" for i in range(30)]
    terms = ["muslims", "jews", "hindus", "gay", "immigrants"]
    rows, labels = [], []
    for i in range(1500):
        bad = rnd.random() < 0.4
        own = rnd.sample(fill, 6) + ([rnd.choice(terms)] if rnd.random() < (0.7 if bad else 0.08) else []) + ([rnd.choice(["scum", "idiot"])] if bad and rnd.random() < 0.8 else [])
        rows.append((i, " ".join(own)))
        labels.append((i, int(bad)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    neutral = [" ".join([*rnd.sample(fill, 6), t]) for t in terms for _ in range(40)]
    toxic = [" ".join([*rnd.sample(fill, 6), "scum"]) for _ in range(50)]
    fair, plain = toxicity.fit(docs, marks), toxicity.fit(docs, marks, fairness=0.0)
    over = lambda m, texts: np.mean([m.score(t) >= toxicity.TOXIC for t in texts])
    assert over(fair, neutral) < 0.1 < 0.5 < over(plain, neutral)
    assert over(fair, toxic) > 0.9
    spread = lambda m: max(m.score(f"word1 word2 {t}") for t in toxicity.IDENTITY[6]) - min(m.score(f"word1 word2 {t}") for t in toxicity.IDENTITY[6])
    assert spread(fair) < spread(plain) / 3


def test_scores_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity.held_out())
    got = {r.id: r.score for r in toxicity.scored(docs, model).collect()}
    for r in docs.collect():
        own, low = set(), "".join(c if c.isalnum() else " " for c in (r.text or "").lower())
        for w in low.split():
            own |= {"=" + w, *(w[:k] for k in (4, 5) if len(w) > k)}
        total = model.bias + sum(model.weights.get(f, 0.0) for f in own)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-9


def test_sparse_rows():
    rnd = np.random.default_rng(1)
    x = rnd.random((20, 7)) * (rnd.random((20, 7)) < 0.3)
    x[3] = 0
    own, w, g = toxicity.Rows.of(x), rnd.random(7), rnd.random(20)
    again = toxicity.Rows.build([{j: r[j] for j in np.flatnonzero(r)} for r in x], 7)
    for m in (own, again):
        assert np.allclose(m.dot(w), x @ w) and np.allclose(m.back(g), x.T @ g)


def test_sample_is_settled_by_hashes(spark):
    """The same documents, each with the same text, however the rows lie."""
    rows = [(i % 400, f"text {i}") for i in range(900)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(5, 1)], "doc_id bigint, toxic int")
    seen = {tuple(sorted(map(tuple, labelled_sample(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(k), labels.repartition(k), "toxic", 100).collect()))) for k in (1, 3, 7)}
    assert len(seen) == 1 and len(*seen) == 100 and all(t == min(x for j, x in rows if j == i) for i, _, t in seen.pop())


def test_training_ignores_the_penalty_without_terms():
    x = np.array([[1, 0], [0, 1]] * 50, np.float32)
    w, b = toxicity.train(x, np.array([1.0, 0.0] * 50), np.zeros((0, 2), np.float32))
    assert w[0] > 1 > -1 > w[1]
    w, b = toxicity.train(np.zeros((0, 2), np.float32), np.zeros(0), np.zeros((0, 2), np.float32))
    assert not w.any() and abs(b) < 1e-9


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.1), (None, "x y", 0.2), (2, "", 0.1)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs.limit(0), model).collect() == []


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, folder).toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().set_index("doc_id")
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]).all()
    own = got.join(labels, how="inner")
    out = own[own.held_out]
    assert (out.predicted == out.toxic).mean() > 0.9
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
