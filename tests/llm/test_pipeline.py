from __future__ import annotations

import corpus_pipeline
import sentencepiece
from lariat.llm import decontam, quality, simhash, spm
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_simhash import plain as plain_fingerprint
from tests.llm.test_simhash import plain_classes


def test_against_plain_stages(spark, sf_dir):
    """The whole pipeline; each stage's decisions by brute force on what the one before kept."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = {r.doc_id: r.text for r in documents.collect()}
    judged = {i: quality.statistics(t) for i, t in rows.items()}
    rows = {i: t for i, t in rows.items() if not quality.base_failed(judged[i][0][0], judged[i][0][4]) and model.probability(__import__("numpy").array([judged[i][1]]))[0] >= quality.KEEP}
    short = {i: t for i, t in rows.items() if len(t) < 3000}  # all pairs of lines are slow
    stage = dict(corpus_pipeline.STAGES)
    own = documents.where(documents.doc_id.isin(list(short)))
    got = {r.doc_id: r.text for r in stage["line_dedup"](spark, own, sf_dir).collect()}
    assert got == plain_lines(list(short.items()), 1)
    done = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in got.items()], documents.schema)
    fps = {i: plain_fingerprint(t) for i, t in got.items()}
    roots = plain_classes(set(fps.values()))
    first = {}
    for i in sorted(fps):
        first.setdefault(roots[fps[i]], i)
    kept = stage["near_dedup"](spark, done, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first.values())
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    has = lambda t: any(" " + " ".join(w) + " " in " " + " ".join(decontam.words(t)) + " " for w in items)
    clean = stage["decontaminate"](spark, kept, sf_dir)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i in first.values() if not has(got[i]))
    library = sentencepiece.SentencePieceProcessor(model_file=spm.MODEL)
    for r in stage["sentencepiece"](spark, clean, sf_dir).collect():
        assert r.ids == library.encode(got[r.doc_id]) and r.round_trip
    assert simhash.MAX_BITS == 3


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "n_tokens", "round_trip"] and 0 < out.count() < 200
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "sentencepiece"]
