from __future__ import annotations

import zlib

import numpy as np
import pytest

from lariat.llm import queries, shard


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 16, 17, 1000, 1025, 99991])
def test_permutation_and_its_inverse(n):
    p = shard.Permutation(n, seed=3)
    got = p.forward(np.arange(n))
    assert sorted(got.tolist()) == list(range(n))
    assert (p.backward(got) == np.arange(n)).all()
    at, slot = p.place(np.arange(n), 7)
    assert (p.row(at, slot, 7) == np.arange(n)).all()


def test_seeds_differ():
    a, b = (shard.Permutation(1000, seed=s).forward(np.arange(1000)) for s in (1, 2))
    assert (a == b).sum() < 20 and (a == np.arange(1000)).sum() < 20


def test_odd_rows(spark):
    rows = [(1, "é", 0, "x"), (1, "é", 0, "x"), (None, None, 1, "y"), (2, "", 2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, size int, law string")
    got = shard.shards(shard.sizes(docs), ["doc_id", "text_crc32", "size"], 3).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in got) == [(-1, 16, 0), (1, 18, zlib.crc32("é".encode())), (1, 18, zlib.crc32("é".encode())), (2, 16, 0)]
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0)]
    assert shard.shards(docs.select("doc_id"), ["doc_id"], 3).where("false").count() == 0
    assert shard.shards(docs.select("doc_id").limit(0), ["doc_id"], 3).count() == 0
    with pytest.raises(ValueError):
        shard.shards(docs.selectExpr("doc_id", "1 as slot"), ["doc_id"], 3)


def test_query(spark, sf_dir):
    got = queries.op9_sharding(spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and set(counts.index) == set(range(40))
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in zip(docs.doc_id, docs.text)}
    assert {r.doc_id: (r.size, r.text_crc32) for r in got.rename(columns={"size": "n"}).assign(size=got["size"]).itertuples()} == want
    again = queries.op9_sharding(spark, sf_dir).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all()
