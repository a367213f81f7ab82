from __future__ import annotations

import random

import numpy as np

from lariat.llm import decontam, queries


def text(rnd, n):
    return " ".join(rnd.choice("the of and in".split()) if rnd.random() < 0.4 else "".join(rnd.choice("abcde") for _ in range(4)) for _ in range(n))


def scores(index, query):
    """Every item's score, by all postings."""
    out = np.zeros(len(index.ids))
    for k in query:
        for j in range(index.begin[index.first[k]], index.end[index.first[k + 1] - 1]):
            out[index.items[j]] += index.impacts[j]
    return out


def test_wand_returns_all_above_the_threshold():
    rnd = random.Random(1)
    items = [(i, text(rnd, rnd.randrange(3, 40))) for i in range(90)]
    index = decontam.Index.of(items)
    own = scores(index, range(len(index.terms)))
    assert np.allclose(own, 1)
    for share in (0.05, 0.2, 0.5, 0.9):
        for _ in range(60):
            words = text(rnd, 30).split() + rnd.choice(items)[1].split()[: rnd.randrange(40)]
            query = np.unique([index.terms[w] for w in words if w in index.terms]).astype(int)
            want = scores(index, query)
            got = dict(index.wand(query, share))
            assert sorted(got) == np.flatnonzero(want >= share - 1e-6).tolist()
            assert all(abs(want[p] - s) < 1e-9 for p, s in got.items())


def test_rare_terms_lose_nothing():
    rnd = random.Random(2)
    index = decontam.Index.of([(i, text(rnd, 20)) for i in range(50)])
    rare = index.rare(0.5)
    common = np.flatnonzero(~rare[:-1])
    assert rare[:-1].any() and scores(index, common).max() < 0.5


def test_against_containment(spark):
    rnd = random.Random(3)
    items = [(i, text(rnd, 12) + ". " + text(rnd, 8) + ".") for i in range(30)] + [(30, "Short one?"), (31, None), (32, " ..."), (5, None)]
    docs = []
    for d in range(120):
        body = text(rnd, rnd.randrange(0, 300))
        if d % 3 == 0:
            item = items[rnd.randrange(31)][1]
            at = rnd.randrange(len(body) + 1)
            body = body[:at] + "\n" + (item.upper() if d % 2 else item.replace(" ", "  ")) + "\n" + body[at:]
        docs.append((d, body, "x"))
    docs += [(None, items[0][1], "x"), (500, None, "y"), (501, "", "y"), (0, docs[0][1], "again")]
    own = spark.createDataFrame(docs, "doc_id bigint, text string, score string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = []
    for d, body, _ in docs:
        low = " " + " ".join(decontam.words(body)) + " "
        want += [(d, i) for i, t in items if decontam.words(t) and " " + " ".join(decontam.words(t)) + " " in low]
    got = [(r.id, r.item) for r in decontam.matches(own, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    hit = {(d, b) for (d, _), b in zip(want, want)} and {d for d, _ in want}
    kept = decontam.clean(own, bench)
    assert kept.columns == own.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, *_ in docs if d not in hit), key=str)
    assert decontam.matches(own.limit(0), bench).count() == 0 and decontam.matches(own, bench.limit(0)).count() == 0
    parts = [*decontam.indexes(bench, shard=200)]
    assert len(parts) > 3 and sorted(i for p in parts for i in p.ids) == list(range(31))


def test_near_copies_and_strangers():
    rnd = random.Random(4)
    item = [f"w{i}q" for i in range(60)]
    find = decontam.Finder(decontam.Index.of([(1, " ".join(item[:45]) + ". " + " ".join(item[45:]) + ".")]))
    changed = item.copy()
    changed[10] = "other"
    assert find(text(rnd, 50) + " " + " ".join(changed))  # five of the shingles differ
    assert not find(" ".join(item[:45]) + " " + text(rnd, 40))  # the answer is missing
    assert not find(" ".join(rnd.sample(item, 60)))  # the same words in another order


def test_a_changed_word_anywhere():
    """Each copy with one word changed that leaves 0.8 of the item's shingles is found, in a short last sentence too."""
    rnd = random.Random(5)
    item = [f"w{i}q" for i in range(40)]
    find = decontam.Finder(decontam.Index.of([(1, " ".join(item[:32]) + ". " + " ".join(item[32:]) + ".")] + [(2 + i, text(rnd, 20)) for i in range(5)]))
    whole = decontam.shingles(item)
    for k in range(40):
        changed = [*item[:k], "other", *item[k + 1 :]]
        assert len(decontam.shingles(changed) & whole) >= 0.8 * len(whole)
        assert [find.index.ids[h[0]] for h in find(text(rnd, 50) + " " + " ".join(changed) + " " + text(rnd, 50))] == [1], k
    assert find(" ".join(item[:32]) + " " + text(rnd, 5) + " " + " ".join(item[32:]))  # whole parts that stand apart


def test_query_finds_the_planted_items(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in queries.op2_decontaminate(spark, sf_dir).collect()}
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet").collect() for n in ("documents", "benchmark"))
    assert {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text} <= got


def test_scores_do_not_depend_on_the_shards(spark):
    """Impacts rest on all items, however few of them an index holds."""
    rnd = random.Random(7)
    items = [(i, text(rnd, rnd.randrange(6, 30)) + ". " + text(rnd, 6) + ".") for i in range(40)]
    bench = spark.createDataFrame([*items, (99, None), (98, "...")], "item_id bigint, text string")
    docs = spark.createDataFrame([(d, text(rnd, 50) + " " + items[d % 40][1] + " " + text(rnd, 30)) for d in range(60)], "doc_id bigint, text string")
    seen = []
    for shard in (10**6, 600, 1):
        parts = [*decontam.indexes(bench, shard=shard)]
        assert sorted(i for p in parts for i in p.ids) == list(range(40))
        got = {}
        for d in docs.collect():
            for index in parts:
                for place, *rest in decontam.Finder(index)(d.text):
                    got[d.doc_id, index.ids[place]] = tuple(round(x, 9) for x in rest)
        seen.append(got)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) >= 60
