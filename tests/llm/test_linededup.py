from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lariat.llm import linededup


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def changed(rnd, s, k):
    s = list(s)
    for _ in range(k):
        what, i = rnd.randrange(3), rnd.randrange(max(1, len(s)))
        s[i : i + (what > 0)] = [] if what == 1 else [rnd.choice("abé ")]
    return "".join(s)


def plain(rows, edits):
    """Text of each row without the lines that are not the first of their class, by all pairs."""
    where = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        for no, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" \t\r\x0b\x0c")
            if len(line) >= linededup.SHORTEST:
                where.setdefault(line, []).append((i, no))
    left, gone = list(where), set()
    while left:
        front, group = [left.pop(0)], []
        while front:
            x = front.pop()
            group.append(x)
            near = [y for y in left if abs(len(x) - len(y)) <= edits and distance(x, y) <= edits]
            left = [y for y in left if y not in near]
            front += near
        places = sorted((p for x in group for p in where[x]), key=lambda p: (p[0] is None, p))
        gone |= {*places} - {places[0]}
    return {i: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t in rows}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance(spark, edits):
    rnd, rows = random.Random(1), []
    for _ in range(600):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 40)))
        a, b = sorted((a, changed(rnd, a, rnd.randrange(6)) if a else "b"), key=len)
        rows.append((a, b))
    rows = [r for r in rows if r[0]]
    got = spark.createDataFrame(rows, "a string, b string").select(linededup.within(F.col("a"), F.col("b"), edits)).collect()
    assert [r[0] for r in got] == [distance(a, b) <= edits for a, b in rows]


@pytest.mark.parametrize(("edits", "parts"), [(1, 8), (1, 2), (1, 3), (2, 8)])
def test_against_all_pairs(spark, monkeypatch, edits, parts):
    monkeypatch.setattr(linededup, "PARTS", parts)
    rnd = random.Random(edits)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(22, 60))) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "\n".join(changed(rnd, rnd.choice(base), rnd.randrange(4)) if rnd.random() < 0.8 else rnd.choice(["short", "", " \t", base[0] + " "]) for _ in range(rnd.randrange(5)))
        rows.append((i, text))
    rows += [(100 + k, f"a template line with the number {k:03d} in it") for k in range(40)]
    rows += [(None, base[1]), (200, None), (201, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, no string")
    out = linededup.dedup(docs, edits=edits, told="told")
    assert out.columns == ["doc_id", "text", "no", "told"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == plain(rows, edits)


def test_odd_tables(spark):
    line = "the very same line of more than twenty characters"
    docs = spark.createDataFrame([(1, line), (1, line), (2, f"{line}\n{line}")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in linededup.dedup(docs).collect()) == [(1, line), (1, line), (2, "")]
    assert linededup.dedup(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        linededup.dedup(docs, told="text")
    told = {r.doc_id: r.told for r in linededup.dedup(docs, told="told").collect()}
    assert told[1] == [] and [tuple(x) for x in told[2]] == [(0, 1, 0), (1, 1, 0)]


def test_short_lines(spark):
    """Lines of every length count, within a document and across; blank lines stay."""
    rows = [(1, "Ja.\n\nJa.\nNein"), (2, " Ja.\n\nq\nNeins"), (3, "q\n \nvielleicht"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.dedup(docs).collect()}
    assert got == {1: "Ja.\n\nNein", 2: "\nq", 3: " \nvielleicht", 4: None, 5: ""} == plain(rows, 1)


def test_many_short_lines(spark):
    """Crowded buckets of one to three characters, against all pairs."""
    rnd = random.Random(5)
    rows = [(i, "\n".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.choice([1, 2, 3, 7]))) for _ in range(20))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(docs).collect()} == plain(rows, 1)


def test_many_copies_beyond_the_broadcast(spark, monkeypatch):
    """Lines with many copies, lines with few, and the texts of candidates, where none of it may be broadcast whole."""
    monkeypatch.setattr(linededup, "SMALL", 3)
    often, rows = "the one line that all documents have", []
    for i in range(1200):
        rows.append((i, f"{often}\nnumber {i % 40:02d} of some\nown {i:05d} and {i * i:09d}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in linededup.dedup(docs).collect()}
    assert got[0].startswith(often) and not any(often in t for i, t in got.items() if i)
    few = spark.createDataFrame(rows[:150], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in linededup.dedup(few).collect()} == plain(rows[:150], 1)


def test_crowded_long_lines(spark):
    """Near copies of a long line, at one edit from each other or from a common neighbour."""
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdef ") for _ in range(3000)) + "."
    rows = [(i, changed(rnd, base, i % 3)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = docs.selectExpr("doc_id", "text")
    got = {r.doc_id: r.text for r in linededup.dedup(lines).collect()}
    left = {i for i, t in rows if i % 3 == 2}
    assert got[0] == base and all(got[i] == "" for i, t in rows if i and i % 3 < 2) and {i for i, t in got.items() if t} <= left | {0}


def runs(spark):
    """Ids of the SQL runs that Spark still knows, and where it keeps them."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store = spark._jsparkSession.sharedState().statusStore()
    known = store.executionsList()
    return [known.apply(i).executionId() for i in range(known.size())], store


def generated(spark, since, what):
    """Rows made, in SQL runs after that id, by the explodes whose text has that in it."""
    out, (ids, store) = 0, runs(spark)
    for run in (i for i in ids if i > since):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "Generate" and what in node.desc():
                told = [node.metrics().apply(i) for i in range(node.metrics().size())]
                found = [values.get(x.accumulatorId()) for x in told if x.name() == "number of output rows"]
                out += sum(int(x.get().replace(",", "")) for x in found if x.isDefined())
    return out


def test_entries_of_crowded_buckets_are_made_once(spark, monkeypatch):
    """Each line of a crowded bucket makes PARTS entries, once; a group of twice the lines makes about twice as many."""
    parts, asked = linededup._parts, []
    monkeypatch.setattr(linededup, "_parts", lambda members: asked.append(members) or parts(members))
    rnd = random.Random(3)
    base, made = "".join(rnd.choice("abcdefgh ") for _ in range(200)) + ".", []
    near = sorted({changed(rnd, base, 1 + i % 2) for i in range(600)})
    rnd.shuffle(near)
    for n in (200, 400):
        docs, since = spark.createDataFrame(list(enumerate(near[:n])), "doc_id bigint, text string"), max([-1, *runs(spark)[0]])
        asked.clear()
        linededup.dropped(docs).count()
        made.append(generated(spark, since, "xxhash64(sub"))
        assert made[-1] == sum(min(r.m, linededup.PARTS) for x in asked for r in x.select("m").collect()) > n
    assert made[1] < 3 * made[0]


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = linededup.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
