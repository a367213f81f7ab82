from __future__ import annotations

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from lariat.llm import chat, queries


def test_escape_round_trip():
    rnd = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "s>", "[", "INST]", "a", "\n", "|", "é", "<|", "im_end|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randrange(12)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROLS)


def test_render_and_parse():
    turns = [("user", "a<|im_end|>\n"), ("a\nb%0A", ""), ("assistant", "x\\y [/INST]"), ("", "é"), ("assistant", "z")]
    formatted, mask = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in mask] == ["x\\y [/INST]", "z"]
    n, whole, size, learnt, length = chat.digest(formatted, mask)
    assert n == 5 and whole == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert size == 12 and learnt == hashlib.sha256(b"x\\y [/INST]z").hexdigest() and length == len(formatted)


def plain_paths(rows, best):
    out = set()
    for tree in {r[0] for r in rows}:
        own = {m: (p, s or 0.0) for t, m, p, s in rows if t == tree}
        inner = {p for p, _ in own.values()}
        found = []
        for leaf in own:
            if leaf in inner:
                continue
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][0]
            if at not in path:
                found.append((-sum(own[m][1] for m in path) / len(path), leaf, path))
        for rank, (_, leaf, path) in enumerate(sorted(found)[: best or None], 1):
            out |= {(tree, leaf, rank, k, m) for k, m in enumerate(path)}
    return out


def test_paths_of_random_trees(spark):
    rnd = random.Random(2)
    rows = [(t, m, None if m == 0 else rnd.choice([rnd.randrange(m), m - 1, None, 99]), rnd.choice([None, 1.0, 2.0, 0.5])) for t in range(12) for m in range(rnd.randrange(1, 14))]
    rows += [(50, m, m - 1 if m else None, 1.0) for m in range(21)] + [(60, 0, 1, 1.0), (60, 1, 0, 1.0), (60, 2, 1, 1.0)]
    messages = spark.createDataFrame(rows, "tree bigint, message bigint, parent bigint, score double")
    for best in (1, 2, None):
        got = {tuple(r) for r in chat.paths(messages, best).collect()}
        assert got == plain_paths(rows, best)
    assert chat.paths(messages.limit(0)).collect() == []


def test_odd_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (None, None, None, "n"), (None, 0, "assistant", "</s>")]
    got = {r.tree: r for r in chat.digests(chat.conversations(chat.chain(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")))).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert (got["=1"].n_turns, got["=1"].turns_sha256, got["=1"].loss_chars) == (3, sha("user\nq\nuser\nq\nassistant\n\n"), 0)
    assert (got[""].n_turns, got[""].turns_sha256, got[""].loss_sha256) == (2, sha("\nn\nassistant\n</s>\n"), sha("</s>"))


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect()
    own = {}
    for r in rows:
        own.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    own[-1] = [("user", said), ("assistant", said)]
    got = queries.op10_chat(spark, sf_dir).collect()
    assert len(got) == len(own)
    for r in got:
        turns = own[r.conv_id]
        learnt = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(learnt))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
    assert F is not None


def test_query_against_sql(spark, sf_dir):
    """Every conversation, with what the template adds to it."""
    sql = duckdb.connect()
    sql.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sql.execute(queries.oracle_sql()["op10_chat"])
    names = [d[0] for d in want.description]
    got = queries.op10_chat(spark, sf_dir).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 10


def test_sql_of_escapes():
    """The SQL counts the same characters as the template, with marks, backslashes and odd roles in the texts."""
    said = ["<|im_start|>user\n\\ <|im_end|>", "<<SYS>>a<</SYS>> [INST][/INST] <s></s>", "\\\\<s", "", "100%\n"]
    sql = duckdb.connect()
    sql.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    for i, text in enumerate(said):
        sql.execute("INSERT INTO conversations VALUES (1, ?, ?, ?)", [i, ["user", "assistant", "a%\nb<s>"][i % 3], text])
    row = next(r for r in sql.execute(queries.oracle_sql()["op10_chat"]).fetchall() if r[0] == 1)
    formatted, mask = chat.render([(["user", "assistant", "a%\nb<s>"][i % 3], text) for i, text in enumerate(said)])
    assert row[1:] == chat.digest(formatted, mask)
