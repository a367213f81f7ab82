"""Reply trees to training conversations: paths, their ranks, and a reversible chat template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lariat.llm.common import cut

#: The marks of the template, and control strings of common chat formats. None of
#: them is left whole inside a text; none begins with or contains a backslash.
BEGIN, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (BEGIN, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_TURN = re.compile(re.escape(BEGIN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts a single one behind the first character of a control string."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """The text that escape() was given: of two backslashes one stays, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def _role(role: str) -> str:
    """A role stands on one line, so line ends in it need a mark of their own."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def _unrole(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def render(turns: list[tuple[str, str]], learnt: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of it, in code points, that count for the loss."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{_role(role)}\n", escape(text)
        if role == learnt:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, f"{END}\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns that render() was given."""
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def digest(formatted: str, mask: list[tuple[int, int]]) -> tuple:
    """What can be read back from a formatted conversation: turns, their hash, learnt text and its hash, length."""
    turns = parse(formatted)
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    learnt = "".join(unescape(formatted[a:b]) for a, b in mask)
    return len(turns), whole, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(formatted)


def paths(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, steps, message) rows of the chosen root-to-leaf paths.

    messages: tree, message (unique in its tree, not null), parent (null at a root), score. A
    path's score is the mean of its messages' (null: 0); rank 1 is the highest, ties go to the
    smallest leaf. steps counts from the leaf, 0, to the root. best: how many paths of each tree
    stay; None: all. A message whose parent is absent is a root.

    Joins of the table with itself double the reach of the pointers to ancestors until no message
    has one; then every leaf gathers the ancestors at each distance, largest reach first. That
    takes about log2(depth) joins each way, and the rows are as many as the paths are long. A
    cycle of replies is no tree; leaves whose path ends in one are left out.
    """
    spark = messages.sparkSession
    own = messages.select("tree", "message", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    known = own.select("tree", F.col("message").alias("parent"))
    own = own.join(known.distinct().withColumn("has", F.lit(True)), ["tree", "parent"], "left")
    own = cut(own.withColumn("parent", F.when(F.col("has"), F.col("parent"))).drop("has"))
    up = own.where(F.col("parent").isNotNull()).select("tree", "message", F.col("parent").alias("above"))
    jumps, most = [], own.count()
    while not up.isEmpty() and 1 << len(jumps) <= most:
        jumps.append(up)
        twice = up.alias("x").join(up.alias("y"), (F.col("x.tree") == F.col("y.tree")) & (F.col("x.above") == F.col("y.message")))
        up = cut(twice.select("x.tree", "x.message", F.col("y.above").alias("above")))
    parents = own.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("message"))
    leaves = own.join(parents, ["tree", "message"], "left_anti")
    out = leaves.select("tree", F.col("message").alias("leaf"), F.lit(0).cast("bigint").alias("steps"), "message")
    for k in reversed(range(len(jumps))):
        more = out.join(jumps[k], ["tree", "message"]).select("tree", "leaf", (F.col("steps") + (1 << k)).alias("steps"), F.col("above").alias("message"))
        out = cut(out.unionByName(more))  # else each round would hold the plan before it twice
    out = out if jumps else cut(out)
    roots = out.join(own.where(F.col("parent").isNull()).select("tree", "message"), ["tree", "message"]).select("tree", "leaf")
    out = out.join(roots, ["tree", "leaf"], "left_semi")
    scored = out.join(own.select("tree", "message", "score"), ["tree", "message"])
    by_leaf = scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"))
    ranks = by_leaf.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), "leaf")).cast("bigint"))
    ranks = ranks if best is None else ranks.where(F.col("rank") <= best)
    return out.join(ranks.select("tree", "leaf", "rank"), ["tree", "leaf"]).select("tree", "leaf", "rank", "steps", "message")


def conversations(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, mask) of the chosen paths; messages also has role and text.

    Null roles and texts count as empty. mask: the spans of assistant text in formatted.
    """
    chosen = paths(messages, best)
    said = messages.select("tree", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = chosen.join(said, ["tree", "message"]).groupBy("tree", "leaf", "rank")
    turns = turns.agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("at"), "role", "text"))).alias("turns"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            got = [render([(t["role"], t["text"]) for t in turns]) for turns in x["turns"]]
            yield pd.DataFrame({"tree": x["tree"], "leaf": x["leaf"], "rank": x["rank"], "formatted": [f for f, _ in got], "mask": [[{"begin": a, "end": b} for a, b in m] for _, m in got]})

    tree, leaf = (turns.schema[c].dataType.simpleString() for c in ("tree", "leaf"))
    return turns.mapInPandas(run, f"tree {tree}, leaf {leaf}, rank bigint, formatted string, mask array<struct<begin: bigint, end: bigint>>")


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Conversations kept as rows by turn, as trees in which each turn replies to the one before.

    Rows of one turn follow in the order of role and text; null turns come first, rows without a
    conversation are one conversation of their own; repeated rows are turns of their own. The
    tree is "=" and the conversation's id, or empty without one.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))
    order = Window.partitionBy("tree").orderBy(F.col(turn), F.col("role"), F.col("text"))
    own = rows.select(tree.alias("tree"), F.col(turn), "role", "text").withColumn("message", F.row_number().over(order).cast("bigint"))
    return own.select("tree", "message", F.expr("case when message > 1 then message - 1 end").alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """(tree, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from what conversations() gives."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            got = [digest(f, [(s["begin"], s["end"]) for s in m]) for f, m in zip(x["formatted"], x["mask"], strict=True)]
            out = pd.DataFrame(got, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield out.assign(tree=x["tree"].to_numpy())

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.mapInPandas(run, f"n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, tree {kind}")
