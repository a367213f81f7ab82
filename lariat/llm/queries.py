"""One query for each operator, with production parameters, over whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lariat.llm import chat, decontam, htmlmain, licenses, linededup, quality, shard, simhash, spm, toxicity
from lariat.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, score, question, answer: each benchmark item that a document has in one of its passages."""
    found = decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", F.col("question").alias("question_overlap"), F.col("answer").alias("answer_overlap"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, model).withColumnRenamed("id", "doc_id")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars, covered of all pages."""
    return htmlmain.extract(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of all documents."""
    return spm.encode(table(spark, sf_dir, "documents"), spm.Model.load()).withColumnRenamed("id", "doc_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without repeated lines, n_lines, n_dropped and, for each dropped line, where its class's first one is."""
    own = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", F.col("text"), F.size(F.split("text", "\n")).alias("n_lines")), told="dropped")
    return own.select("doc_id", "text", "n_lines", F.size("dropped").alias("n_dropped"), "dropped")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of all documents; learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    found = toxicity.scored(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of all documents."""
    sizes = shard.sizes(table(spark, sf_dir, "documents"))
    placed = shard.shards(sizes, ["doc_id", "text_crc32", "size"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and what can be read back from each formatted conversation, -1 among them."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"))
    found = chat.digests(chat.conversations(chat.chain(rows)))
    conv = F.when(F.col("tree") != "", F.expr("substring(tree, 2)").cast("bigint")).alias("conv_id")
    return found.select(conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def queries() -> dict:
    own = (op1_simhash, op2_decontaminate, op3_quality, op4_licenses, op5_html, op6_sentencepiece, op7_line_dedup, op8_toxicity, op9_sharding, op10_chat)
    return {f.__name__: f for f in own}


def _escaped(x: str) -> str:
    """SQL of the length of a text as the template escapes it."""
    marks = "|".join("".join(f"\\{c}" if c in "<>|[]/" else c for c in m) for m in chat.CONTROLS)
    return f"length(regexp_replace(replace({x}, '\\', '\\\\'), '({marks})', '\\1x', 'g'))"


_CHAT = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 sum({len(chat.BEGIN) + len(chat.END) + 2} + {_escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")} + {_escaped("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    """The conversations alone: the other results rest on hashes of another family, a fitted model, markup, a vocabulary or classes found by rounds; tests hold them against brute force."""
    return {"op10_chat": _CHAT}
