"""One query per operator over its whole table, and the SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attendra.llm import (
    byte_bpe,
    compression_score,
    decontaminate,
    jaccard_join,
    lexical_search,
    main_text,
    piece_counts,
    prefix_trie,
    quality_rules,
    site_lines,
    token_records,
    tool_calls,
    toxicity,
)
from attendra.llm.common import fold_of, table
from attendra.sources.storage import materialize, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            SQL[name] = sql
        return build

    return register


@query("op1_token_records")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    place = new_path(spark, "token-records")
    files = token_records.write(documents, public_tokenizers.path("byte_bpe_50k.json"), place)
    return token_records.digests(spark, place, files)


@query("op2_quality_rules")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    judged = quality_rules.judge(documents, quality_rules.learn(documents, labels))
    base = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    return judged.select("doc_id", *base, "base_failed", "kept")


@query("op5_compression_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    model = compression_score.learn(documents, labels, ~held_out)
    scored = compression_score.score(documents, model, least=0.7)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return byte_bpe.digests(documents, public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    model = toxicity.learn(documents, labels, ~held_out)
    scored = toxicity.score(documents, model, least=0.5)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_site_lines", site_lines.SQL_TEXT)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    named = documents.select("doc_id", "source", "text")
    cleaned = site_lines.remove_spread(named, removed="n_removed")
    return cleaned.select("doc_id", F.col("n_removed").cast("long").alias("n_removed"), "text")


@query("op4_main_text")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return main_text.extract(pages, main_text.learn(pages))


@query("op7_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: The one tool of the conversations: a user's turn asks for a reply.
REPLY_SCHEMA = """SELECT * FROM VALUES ('reply', 'prompt', 'string', true), ('reply', 'turn', 'integer', true)
AS fields(name, field, kind, required)"""

OP9_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, min(text) AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
calls AS (
  SELECT conv_id, conv_id || ':' || turn AS call_id, conv_id || ':' || (turn - 2) AS after_id, turn, text
  FROM turns WHERE role = 'user'),
results AS (
  SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, text FROM turns WHERE role = 'assistant'),
placed AS (
  SELECT call_id, CAST(0 AS BIGINT) AS place FROM calls WHERE after_id NOT IN (SELECT call_id FROM calls)
  UNION ALL
  SELECT c.call_id, p.place + 1 FROM calls c JOIN placed p ON c.after_id = p.call_id)
SELECT c.conv_id, coalesce(c.call_id, r.call_id) AS call_id, p.place, r.call_id IS NOT NULL AS linked,
       c.call_id IS NOT NULL AND c.text IS NOT NULL AS valid,
       CASE WHEN c.call_id IS NULL THEN 'no call' WHEN c.text IS NULL THEN 'missing field prompt' END AS error,
       '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null'
         ELSE '{"prompt":' || coalesce(CAST(to_json(c.text) AS VARCHAR), 'null') || ',"turn":' || c.turn || '}' END
       || ',"call_id":"' || coalesce(c.call_id, r.call_id) || '","name":'
       || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
       || ',"result":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || '}' AS json
FROM calls c FULL JOIN results r ON c.call_id = r.call_id LEFT JOIN placed p ON p.call_id = c.call_id
"""


@query("op9_tool_calls", OP9_SQL)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Each user turn calls for a reply, using the one before it; the assistant's turn is the result."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").dropna(subset=["conv_id", "turn"])
    named = lambda back: F.concat_ws(":", "conv_id", (F.col("turn") - back).cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"), {"ignoreNullFields": "false"})
    calls = turns.where("role = 'user'").select(
        "conv_id", named(0).alias("call_id"), named(2).alias("after_id"), F.lit("reply").alias("name"), arguments.alias("arguments")
    )
    results = turns.where("role = 'assistant'").select(named(1).alias("call_id"), F.col("text").alias("content"))
    return tool_calls.link(calls, results, spark.sql(REPLY_SCHEMA))


@query("op6_jaccard_join")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.group(table(spark, folder, "documents"))


@query("op12_piece_counts")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    counted = piece_counts.with_counts(documents, public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op13_lexical_search", lexical_search.SQL_TEXT)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.rank(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


@query("op11_prefix_trie", prefix_trie.SQL_TEXT)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    whole = materialize(prefix_trie.sequences(table(spark, folder, "conversations")), "sequences")
    return prefix_trie.nodes(prefix_trie.with_shared_starts(whole))
