"""Queries of the training-text operators and the SQL of those that SQL can express."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from eventloom.llm import conversations, encoding, leakage, near_duplicates, personal_info, reading_level
from eventloom.plans import dealt

#: The folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("EVENTLOOM_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data in the free text of the event feed."""
    return personal_info.personal_info(spark.read.parquet(f"{sf_dir}/session_events.parquet"))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The free text of every delivered event with placeholders for personal data."""
    return personal_info.redacted(spark.read.parquet(f"{sf_dir}/session_events.parquet"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of memory items that state the same with small changes."""
    return near_duplicates.similar_pairs(spark.read.parquet(f"{sf_dir}/memory_items.parquet"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every memory item that has a near-duplicate."""
    return near_duplicates.similar_groups(spark.read.parquet(f"{sf_dir}/memory_items.parquet"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of every sound conversation in order, with their roles."""
    return conversations.conversations(spark.read.parquet(f"{sf_dir}/session_events.parquet"))


def p6_ids(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    ranks = encoding.rank_file(f"{tokenizers}/byte_bpe_50k.tiktoken")
    return encoding.encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks)


def p6_text(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """The text of every document, encoded and decoded again."""
    return encoding.decode_ids(p6_ids(spark, sf_dir, tokenizers), encoding.rank_file(f"{tokenizers}/byte_bpe_50k.tiktoken"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold 12 words in a row of a held-out test item."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leakage.leaked_items(documents, spark.read.parquet(f"{sf_dir}/eval_items.parquet")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document with at least 40 words."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = spark.read.parquet(f"{sf_dir}/reading_labels.parquet"), spark.read.parquet(f"{sf_dir}/eval_items.parquet")
    return reading_level.reading_levels(documents, labels, items=items)


QUERIES = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_groups": p3_groups,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p6_text": p6_text,
    "p7_found": p7_found,
    "p8_found": p8_found,
}
#: The words of a text, each in lower case.
_WORDS = "list_transform(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), lambda w: lower(w))"
_RUNS = "list_distinct(list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' ')))"
SQL = {
    "p5_found": f"""
        WITH repeats AS ({dealt.SQL["p2_found"]}),
        messages AS (
            SELECT delivery_seq, session_id, ordinal, ts, CASE type WHEN 'USER_MESSAGE' THEN 'user' ELSE 'assistant' END AS role FROM session_events
            WHERE type IN ('USER_MESSAGE', 'ASSISTANT_MESSAGE') AND regexp_matches(payload.text, '[\\p{{L}}\\p{{N}}]') AND session_id IS NOT NULL
              AND delivery_seq NOT IN (SELECT delivery_seq FROM repeats)),
        sizes AS (SELECT session_id, count(*) AS n, count(ordinal) AS ordinals, count(ts) AS times FROM messages GROUP BY session_id),
        placed AS (
            SELECT session_id, delivery_seq, role, CASE WHEN ordinals = n THEN ordinal ELSE epoch_us(ts) END AS place
            FROM messages JOIN sizes USING (session_id) WHERE ordinals = n OR times = n),
        turns AS (
            SELECT *, row_number() OVER w AS turn, lag(place) OVER w AS place_before, lag(role) OVER w AS role_before, lead(role) OVER w AS role_after
            FROM placed WINDOW w AS (PARTITION BY session_id ORDER BY place, delivery_seq)),
        unsound AS (
            SELECT DISTINCT session_id FROM turns WHERE place = place_before OR (role = 'user' AND role_before = 'user') OR (role_before IS NULL AND role <> 'user')
                OR (role_after IS NULL AND role <> 'assistant'))
        SELECT session_id, CAST(turn AS INT) AS turn, role, delivery_seq FROM turns WHERE session_id NOT IN (SELECT session_id FROM unsound)""",
    "p6_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p7_found": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        i AS (SELECT item_id, {_WORDS.format("text")} AS ws FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
        of_documents AS (SELECT doc_id, unnest({_RUNS}) AS run FROM d WHERE len(ws) >= 12),
        of_items AS (SELECT item_id, unnest({_RUNS}) AS run FROM i WHERE len(ws) >= 12)
        SELECT DISTINCT doc_id, item_id FROM of_documents JOIN of_items USING (run)""",
}
