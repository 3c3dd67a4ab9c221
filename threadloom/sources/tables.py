"""The store's tables, and how the test tables are read as such."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import tokens_div4

SCHEMAS = {
    "conversations": "id BIGINT, session_key STRING, session_id STRING, title STRING, active BOOLEAN, archived_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP",
    "messages": "id BIGINT, conversation_id BIGINT, seq BIGINT, role STRING, content STRING, token_count BIGINT, tool_call_id STRING, tool_name STRING, created_at TIMESTAMP",
    "summaries": "summary_id STRING, conversation_id BIGINT, kind STRING, depth INT, content STRING, token_count BIGINT, source_token_count BIGINT, earliest_at TIMESTAMP, latest_at TIMESTAMP, created_at TIMESTAMP",
    "summary_messages": "summary_id STRING, message_id BIGINT",
    "summary_parents": "parent_id STRING, child_id STRING",
    "context_items": "conversation_id BIGINT, ordinal BIGINT, item_type STRING, message_id BIGINT, summary_id STRING",
    "message_parts": "part_id STRING, message_id BIGINT, part_type STRING, ordinal BIGINT, text_content STRING",
    "large_files": "file_id STRING, conversation_id BIGINT, file_name STRING, mime_type STRING, byte_size BIGINT, storage_uri STRING, summary STRING, created_at TIMESTAMP",
    "embeddings": "id STRING, conversation_id BIGINT, embedding ARRAY<FLOAT>, created_at TIMESTAMP",
}


def read(spark: SparkSession, root: str, name: str, fmt: str = "parquet", **options) -> DataFrame:
    """A stored table: from files below ``root``, or by JDBC with root as the URL."""
    if fmt == "jdbc":
        return spark.read.jdbc(root, name, **options)
    return spark.read.schema(SCHEMAS[name]).format(fmt).options(**options).load(f"{root}/{name}")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages from the test table ``conversations``, whose turns have no time: hours by conversation, minutes by turn."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    content = F.coalesce("text", F.lit(""))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("turn") * 60)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), (F.col("turn") + 1).alias("seq"), "role", content.alias("content"), tokens_div4(content).alias("token_count"), at.alias("created_at"))


def long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages in long conversations, each of ten short ones, so that some get compacted."""
    return sessions(messages(spark, sf_dir), F.floor(F.col("conversation_id") / 10))


def ten_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages in ten conversations, whose length grows with the data."""
    return sessions(messages(spark, sf_dir), F.pmod("conversation_id", F.lit(10)))


def sessions(m: DataFrame, key: Column) -> DataFrame:
    return m.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy("id")).cast("long")).withColumn("conversation_id", key)


MESSAGES_SQL = """messages AS (
  SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, turn + 1 AS seq, role, coalesce(text, '') AS content,
         length(coalesce(text, '')) // 4 AS token_count,
         TIMESTAMP '2024-01-01' + to_seconds(conv_id * 3600 + turn * 60) AS created_at
  FROM conversations)"""
SESSIONS_SQL = MESSAGES_SQL + """, sessions AS (
  SELECT id, conversation_id // 10 AS conversation_id, row_number() OVER (PARTITION BY conversation_id // 10 ORDER BY id) AS seq,
         role, content, token_count, created_at FROM messages)"""
TEN_SESSIONS_SQL = SESSIONS_SQL.replace("conversation_id // 10", "conversation_id % 10")
