"""Import of another host's SQLite store: its tables under new ids, in this store's shape.

New ids follow from a label of the source and the old id, so that an import run again gives the same rows.
"""

from __future__ import annotations

import sqlite3

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import index
from threadloom.sources.transcripts import SqliteSource

#: The foreign tables and their columns.
FOREIGN = {
    "conversations": "conversation_id BIGINT, session_key STRING, title STRING, created_at STRING, updated_at STRING",
    "messages": "message_id BIGINT, conversation_id BIGINT, seq BIGINT, role STRING, content STRING, token_count BIGINT, created_at STRING",
    "message_parts": "rowid BIGINT, message_id BIGINT, tool_call_id STRING, tool_name STRING",
    "summaries": "summary_id STRING, conversation_id BIGINT, kind STRING, depth INT, content STRING, token_count BIGINT, earliest_at STRING, latest_at STRING, source_message_token_count BIGINT, created_at STRING",
    "summary_messages": "summary_id STRING, message_id BIGINT",
    "summary_parents": "summary_id STRING, parent_summary_id STRING",
}


def _has_columns(path: str, table: str) -> bool:
    c = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    have = {row[1] for row in c.execute(f"PRAGMA table_info({table})")}
    c.close()
    return {"message_id", "tool_call_id", "tool_name"} <= have


def read(spark: SparkSession, path: str, table: str, partitions: int = 4) -> DataFrame:
    """A table of the foreign file, split by rowid; executors must reach the path."""
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_store").options(path=path, table=table, schema=FOREIGN[table], partitions=str(partitions)).load()


def convert(tables: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """This store's tables from foreign ones; ``message_parts`` may be missing.

    Rows of unknown conversations and links to unknown messages are left out, repeated links count once. Of a
    message's parts that name a tool the last counts. In the foreign ``summary_parents`` the child is called parent.
    """
    new_id = lambda c: F.xxhash64(F.lit(label), F.col(c))
    at = lambda c: F.expr(f"try_cast({c} AS TIMESTAMP)").alias(c)
    number = lambda c: F.coalesce(c, F.lit(0))
    known = tables["conversations"].select("conversation_id").distinct()
    conversations = tables["conversations"].select(new_id("conversation_id").alias("id"), "session_key", F.coalesce("title", F.lit("")).alias("title"), F.lit(True).alias("active"), at("created_at"), at("updated_at"))
    old = tables["messages"].join(known, "conversation_id", "left_semi")
    if "message_parts" in tables:
        named = tables["message_parts"].where("tool_call_id is not null or tool_name is not null")
        old = old.join(named.groupBy("message_id").agg(F.max_by(F.struct("tool_call_id", "tool_name"), "rowid").alias("tool")), "message_id", "left")
    else:
        old = old.withColumn("tool", F.lit(None).cast("struct<tool_call_id: string, tool_name: string>"))
    messages = old.select(new_id("message_id").alias("id"), new_id("conversation_id").alias("conversation_id"), "seq", "role", _text("content"), number("token_count").alias("token_count"), "tool.tool_call_id", "tool.tool_name", at("created_at"))
    kept = tables["summaries"].join(known, "conversation_id", "left_semi")
    summaries = kept.select("summary_id", new_id("conversation_id").alias("conversation_id"), "kind", number("depth").alias("depth"), _text("content"), number("token_count").alias("token_count"), number("source_message_token_count").alias("source_token_count"), at("earliest_at"), at("latest_at"), at("created_at"))
    leaf_links = tables["summary_messages"].join(old.select("message_id"), "message_id", "left_semi").join(kept.select("summary_id"), "summary_id", "left_semi")
    parents = tables["summary_parents"].select(F.col("summary_id").alias("parent_id"), F.col("parent_summary_id").alias("child_id"))
    for end in ("parent_id", "child_id"):
        parents = parents.join(kept.select(F.col("summary_id").alias(end)), end, "left_semi")
    return {
        "conversations": conversations,
        "messages": messages,
        "summaries": summaries,
        "summary_messages": leaf_links.select("summary_id", new_id("message_id").alias("message_id")).distinct(),
        "summary_parents": parents.select("parent_id", "child_id").distinct(),
    }


def _text(column: str) -> Column:
    return F.coalesce(column, F.lit("")).alias(column)


def import_store(spark: SparkSession, path: str, label: str | None = None, partitions: int = 4) -> dict[str, DataFrame]:
    """This store's tables out of a foreign file; ``label`` tells sources apart (the path by default)."""
    names = [t for t in FOREIGN if t != "message_parts" or _has_columns(path, t)]
    return convert({t: read(spark, path, t, partitions) for t in names}, label or path)


def statistics(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, depth, kind, rows, tokens) of imported tables, summaries by depth and kind."""
    out = None
    for name, t in tables.items():
        keys = ["depth", "kind"] if name == "summaries" else []
        tokens = F.coalesce(F.sum("token_count"), F.lit(0)).cast("long") if "token_count" in t.columns else F.lit(None).cast("long")
        n = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), tokens.alias("tokens"))
        for k, kind in (("depth", "int"), ("kind", "string")):
            n = n if k in keys else n.withColumn(k, F.lit(None).cast(kind))
        n = n.select(F.lit(name).alias("name"), "depth", "kind", "rows", "tokens")
        out = n if out is None else out.unionByName(n)
    return out


def rebuild_index(tables: dict[str, DataFrame], path: str) -> None:
    """Full-text indexes of imported messages and summaries, written anew."""
    index.build(tables["messages"], "id", "content", f"{path}/messages")
    index.build(tables["summaries"], "summary_id", "content", f"{path}/summaries")
