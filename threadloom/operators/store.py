"""Scans, writers and lookups of the store as functions of DataFrames.

Stored tables are immutable files: updates are appended rows and a latest-wins view, deletes are anti joins.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.functions.text import derived_id


def scan(messages: DataFrame, conversation_id: int, after_seq: int | None = None, limit: int | None = None) -> DataFrame:
    rows = messages.where(F.col("conversation_id") == conversation_id)
    if after_seq is not None:
        rows = rows.where(F.col("seq") > after_seq)
    rows = rows.orderBy("seq")
    return rows if limit is None else rows.limit(limit)


def by_conversation(table: DataFrame, conversation_id: int, *order: str, depth: int | None = None) -> DataFrame:
    rows = table.where(F.col("conversation_id") == conversation_id)
    return (rows if depth is None else rows.where(F.col("depth") == depth)).orderBy(*order)


def in_range(rows: DataFrame, since=None, before=None, column: str = "created_at") -> DataFrame:
    """since <= column < before."""
    if since is not None:
        rows = rows.where(F.col(column) >= F.lit(since))
    return rows if before is None else rows.where(F.col(column) < F.lit(before))


def get_or_create(conversations: DataFrame, keys: DataFrame, at) -> DataFrame:
    """Rows to append: a conversation for each session_key without an active one, with the least title given.

    ``at`` is the time of creation (a column or literal). The id follows from key and time, so that the
    same plan run again makes the same rows.
    """
    at = at if isinstance(at, Column) else F.lit(at).cast("timestamp")
    new = keys.groupBy("session_key").agg(F.min("title").alias("title")).join(conversations.where("active"), "session_key", "left_anti")
    return new.select(F.xxhash64("session_key", at).alias("id"), "session_key", "title", F.lit(True).alias("active"), at.alias("created_at"))


def deactivate(conversations: DataFrame, ids: list[int]) -> DataFrame:
    hit = F.col("id").isin(*ids)
    return conversations.withColumn("active", F.col("active") & ~hit).withColumn("updated_at", F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at")))


def append_messages(stored: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """``new`` with seq going on from the stored maximum of each conversation (0 if it has none)."""
    last = stored.groupBy("conversation_id").agg(F.max("seq").alias("last_seq"))
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy(order))
    return new.withColumn("n", n).join(last, "conversation_id", "left").withColumn("seq", F.coalesce("last_seq", F.lit(0)) + F.col("n")).drop("n", "last_seq")


def latest(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(version)).alias("x")).select(key, "x.*")


def upsert_vectors(stored: DataFrame, new: DataFrame, version: str = "created_at") -> DataFrame:
    """The stored rows, where an id that comes again gets the new vector only, and the new ids.

    Of an id that is twice in ``new`` the last by ``version`` counts, or without such a column the greatest vector.
    """
    new = latest(new, "id", version if version in new.columns else "embedding")
    change = new.select("id", F.col("embedding").alias("changed"))
    kept = stored.join(change, "id", "left").withColumn("embedding", F.coalesce("changed", "embedding")).drop("changed")
    return kept.unionByName(new.join(stored, "id", "left_anti"), allowMissingColumns=True)


def ids_present(vectors: DataFrame, conversation_id: int | None = None) -> DataFrame:
    rows = vectors if conversation_id is None else vectors.where(F.col("conversation_id") == conversation_id)
    return rows.select("id").distinct()


def delete(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids, key, "left_anti")


def add_items(items: DataFrame, new: DataFrame, kind: str, order: str) -> DataFrame:
    """``items`` and new ones (conversation_id, message_id or summary_id), placed after the last of each conversation."""
    last = items.groupBy("conversation_id").agg(F.max("ordinal").alias("last"))
    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy(order)) + F.coalesce("last", F.lit(0))
    rows = new.join(last, "conversation_id", "left").withColumn("ordinal", place.cast("long"))
    key = f"{kind}_id"
    return items.unionByName(rows.select("conversation_id", "ordinal", F.lit(kind).alias("item_type"), key), allowMissingColumns=True)


def parts_of(parts: DataFrame, message_id: int | None = None, part_type: str | None = None) -> DataFrame:
    rows = parts if message_id is None else parts.where(F.col("message_id") == message_id)
    return (rows if part_type is None else rows.where(F.col("part_type") == part_type)).orderBy("message_id", "ordinal")


def delete_parts(parts: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays without the parts of the given messages (message_id), and how many of each go."""
    return parts.join(messages, "message_id", "left_anti"), parts.join(messages, "message_id", "left_semi").groupBy("message_id").agg(F.count(F.lit(1)).alias("deleted"))


def replace_with_summary(items: DataFrame, summary_id: str, message_ids: DataFrame) -> DataFrame:
    """Context items where the given messages (message_id) make room for one summary, at the place of the first."""
    hit = items.join(message_ids.select("message_id").distinct(), "message_id", "left_semi")
    place = hit.groupBy("conversation_id").agg(F.min("ordinal").alias("ordinal"))
    added = place.select("conversation_id", "ordinal", F.lit("summary").alias("item_type"), F.lit(None).cast("long").alias("message_id"), F.lit(summary_id).alias("summary_id"))
    return items.join(message_ids.select("message_id").distinct(), "message_id", "left_anti").unionByName(added)


def create_condensed(children: DataFrame, *group: str, content: Callable[[Column, Column], Column]) -> DataFrame:
    """A parent for each group of summaries: one level above the deepest child, with the sum of their tokens.

    ``content`` makes its text of the children's, joined in order of time, and of that sum.
    """
    ordered = F.array_sort(F.collect_list(F.struct("created_at", "summary_id", "content", "earliest_at", "latest_at")))
    rows = children.groupBy(*group).agg(ordered.alias("c"), (F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("depth"), F.sum("token_count").alias("source_token_count"))
    text = content(F.array_join(F.transform("c", lambda x: x.content), "\n"), F.col("source_token_count"))
    ids = F.transform("c", lambda x: x.summary_id)
    return rows.select(*group, derived_id("sum_", 12, F.array_join(ids, ",")).alias("summary_id"), F.lit("condensed").alias("kind"), "depth", text.alias("content"), F.floor(F.length(text) / 4).alias("token_count"), "source_token_count", F.element_at("c", 1).earliest_at.alias("earliest_at"), F.element_at("c", -1).latest_at.alias("latest_at"), F.element_at("c", -1).created_at.alias("created_at"), ids.alias("child_ids"))


def large_content(rows: DataFrame, limit: int = 25_000) -> DataFrame:
    """Contents of ``limit`` tokens or more give way to a reference, and are listed in ``stored`` for a file writer."""
    big = F.col("token_count") >= limit
    file_id = derived_id("file_", 16, F.col("id"), F.col("content"))
    return rows.withColumn("stored", F.when(big, F.struct(file_id.alias("file_id"), F.col("content")))).withColumn("content", F.when(big, F.concat(F.lit("[stored as "), file_id, F.lit("]"))).otherwise(F.col("content")))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes what ``large_content`` set aside, as Parquet by file id, and returns the rows of large_files."""
    files = rows.where("stored is not null").select("stored.file_id", "conversation_id", F.length("stored.content").cast("long").alias("byte_size"), F.concat(F.lit(folder + "/file_id="), "stored.file_id").alias("storage_uri"), F.substring("stored.content", 1, 200).alias("summary"), "stored.content", "created_at").dropDuplicates(["file_id"])
    files.select("file_id", "content").write.mode("overwrite").parquet(folder)
    return files.drop("content")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """The rows of large_files with their contents; null where the content is gone."""
    return files.join(files.sparkSession.read.schema("file_id string, content string").parquet(folder), "file_id", "left").orderBy("created_at", "file_id")


def missing_dimension(rows: DataFrame, dim: int) -> Column:
    """An assertion column that fails loudly on a vector of another size."""
    return F.assert_true(F.size("embedding") == dim, F.lit(f"vectors must have {dim} dimensions"))
