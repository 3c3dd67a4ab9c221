"""Incremental ingest with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators import folds


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Handles all that has arrived since the last call; offsets move on only after a batch is done."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def upsert_batches(target: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own, so that a repeated batch overwrites itself."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return each


def new_rows(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming rows of each conversation without the prefix that repeats the end of what is stored."""
    n = folds.overlap(stored, incoming)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("conversation_id").orderBy("seq"))
    return incoming.withColumn("__n", place).join(n, "conversation_id").where(F.col("__n") > F.col("drop")).drop("__n", "drop")


def pressure(messages: DataFrame, limit: int, soft: float = 0.75, hard: float = 0.85) -> DataFrame:
    """A stream's (or table's) tokens and urgency of each conversation; on a stream the sums are its state."""
    from threadloom.operators.compaction import urgency

    sums = messages.groupBy("conversation_id").agg(F.sum("token_count").alias("tokens"))
    return sums.withColumn("urgency", urgency(F.col("tokens"), limit, soft, hard))


def hash_embedding(texts: list[str], dim: int) -> list[list[float]]:
    """A deterministic stand-in for an embedding model: signed counts of hashed words, of length 1."""
    import hashlib
    import math

    out = []
    for t in texts:
        v = [0.0] * dim
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / norm for x in v])
    return out


def backfill(messages: DataFrame, embedded: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """Vectors of the messages that are not blank and have none; a batch that fails has null vectors (see ``settled``)."""
    todo = messages.where(F.col("content").rlike(r"(?U)\S")).join(embedded.select("id"), "id", "left_anti").select("id", "conversation_id", "content")
    schema = T.StructType([todo.schema["id"], todo.schema["conversation_id"], T.StructField("embedding", T.ArrayType(T.FloatType()))])

    def run(frames):
        for f in frames:
            for i in range(0, len(f), batch):
                part = f.iloc[i : i + batch]
                try:
                    vectors = embed(list(part["content"]))
                except Exception:  # the embedder is a caller's: its failure is counted, not raised
                    vectors = [None] * len(part)
                yield part[["id", "conversation_id"]].assign(embedding=vectors)

    return todo.mapInPandas(run, schema)


def settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a backfill: the rows to store, and the number of failures by conversation. Failed messages stay to be embedded."""
    failed = rows.where("embedding is null").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("failed"))
    return rows.where("embedding is not null"), failed


def event_state(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, target: str, per_trigger: int | None = None) -> DataFrame:
    """Running count and last time of events by user: streaming state, whose changes each batch adds to a table.

    A batch that is repeated overwrites its own folder; of each user the last batch counts.
    """
    from threadloom.operators.store import latest

    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    state = reader.parquet(path).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_ts"))
    writer = state.writeStream.outputMode("update").foreachBatch(upsert_batches(target))
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(target), "user_id", "batch")
