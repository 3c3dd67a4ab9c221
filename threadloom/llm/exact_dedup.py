"""Exact deduplication with stateful streaming (operator 1, native).

Arriving rows are a log of (digest, stable id, content locator). A Structured Streaming aggregation
keyed by digest folds the log into disk-backed state (the RocksDB store) that never expires: for each
digest the number of arrivals and the largest (doc_id, file, row). The state is then read back as a
table. A digest that arrived more than once is a hit; for hits the full bytes of all members are
compared by the smallest and largest text of each digest, and a digest whose members differ (a
collision) is decided by the texts themselves.

Nothing but DataFrame operations and the streaming engine runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import Scratch, settings

#: Up to this many hit digests (8 bytes each) are broadcast to prefilter the byte comparison.
BROADCAST_HITS = 1_000_000

#: Stores don't allocate disk ahead: with many partitions that would be more than the state itself. All stores of
#: an executor share one bound of memory, outside the heap.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
}


def arrivals(docs: DataFrame, id_col: str, text_col: str, digest=None) -> DataFrame:
    """The log of rows of a file-backed DataFrame: digest, id and locator (file path and row)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        (digest or sha256)(text).alias("digest"),
        F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fold(log: DataFrame) -> DataFrame:
    """The keyed fold, for a stream or a table: one state row for each digest, without expiry."""
    return log.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct("id", "file", "row")).alias("top"),
    )


def run_stream(spark: SparkSession, log_path: str, schema, checkpoint: str, max_files: int | None = None) -> None:
    """Consumes all of the log that has arrived, then stops; a later call goes on from its offsets."""
    with settings(spark, STATE_CONF):
        reader = spark.readStream.schema(schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        query = fold(reader.parquet(log_path)).writeStream.format("noop").outputMode("update")
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def state_table(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, n, top."""
    state = spark.read.format("statestore").load(checkpoint)
    value = state.schema["value"].dataType.fieldNames()
    return state.select(F.col("key.digest").alias("digest"), F.col(f"value.`{value[0]}`").alias("n"), F.col(f"value.`{value[1]}`").alias("top"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=None) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256, file, row.

    Texts are equal if all their bytes are; null counts as empty. Of equal texts the row with the
    largest id stays; among repeated rows with that id, the one with the largest locator. A null id
    is below all others. An empty table gives an empty result. Extra columns of ``docs`` don't
    matter. ``digest`` may be replaced (by tests, with one that collides).

    The full result depends on tables in the scratch folder.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    log, docs = located(docs, id_col, text_col, scratch, digest)
    log = scratch.table(log, "log")
    run_stream(spark, scratch.at("log"), log.schema, scratch.at("stream"))
    with settings(spark, STATE_CONF):
        state = scratch.table(state_table(spark, scratch.at("stream")), "state")
    return decide(docs, id_col, text_col, log, state, scratch, digest)


def located(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch, digest=None) -> tuple[DataFrame, DataFrame]:
    """The log, and ``docs`` in a form whose rows have a locator."""
    from pyspark.errors import AnalysisException

    try:
        return arrivals(docs, id_col, text_col, digest), docs
    except AnalysisException:  # not a plain scan of files: give the rows a place first
        docs = scratch.table(docs.select(id_col, text_col), "content")
        return arrivals(docs, id_col, text_col, digest), docs


def decide(docs, id_col, text_col, log, state, scratch, digest=None) -> DataFrame:
    hits = state.where("n > 1").select("digest")
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    with_digest = docs.select((digest or sha256)(text).alias("digest"), text.alias("text"))
    if hits.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        short = hits.select(F.xxhash64("digest").alias("short"))
        members = with_digest.join(F.broadcast(short), F.xxhash64("digest") == F.col("short"), "left_semi")
    else:
        members = with_digest.join(hits, "digest", "left_semi")
    bad = members.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo <> hi").select("digest")
    bad = scratch.table(bad, "collisions")
    joined = log.join(state, "digest")
    if digest is None and bad.isEmpty():
        return final(joined.select("id", "file", "row", F.col("digest").alias("text_sha256"), F.col("n").alias("group_size"), "top"), id_col)
    full = docs.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), F.col(id_col).alias("id"), text.alias("text"), (digest or sha256)(text).alias("digest"), sha256(text).alias("text_sha256"))
    good = full.join(bad, "digest", "left_anti").join(state, "digest").select("id", "file", "row", "text_sha256", F.col("n").alias("group_size"), "top")
    apart = full.join(bad, "digest", "left_semi")
    by_text = apart.groupBy("text").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "file", "row")).alias("top"))
    return final(good.unionByName(apart.join(by_text, "text").select("id", "file", "row", "text_sha256", "group_size", "top")), id_col)


def final(rows: DataFrame, id_col: str) -> DataFrame:
    kept = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("file") == F.col("top.file")) & (F.col("row") == F.col("top.row"))
    return rows.select(F.col("id").alias(id_col), F.col("top.id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256", "file", "row")


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    scratch = Scratch(docs.sparkSession, "dedup-rows")
    try:
        docs.select("_metadata.row_index")
    except Exception as e:
        from pyspark.errors import AnalysisException

        if not isinstance(e, AnalysisException):
            raise
        docs = scratch.table(docs, "content")
    dropped = dedup(docs, id_col, text_col).where("not kept").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    placed = docs.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    return placed.join(dropped, (F.col("__f") == F.col("__file")) & (F.col("__r") == F.col("__row")), "left_anti").select(*docs.columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
