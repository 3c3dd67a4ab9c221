"""Queries over streams and versioned tables, with equivalent DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from threadloom.config import SMALL
from threadloom.sources import growing, transcripts
from threadloom.sources.scratch import place
from threadloom.sources.snapshots import Snapshots
from threadloom.sources.tables import MESSAGES_SQL, SESSIONS_SQL, long_sessions, messages
from threadloom.streaming import pressure
from threadloom.streaming.ingest import run_available, upsert_batches

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def grown(lines, folder: str, upto: int):
    """Writes a file for each value of ``file``, as a host would have left it after step ``upto`` of the lines' ``step``.

    A file holds its lines by (step, line); after all but the last step it ends in the first half of the next line.
    """
    files = lines.repartition("file").sortWithinPartitions("file", "step", "line")

    def write(batches):
        system, root = growing.file_system(folder)
        system.create_dir(root, recursive=True)
        out, name, open_ = None, None, False
        for batch in batches:
            for file, step, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if out is not None:
                        out.close()
                    out, name, open_ = system.open_output_stream(f"{root}/{file}.jsonl"), file, True
                if step <= upto:
                    out.write(line.encode() + b"\n")
                elif open_:
                    out.write(line.encode()[: len(line) // 2])
                    open_ = False
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([1], pa.int64())], names=["done"])

    files.select("file", "step", "line").mapInArrow(write, "done long").write.format("noop").mode("overwrite").save()


@query("""SELECT conv_id, turn, role, regexp_replace(regexp_replace(text, '^[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+', ''), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+$', '') AS content
FROM conversations WHERE role IN ('user', 'assistant') AND regexp_matches(text, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]')""")
def transcript_tail(spark, sf):
    """The conversations as transcripts that grow in three steps; a stream reads on after each, from its checkpoint.

    Each file is the transcript of some conversations, so that files grow in number with the table's tasks.
    """
    at = place(spark, "transcripts")
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    line = F.to_json(F.struct(F.col("role").alias("type"), "conv_id", "turn", F.struct("role", F.col("text").alias("content")).alias("message")))
    n = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lines = c.select(F.concat(F.lit("t"), F.pmod(F.xxhash64("conv_id"), F.lit(n)).cast("string")).alias("file"), F.floor(F.col("turn") / 3).cast("int").alias("step"), line.alias("line"))
    for upto in (0, 1, 1 << 30):
        grown(lines, f"{at}/logs", upto)
        rows = growing.once(growing.entries(spark, f"{at}/logs"))
        run_available(rows, upsert_batches(f"{at}/entries"), f"{at}/checkpoint")
    found = transcripts.parse(spark.read.option("basePath", f"{at}/entries").parquet(f"{at}/entries").withColumn("conv_id", F.get_json_object("value", "$.conv_id").cast("long")).withColumn("turn", F.get_json_object("value", "$.turn").cast("long")))
    return found.select("conv_id", "turn", "role", "content")


@query(f"""WITH {MESSAGES_SQL}, v AS (SELECT unnest([1, 2]) AS version)
SELECT version, conversation_id, count(*) AS messages, sum(token_count)::BIGINT AS tokens, max(seq) AS last_seq FROM messages, v WHERE version = 2 OR seq <= 3 GROUP BY ALL""")
def snapshot_versions(spark, sf):
    """A store that takes in the first three messages of each conversation, then the others; both versions are read."""
    store, m = Snapshots(spark, place(spark, "store")), messages(spark, sf)
    for part in ("seq <= 3", "seq > 3"):
        with store.begin() as change:
            rows = m.where(part)
            change.append("messages", rows)
            change.append("conversations", rows.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")))
    sums = [F.count(F.lit(1)).alias("messages"), F.sum("token_count").alias("tokens"), F.max("seq").alias("last_seq")]
    one, two = [store.read("messages", v).groupBy(F.lit(v).alias("version"), "conversation_id").agg(*sums) for v in (1, 2)]
    return one.unionByName(two)


@query(f"""WITH {SESSIONS_SQL}, m AS (SELECT *, max(seq) OVER (PARTITION BY conversation_id) AS n, (seq - 1) // 2 AS k FROM sessions),
l AS (SELECT conversation_id, k, min(seq) AS first_seq, max(seq) AS last_seq, substr(string_agg('[' || role || '] ' || CASE WHEN length(content) > 800 THEN substr(content, 1, 800) || chr(10) || '[cut, 100 tokens]' ELSE content END, chr(10) ORDER BY seq), 1, 8) AS content
  FROM m WHERE 2 * k + 8 <= n GROUP BY 1, 2),
d AS (SELECT conversation_id, k // 2 AS j, min(first_seq) AS first_seq, max(last_seq) AS last_seq, substr(string_agg(content, chr(10) ORDER BY k), 1, 8) AS content FROM l GROUP BY 1, 2 HAVING count(*) = 2)
SELECT conversation_id, 0 AS depth, first_seq::BIGINT AS first_seq, last_seq::BIGINT AS last_seq, 200::BIGINT AS source_token_count, content FROM l
UNION ALL SELECT conversation_id, 1, first_seq::BIGINT, last_seq::BIGINT, 4, content FROM d""")
def pressure_stream(spark, sf):
    """Sessions that arrive in three batches, compacted by a keyed state as they come.

    With 100 tokens a message, each second message from the eighth on brings a conversation to the soft threshold, and
    so one leaf of its two oldest messages; each second leaf brings a node over both.
    """
    from dataclasses import replace

    at, settings = place(spark, "pressure"), replace(SMALL, leaf_chunk_tokens=200, leaf_target_tokens=2, condensed_target_tokens=2)
    rows = long_sessions(spark, sf).withColumn("token_count", F.lit(100).cast("long"))
    before = {k: spark.conf.get(k, None) for k in pressure.STATE_CONF}
    try:
        for k, v in pressure.STATE_CONF.items():
            spark.conf.set(k, v)
        for part in ("seq <= 11", "seq between 12 and 30", "seq > 30"):
            rows.where(part).write.mode("append").parquet(f"{at}/messages")
            nodes = pressure.compacted(spark.readStream.schema(rows.schema).parquet(f"{at}/messages"), settings, 1000)
            run_available(nodes, upsert_batches(f"{at}/nodes"), f"{at}/checkpoint")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    nodes = spark.read.schema(pressure.NODES).parquet(f"{at}/nodes")
    leaf_edges, parent_edges = pressure.edges(nodes)
    spans = leaf_edges.join(rows.select(F.col("id").alias("message_id"), "seq"), "message_id").groupBy("summary_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    above = parent_edges.join(spans, parent_edges.child_id == spans.summary_id).groupBy(F.col("parent_id").alias("summary_id")).agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    return nodes.join(spans.unionByName(above), "summary_id").select("conversation_id", "depth", "first_seq", "last_seq", "source_token_count", "content")
