"""Transcripts of hosts as JSON lines, metrics as JSON lines, and imports from SQLite stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: How blocks begin that hosts inject into messages, and what echoes of a summariser's prompt hold.
INJECTED = ("<system-reminder>", "<task-notification>", "<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "[Request interrupted")
ECHOES = ("Summarize the session transcript below", "You are compacting a long AI-agent working session", "You are merging several lower-level summaries")


def transcript(spark: SparkSession, path: str, injected=INJECTED, echoes=ECHOES) -> DataFrame:
    """User and assistant messages (file, line, role, content): content is a string or a list of text blocks.

    Lines that are no JSON, injected blocks and empty messages are left out.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    return parse(raw, injected, echoes)


def parse(raw: DataFrame, injected=INJECTED, echoes=ECHOES) -> DataFrame:
    """Messages of a table or stream of lines (value), with all its other columns."""
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    record = raw.withColumn("j", F.try_parse_json("value"))
    rows = record.where(get(F.col("j"), "$.type", "string").isin("user", "assistant") & get(F.col("j"), "$.message.role", "string").isin("user", "assistant"))
    is_text = F.schema_of_variant(get(F.col("j"), "$.message.content", "variant")) == "STRING"
    single = F.array(get(F.col("j"), "$.message.content", "string"))
    # a block is an object of type text, or a plain string
    listed = F.transform(get(F.col("j"), "$.message.content", "array<variant>"), lambda b: F.when(F.schema_of_variant(b) == "STRING", get(b, "$", "string")).when(get(b, "$.type", "string") == "text", get(b, "$.text", "string")))
    blocks = F.filter(F.when(is_text, single).otherwise(listed), lambda t: t.isNotNull() & (t != "") & ~_injected(t, injected, echoes))
    content = F.regexp_replace(F.array_join(blocks, "\n"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    rest = [c for c in raw.columns if c not in ("value", "role", "content")]
    return rows.select(*rest, get(F.col("j"), "$.message.role", "string").alias("role"), content.alias("content")).where("content <> ''")


def _injected(text: Column, prefixes, parts) -> Column:
    bare, found = F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+", ""), F.lit(False)
    for p in prefixes:
        found = found | bare.startswith(p)
    for p in parts:
        found = found | text.contains(p)
    return found


def write_metrics(events: DataFrame, path: str) -> None:
    """Appends events to JSON lines by month; of a query only its length and fingerprint are kept."""
    q = F.col("query")
    rows = events.withColumn("query_len", F.length(q)).withColumn("query_hash", F.substring(F.sha2(q.cast("binary"), 256), 1, 12)).drop("query")
    rows.withColumn("month", F.date_format("ts", "yyyy-MM")).write.partitionBy("month").mode("append").json(path)


class SqliteSource(DataSource):
    """Tables of a SQLite file, split by rowid: options path, table, schema, partitions."""

    @classmethod
    def name(cls):
        return "sqlite_store"

    def schema(self):
        return self.options["schema"]

    def reader(self, schema):
        return SqliteReader(dict(self.options), schema.fieldNames())


class Range(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options_, self.columns = options, columns

    def connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.options_['path']}?mode=ro", uri=True)

    def quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def partitions(self):
        c = self.connect()
        lo, hi = c.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {self.quoted(self.options_['table'])}").fetchone()
        c.close()
        n = max(1, int(self.options_.get("partitions", 4)))
        step = max(1, -(-(hi - lo + 1) // n))
        return [Range(x, min(x + step, hi + 1)) for x in range(lo, hi + 1, step)] or [Range(0, 0)]

    def read(self, partition):
        c = self.connect()
        names = ", ".join(map(self.quoted, self.columns))
        yield from c.execute(f"SELECT {names} FROM {self.quoted(self.options_['table'])} WHERE rowid >= ? AND rowid < ?", (partition.lo, partition.hi))
        c.close()


def project_store(directory: str) -> str:
    """A store's name for a project: a readable slug and eight hexadecimal digits."""
    import hashlib
    import re

    slug = re.sub(r"[^a-z0-9]+", "-", directory.lower()).strip("-")[-40:]
    return f"{slug}-{hashlib.sha256(directory.encode()).hexdigest()[:8]}"
