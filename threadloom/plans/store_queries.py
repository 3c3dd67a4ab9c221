"""Queries over the store's tables and the scalars, with equivalent DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.config import SMALL
from threadloom.functions import english
from threadloom.functions import text as X
from threadloom.operators import aggregates, assemble, cells, compaction, dag, folds, grams, index, integrity, recall, store
from threadloom.sources.scratch import place
from threadloom.sources.snapshots import Snapshots
from threadloom.sources.tables import MESSAGES_SQL, SESSIONS_SQL, TEN_SESSIONS_SQL, long_sessions, messages, ten_sessions

QUERIES: dict = {}
ORACLES: dict = {}
M, S = "WITH " + MESSAGES_SQL, "WITH " + SESSIONS_SQL
AT = "2024-03-01 00:00:00"
ENGLISH = "the whst of onings"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@query(S + " SELECT id, seq, role FROM sessions WHERE conversation_id = 3 AND seq > 5 ORDER BY seq LIMIT 15")
def message_scan(spark, sf):
    return store.scan(long_sessions(spark, sf), 3, after_seq=5, limit=15).select("id", "seq", "role")


@query("SELECT 's' || s_suppkey AS summary_id, s_nationkey::BIGINT AS conversation_id, 0 AS depth FROM supplier WHERE s_nationkey = 7")
def summary_scan(spark, sf):
    """Suppliers stand for summaries, their nations for conversations."""
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("s"), "s_suppkey").alias("summary_id"), F.col("s_nationkey").cast("long").alias("conversation_id"), F.lit(0).alias("depth"))
    return store.by_conversation(rows, 7, "summary_id", depth=0)


@query(f"""{M}, old AS (SELECT conv_id % 40 AS k, conv_id % 3 > 0 AS active FROM conversations GROUP BY ALL), want AS (SELECT DISTINCT conv_id % 60 AS k FROM conversations)
SELECT 'session ' || k AS session_key, 'title ' || k AS title, true AS active, TIMESTAMP '{AT}' AS created_at FROM want WHERE k NOT IN (SELECT k FROM old WHERE active)""")
def conversation_create(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    key = lambda n: F.concat(F.lit("session "), (F.col("conv_id") % n).cast("string"))
    old = c.select(key(40).alias("session_key"), (F.col("conv_id") % 3 > 0).alias("active")).distinct()
    new = c.select(key(60).alias("session_key"), F.concat(F.lit("title "), (F.col("conv_id") % 60).cast("string")).alias("title"))
    return store.get_or_create(old, new, AT).select("session_key", "title", "active", "created_at")


@query(M + " SELECT id, conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS seq FROM messages")
def message_append(spark, sf):
    """The first two messages of each conversation are stored, the others are appended."""
    m = messages(spark, sf)
    fresh = store.append_messages(m.where("seq <= 2"), m.where("seq > 2").drop("seq"), "id")
    return m.where("seq <= 2").select("id", "conversation_id", "seq").unionByName(fresh.select("id", "conversation_id", F.col("seq").cast("long").alias("seq")))


@query("SELECT DISTINCT conv_id AS id, conv_id NOT IN (1, 4, 9) AS active, conv_id IN (1, 4, 9) AS changed FROM conversations")
def conversation_deactivate(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("id"), F.lit(True).alias("active"), F.lit(None).cast("timestamp").alias("updated_at")).distinct()
    return store.deactivate(c, [1, 4, 9]).select("id", "active", F.col("updated_at").isNotNull().alias("changed"))


@query("SELECT vec_id AS id, label::BIGINT AS conversation_id, CASE WHEN vec_id % 3 = 0 THEN 2.0 WHEN vec_id % 5 = 0 THEN 1.0 ELSE round(embedding[1]::DOUBLE, 5) END AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 15 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0")
def vector_upsert(spark, sf):
    """Even ids are stored; those divisible by five come once, those by three twice, and the later vector counts."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("conversation_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    new = lambda df, x, at: df.withColumn("embedding", F.array(F.lit(x))).withColumn("created_at", F.lit(at))
    changes = new(e.where("id % 3 = 0 or id % 5 = 0"), 1.0, 1).union(new(e.where("id % 3 = 0"), 2.0, 2))
    return store.upsert_vectors(e.where("id % 2 = 0"), changes).select("id", "conversation_id", F.round(F.element_at("embedding", 1), 5).alias("first"))


@query("SELECT label::BIGINT AS conversation_id, count(*) AS n FROM embeddings WHERE vec_id % 4 <> 1 GROUP BY 1")
def vector_delete_count(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("conversation_id"))
    return store.delete(e, e.where("id % 4 = 1").select("id"), "id").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT vec_id AS id FROM embeddings WHERE label = 2")
def vector_ids_present(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("conversation_id"))
    return store.ids_present(e.union(e), 2)


@query(S + ", hit AS (SELECT min(seq) AS pos FROM sessions WHERE conversation_id = 2 AND id % 3 = 0) SELECT conversation_id, seq AS ordinal, 'message' AS item_type, id AS message_id, NULL::VARCHAR AS summary_id FROM sessions WHERE NOT (conversation_id = 2 AND id % 3 = 0) UNION ALL SELECT 2, pos, 'summary', NULL, 'sum_new' FROM hit WHERE pos IS NOT NULL UNION ALL SELECT conversation_id, max(seq) + 1, 'summary', NULL, 'sum_late' FROM sessions GROUP BY 1")
def context_items(spark, sf):
    """All messages as items; some of one conversation give way to a summary; one more summary comes last in each."""
    rows = long_sessions(spark, sf)
    empty = spark.createDataFrame([], "conversation_id long, ordinal long, item_type string, message_id long, summary_id string")
    items = store.add_items(empty, rows.select("conversation_id", F.col("id").alias("message_id"), "seq"), "message", "seq")
    late = rows.select("conversation_id").distinct().withColumn("summary_id", F.lit("sum_late"))
    items = store.add_items(items, late, "summary", "summary_id")
    ids = rows.where("conversation_id = 2 and id % 3 = 0").select(F.col("id").alias("message_id"))
    out = store.replace_with_summary(items, "sum_new", ids)
    return out.select("conversation_id", "ordinal", "item_type", "message_id", "summary_id")


def parts(spark, sf):
    """The paragraphs of messages as their parts, of two types by turns."""
    m = messages(spark, sf).select(F.col("id").alias("message_id"), F.posexplode(F.split("content", "\\. ")).alias("ordinal", "text_content"))
    return m.select(F.concat_ws("-", "message_id", "ordinal").alias("part_id"), "message_id", F.when(F.col("ordinal") % 2 == 0, "text").otherwise("tool").alias("part_type"), F.col("ordinal").cast("long").alias("ordinal"), "text_content")


PARTS_SQL = M + ", p0 AS (SELECT id AS message_id, string_split(content, '. ') AS p FROM messages), parts AS (SELECT message_id || '-' || (i - 1) AS part_id, message_id, CASE WHEN i % 2 = 1 THEN 'text' ELSE 'tool' END AS part_type, (i - 1)::BIGINT AS ordinal, p[i] AS text_content FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM p0))"


@query(PARTS_SQL + " SELECT * FROM parts WHERE part_type = 'tool'")
def message_parts(spark, sf):
    return store.parts_of(parts(spark, sf), part_type="tool")


@query(PARTS_SQL + " SELECT message_id, count(*) FILTER (WHERE message_id % 4 <> 0) AS kept, count(*) FILTER (WHERE message_id % 4 = 0) AS deleted FROM parts GROUP BY 1")
def message_parts_delete(spark, sf):
    """Parts kept and deleted by message; each message has one kind only."""
    p, zero = parts(spark, sf), F.lit(0).cast("long")
    kept, deleted = store.delete_parts(p, p.where("message_id % 4 = 0").select("message_id").distinct())
    kept = kept.groupBy("message_id").agg(F.count(F.lit(1)).alias("kept"))
    return kept.join(deleted, "message_id", "full").select("message_id", F.coalesce("kept", zero).alias("kept"), F.coalesce("deleted", zero).alias("deleted"))


@query(M + " SELECT 'file_' || substr(sha256(id || ':' || content), 1, 16) AS file_id, conversation_id, length(content) AS byte_size, sha256(content) AS digest FROM messages WHERE token_count >= 60")
def large_files(spark, sf):
    """Contents of sixty tokens or more are written aside and read again."""
    folder = place(spark, "files")
    files = store.write_files(store.large_content(messages(spark, sf), 60), folder)
    return store.read_files(files, folder).select("file_id", "conversation_id", "byte_size", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


@query(M + " SELECT id, CASE WHEN token_count >= 60 THEN '[stored as file_' || substr(sha256(id || ':' || content), 1, 16) || ']' ELSE content END AS content FROM messages")
def large_content(spark, sf):
    return store.large_content(messages(spark, sf), 60).select("id", "content")


@query("SELECT 'n' || n_nationkey AS summary_id, 's' || s_suppkey AS child FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def condensed_children(spark, sf):
    from threadloom.plans.queries import families

    nodes, edges = families(spark, sf)
    return dag.children(edges, nodes).where("depth = 0").select(F.col("parent_id").alias("summary_id"), F.col("summary_id").alias("child"))


@query("SELECT page_id FROM pages WHERE url ILIKE '%EN%' OR html ILIKE '%EN%'")
def like_columns(spark, sf):
    return recall.like(spark.read.parquet(f"{sf}/pages.parquet"), ["url", "html"], "EN").select("page_id")


def beats(spark, sf):
    """Conversations in which every second turn and those after it look like heartbeats, most of them complete."""
    m = long_sessions(spark, sf)
    step = F.col("seq") % 5
    role = F.when(step == 1, "user").when(step == 2, "tool").when(step == 3, "assistant").otherwise("user")
    content = F.when(step == 1, F.lit("read heartbeat.md now")).when(step == 2, F.lit("output")).when((step == 3) & (F.col("seq") % 3 > 0), F.lit(" Heartbeat_OK ")).otherwise(F.lit("something else"))
    return m.withColumn("role", role).withColumn("content", content).withColumn("tool_call_id", F.lit(None).cast("string"))


@query(S + ", n AS (SELECT *, max(seq) OVER (PARTITION BY conversation_id) AS last FROM sessions) SELECT conversation_id, id FROM n WHERE seq % 5 IN (1, 2, 3) AND (seq - seq % 5 + 3) % 3 > 0 AND seq - seq % 5 + 3 <= last")
def heartbeat_cycles(spark, sf):
    return folds.heartbeats(beats(spark, sf)).select("conversation_id", "id")


@query(S + ", n AS (SELECT *, max(seq) OVER (PARTITION BY conversation_id) AS last FROM sessions) SELECT conversation_id, id FROM n WHERE NOT (seq % 5 IN (1, 2, 3) AND (seq - seq % 5 + 3) % 3 > 0 AND seq - seq % 5 + 3 <= last)")
def heartbeat_prune(spark, sf):
    rows = beats(spark, sf)
    return store.delete(rows, folds.heartbeats(rows).select("id"), "id").select("conversation_id", "id")


@query(S + """, t AS (SELECT *, seq % 4 AS k, conversation_id || '-' || ((seq + 1) // 4) AS call FROM sessions), c AS (SELECT * FROM t WHERE k = 3), r AS (SELECT * FROM t WHERE k = 0 AND seq % 3 > 0),
o AS (SELECT id, conversation_id, seq AS pos, 0 AS sub, CASE WHEN k = 3 THEN call END AS tool_call_id FROM t WHERE NOT (k = 0 AND seq % 3 > 0)
  UNION ALL SELECT coalesce(r.id, -1), c.conversation_id, c.seq, 1, c.call FROM c LEFT JOIN r ON r.conversation_id = c.conversation_id AND r.call = c.call)
SELECT id, conversation_id, pos, sub, tool_call_id FROM o""")
def transcript_repair(spark, sf):
    """Each fourth message but one calls a tool; the next is its result or, each third time, another message."""
    m = long_sessions(spark, sf)
    k = F.col("seq") % 4
    result = (k == 0) & (F.col("seq") % 3 > 0)
    call = F.concat_ws("-", "conversation_id", F.floor((F.col("seq") + 1) / 4))
    m = m.withColumn("role", F.when(k == 3, "assistant").when(result, "tool").otherwise("user")).withColumn("tool_call_id", F.when((k == 3) | result, call)).withColumn("tool_name", F.when(k == 3, F.lit("f")))
    out = folds.repair_transcript(m.select("id", "conversation_id", "seq", "role", "content", "token_count", "tool_call_id", "tool_name", "created_at"))
    return out.select("id", "conversation_id", F.col("place.at").alias("pos"), F.col("place.sub").alias("sub"), "tool_call_id")


@query(S + " SELECT count(DISTINCT conversation_id) AS conversations, count(*) AS messages, sum(token_count)::BIGINT AS tokens FROM sessions")
def store_stats(spark, sf):
    per = aggregates.totals(long_sessions(spark, sf), "conversation_id")
    return per.agg(F.count(F.lit(1)).alias("conversations"), F.sum("messages").alias("messages"), F.sum("tokens").alias("tokens"))


@query("""WITH w AS (SELECT unnest(['la', 'the', 'des']) AS word, unnest([0, 1, 2]) AS k), t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\\p{L}\\p{N}]+') AS t FROM documents),
n AS (SELECT doc_id, k, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM t, w WHERE list_contains(t, word) QUALIFY n <= 20)
SELECT doc_id AS id, count(*) AS matches FROM n GROUP BY 1 ORDER BY matches DESC, min(k * 1000 + n) LIMIT 10""")
def relaxed_search(spark, sf):
    d = docs(spark, sf).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content"))
    return recall.any_keyword(d, ["la", "the", "des"], 10).select("id", "matches")


#: Messages of ``sessions`` from the latest back, of which each that fits what is left of 200 tokens is kept.
FILL_SQL = """, s AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS k FROM sessions),
f AS (SELECT conversation_id, k, id, token_count AS used, token_count <= 200 AS keep FROM s WHERE k = 1
  UNION ALL SELECT s.conversation_id, s.k, s.id, CASE WHEN (CASE WHEN f.keep OR f.k > 1 THEN f.used ELSE 0 END) + s.token_count > 200 THEN (CASE WHEN f.keep OR f.k > 1 THEN f.used ELSE 0 END) ELSE (CASE WHEN f.keep OR f.k > 1 THEN f.used ELSE 0 END) + s.token_count END, (CASE WHEN f.keep OR f.k > 1 THEN f.used ELSE 0 END) + s.token_count <= 200 FROM f JOIN s ON s.conversation_id = f.conversation_id AND s.k = f.k + 1)
SELECT conversation_id, id FROM f WHERE keep"""


@query("WITH RECURSIVE " + TEN_SESSIONS_SQL + FILL_SQL)
def bootstrap_messages(spark, sf):
    """A new session without summaries takes over the latest messages that fit; ten sessions, whose length grows with the data."""
    return _bootstrap(spark, ten_sessions(spark, sf))


@query("WITH RECURSIVE " + SESSIONS_SQL + FILL_SQL)
def bootstrap_many_sessions(spark, sf):
    """The same for sessions of ten conversations, whose number grows with the data."""
    return _bootstrap(spark, long_sessions(spark, sf))


def _bootstrap(spark, sessions):
    none = spark.createDataFrame([], "summary_id string, conversation_id long, depth int, token_count long, created_at timestamp")
    return assemble.bootstrap(none, sessions, 200)[1].select("conversation_id", "id")


@query(S + ", t AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 3) SELECT conversation_id, string_agg('[' || role || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY seq) AS context FROM t GROUP BY 1")
def context_rendered(spark, sf):
    none = spark.createDataFrame([], "conversation_id long, place int, depth int, content string")
    return assemble.rendered(none, folds.tail(long_sessions(spark, sf), 3))


@query(M + " SELECT id, CASE WHEN length(content) <= 80 THEN content ELSE substr(content, 1, 80) || chr(10) || '[truncated]' END AS short FROM messages")
def truncate_summary(spark, sf):
    return messages(spark, sf).select("id", X.truncated(F.col("content"), 80).alias("short"))


@query(M + " SELECT id, CASE WHEN id % 2 = 0 AND content = '' THEN 'Do this. <content>  </content> End.' WHEN id % 2 = 0 THEN trim(content) ELSE content END AS inner_text FROM messages")
def tagged_content(spark, sf):
    c = F.when(F.col("id") % 2 == 0, F.concat(F.lit("Do this. <content> "), "content", F.lit(" </content> End."))).otherwise(F.col("content"))
    return messages(spark, sf).select("id", X.tagged(c, "content").alias("inner_text"))


E1, E2 = "CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN substr(content, 1, 300) ELSE content || '!' || content END", "CASE WHEN id % 4 = 2 THEN substr(content, 1, 40) ELSE content || content END"


@query(M + f""", t AS (SELECT id, content AS c, {E1} AS a, {E2} AS b0 FROM messages), u AS (SELECT *, CASE WHEN a IS NOT NULL THEN b0 END AS b FROM t)
SELECT id, substr(CASE WHEN length(a) // 4 < length(c) // 4 THEN a WHEN length(b) // 4 < length(c) // 4 THEN b ELSE substr(coalesce(b, c), 1, 80) || ' [Truncated from ' || (length(c) // 4) || ' tokens]' END, 1, 240) AS summary FROM u""")
def escalate(spark, sf):
    """A summariser that fails, is good, or is too long at first and good or bad at the second try, by turns."""
    m, c, k = messages(spark, sf), F.col("content"), F.col("id") % 4
    first = F.when(k == 0, F.lit(None)).when(k == 1, F.substring(c, 1, 300)).otherwise(F.concat(c, F.lit("!"), c))
    second = F.when(k == 2, F.substring(c, 1, 40)).otherwise(F.concat(c, c))
    return m.select("id", compaction.escalated(c, first, second, 20).alias("summary"))


@query(M + """, c AS (SELECT id, id % 4 AS k, content, regexp_matches(content, '[^\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]') AS filled FROM messages)
SELECT id, CASE k WHEN 0 THEN CASE WHEN filled THEN content ELSE '' END WHEN 1 THEN CASE WHEN filled THEN content || chr(10) || 'x' ELSE 'x' END WHEN 2 THEN CASE WHEN filled THEN content || chr(10) || content ELSE '' END ELSE 'plain: ' || content END AS extracted FROM c""")
def json_text(spark, sf):
    c, k = F.col("content"), F.col("id") % 4
    raw = (
        F.when(k == 0, F.to_json(F.struct(F.struct(c.alias("text")).alias("message"), F.lit("no").alias("value"))))
        .when(k == 1, F.to_json(F.struct(F.struct(F.array(c, F.lit("x")).alias("segments")).alias("payload"), F.lit(7).alias("n"))))
        .when(k == 2, F.concat(F.lit("["), F.to_json(F.struct(c.alias("transcript"))), F.lit(", "), F.to_json(F.struct(c.alias("other"))), F.lit("]")))
        .otherwise(F.concat(F.lit("plain: "), c))
    )
    return messages(spark, sf).select("id", X.json_text_column(raw).alias("extracted"))


@query(M + """, n AS (SELECT id, content, coalesce(lead(content) OVER (PARTITION BY conversation_id ORDER BY seq), content) AS later FROM messages),
p AS (SELECT id, lower(later) AS later, lower(content) AS content, regexp_split_to_array(lower(substr(content, 1, 60)), '\\s+') AS w FROM n)
SELECT id, contains(later, substr(content, 1, 60)) OR len(list_filter(w, lambda x: contains(later, x))) >= len(w) * 0.7 AS found FROM p""")
def verbatim_recovery(spark, sf):
    """Whether the beginning of a message is found in the next one, word for word or by seven tenths of its words."""
    w = Window.partitionBy("conversation_id").orderBy("seq")
    m = messages(spark, sf).withColumn("later", F.coalesce(F.lead("content").over(w), "content"))
    return m.select("id", X.recovered(F.substring("content", 1, 60), F.col("later")).alias("found"))


@query(M + r" SELECT id, 0.0::DOUBLE AS score FROM messages WHERE regexp_matches(content, '\b[Tt]h(an|en|at)\b.*?(\.|,)') ORDER BY id::VARCHAR LIMIT 30")
def grep_by_pattern(spark, sf):
    """The search tool's pattern mode, with a named group."""
    m = messages(spark, sf)
    found = recall.grep(m, spark.createDataFrame([], "summary_id string, conversation_id long, kind string, depth int, content string, created_at timestamp"), r"\b[Tt]h(?P<end>an|en|at)\b.*?(\.|,)", mode="regex", limit=30)
    return found.select(F.col("id").cast("long").alias("id"), "score")


@query(M + " SELECT * FROM (SELECT 'message' AS type, id::VARCHAR AS id FROM messages WHERE contains(content, 'the') ORDER BY 2 LIMIT 25) UNION ALL SELECT * FROM (SELECT 'summary', 's' || id FROM messages WHERE contains(content, 'the') AND id % 2 = 0 ORDER BY 2 LIMIT 25) ORDER BY 1, 2 LIMIT 40")
def grep_cjk(spark, sf):
    """A query in Japanese over messages, and over every other one as a summary: two letters are enough, as substrings are searched."""
    m = messages(spark, sf).withColumn("content", F.replace("content", F.lit("the"), F.lit("日本語")))
    nodes = m.where("id % 2 = 0").select(F.concat(F.lit("s"), "id").alias("summary_id"), "conversation_id", F.lit("leaf").alias("kind"), F.lit(0).alias("depth"), "content", "created_at")
    parts = [recall.grep(m, nodes, "本語", scope=scope, limit=25) for scope in ("messages", "summaries")]
    return parts[0].unionByName(parts[1]).orderBy("type", "id").limit(40).select("type", "id")


@query(S + """, kept AS (SELECT * FROM sessions WHERE id % 5 <> 2), g AS (SELECT lead(seq) OVER (PARTITION BY conversation_id ORDER BY seq) - seq AS d FROM kept),
n AS (SELECT 'ordinals_contiguous' AS name, (SELECT count(*) FROM g WHERE d > 1) AS n, 'renumber' AS action
  UNION ALL SELECT 'items_exist', (SELECT count(*) FROM kept WHERE id % 7 = 3) + (SELECT count(DISTINCT conversation_id) FROM kept), 'drop items'
  UNION ALL SELECT 'items_are_one_kind', (SELECT count(DISTINCT conversation_id) FROM kept), 'drop items')
SELECT name, n = 0 AS passed, n || ' bad' AS details, CASE WHEN n > 0 THEN action END AS action FROM n""")
def integrity_items(spark, sf):
    """Context items with gaps, of messages and a summary that are gone, and one without any content in each conversation."""
    rows = long_sessions(spark, sf)
    nodes, edges = compaction.leaves(rows, SMALL)
    g = compaction.Dag(nodes, edges, compaction.empty_edges(rows))
    items = rows.where("id % 5 <> 2").select("conversation_id", F.col("seq").alias("ordinal"), F.lit("message").alias("item_type"), F.col("id").alias("message_id"), F.lit(None).cast("string").alias("summary_id"))
    last = items.groupBy("conversation_id").agg(F.max("ordinal").alias("last"))
    more = lambda n, sid: last.select("conversation_id", (F.col("last") + n).alias("ordinal"), F.lit("summary").alias("item_type"), F.lit(None).cast("long").alias("message_id"), F.lit(sid).cast("string").alias("summary_id"))
    items = items.unionByName(more(1, "sum_gone")).unionByName(more(2, None))
    found = integrity.checks(rows.where("id % 7 <> 3"), g, items).where(F.col("name").isin("ordinals_contiguous", "items_exist", "items_are_one_kind"))
    return found.join(integrity.repair_plan(found).select("name", "action"), "name", "left")


@query(S + ", f AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, substr(content, 1, 20) ORDER BY seq) AS n FROM sessions) SELECT id FROM f WHERE n = 1")
def first_by_prefix(spark, sf):
    return recall.first_of(long_sessions(spark, sf), ["conversation_id", F.substring("content", 1, 20)], ["seq"]).select("id")


@query(M + " SELECT to_json({'id': id, 'role': role, 'seq': seq}) AS json FROM messages")
def result_json(spark, sf):
    return messages(spark, sf).select(F.to_json(F.struct("id", "role", "seq")).alias("json"))


def index_sql() -> str:
    from threadloom.plans.queries import bm25_sql

    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id % 10 <> 3), " + bm25_sql("d", "doc_id", "text", ["la", "de"]) + " SELECT doc_id AS id, round(score, 6) AS score FROM ranked"


def replay_sql() -> str:
    from threadloom.plans.queries import bm25_sql

    part = lambda v, table, p: f"SELECT {v} AS version, doc_id AS id, round(score, 6) AS score FROM ranked{p}"
    return "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), e AS (SELECT * FROM d WHERE doc_id % 10 <> 3), " + bm25_sql("d", "doc_id", "text", ["la", "de"], p="d") + ", " + bm25_sql("e", "doc_id", "text", ["la", "de"], p="e") + " " + " UNION ALL ".join([part(2, "d", "d"), part(3, "e", "e"), part(4, "e", "e")])


def index_search(spark, sf):
    """An index that is built, added to and removed from; all hits."""
    at, d = place(spark, "index"), docs(spark, sf)
    index.build(d.where("doc_id % 2 = 0"), "doc_id", "text", at)
    index.append(d.where("doc_id % 2 = 1"), "doc_id", "text", at, 1)
    index.remove(d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id")), at, 2)
    return index.search(spark, at, ["la", "de"]).select("id", F.round("score", 6).alias("score"))


def index_replay(spark, sf):
    """An index whose batches come twice, whose documents come again with other texts, and that is merged; every version's hits.

    Documents that are no multiple of 3 come first with the text of another document, and then with their own.
    """
    at, d = place(spark, "index"), docs(spark, sf).select("doc_id", "text")
    other = d.select((F.col("doc_id") + 1).alias("doc_id"), "text")
    first = d.where("doc_id % 3 = 0").unionByName(other.where("doc_id % 3 <> 0").join(d.select("doc_id"), "doc_id", "left_semi"))
    index.build(first, "doc_id", "text", at)
    for _ in range(2):
        index.append(d.where("doc_id % 3 <> 0"), "doc_id", "text", at, 1)
    for _ in range(2):
        index.remove(d.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id")), at, 2)
    index.merge(spark, at)
    found = [index.search(spark, at, ["la", "de"], v).select(F.lit(v).alias("version"), "id", F.round("score", 6).alias("score")) for v in (2, 3, 4)]
    return found[0].unionByName(found[1]).unionByName(found[2])


#: Substrings and a pattern that few documents hold, and a letter that most do, which no trigram helps to find.
PARTS, PATTERN = ["@MAIL%.e_ample", "+1 (74", "thThane", "ÉONAN", "e"], r"(?:\) 555-[0-9]{4}|@mail[0-9]+\.|ingshly [a-z])"


@query(" UNION ALL ".join(f"SELECT '{q}' AS part, doc_id FROM documents WHERE text ILIKE '%{q}%'" for q in PARTS) + f" UNION ALL SELECT 'pattern' AS part, doc_id FROM documents WHERE regexp_matches(text, '{PATTERN}')")
def trigram_search(spark, sf):
    """Substrings and a pattern over all documents by the trigram index, which comes in two batches."""
    at, d = place(spark, "grams"), docs(spark, sf)
    grams.build(d.where("doc_id % 2 = 0"), "doc_id", "text", at)
    grams.append(d.where("doc_id % 2 <> 0 or doc_id is null"), "doc_id", "text", at, 1)
    found = [grams.like(d, "doc_id", "text", q, at).select(F.lit(q).alias("part"), "doc_id") for q in PARTS]
    found.append(grams.regex(d, "doc_id", "text", PATTERN, at).select(F.lit("pattern").alias("part"), "doc_id"))
    return reduce(DataFrame.unionByName, found)


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct([substr(lower(text), i::BIGINT, 3) FOR i IN range(1, greatest(1, length(text) - 1))])) AS gram FROM documents)
SELECT gram, count(*) AS n FROM t GROUP BY gram""")
def trigram_counts(spark, sf):
    """The number of documents of each trigram of all documents, as the index keeps them to choose what to read."""
    at = place(spark, "grams")
    grams.build(docs(spark, sf), "doc_id", "text", at)
    return Snapshots(spark, at).read("grams").select("gram", "n")


@query(S + """, n AS (SELECT *, max(seq) OVER (PARTITION BY conversation_id) AS last FROM sessions), p AS (SELECT conversation_id, count(*) FILTER (WHERE seq <= last // 3) AS a, count(*) FILTER (WHERE seq <= 2 * last // 3) AS b, count(*) AS c FROM n GROUP BY 1),
l AS (SELECT conversation_id, greatest(0, a - 2) // 2 AS x, greatest(0, b - 2) // 2 AS y, greatest(0, c - 2) // 2 AS z FROM p),
k AS (SELECT conversation_id, z AS leaves, x, y - x AS y1, z - y AS z1 FROM l),
d1 AS (SELECT *, CASE WHEN x >= 2 THEN 0 ELSE x END AS o1, (x >= 2)::INT AS m1 FROM k),
d2 AS (SELECT *, CASE WHEN o1 + y1 >= 2 THEN 0 ELSE o1 + y1 END AS o2, (o1 + y1 >= 2)::INT AS m2 FROM d1),
d3 AS (SELECT *, (o2 + z1 >= 2)::INT AS m3 FROM d2)
SELECT conversation_id, leaves::BIGINT AS leaves, (m1 + m2 + m3)::BIGINT AS depth_1, CASE WHEN m1 + m2 >= 2 THEN 1 WHEN m1 + m2 + m3 >= 2 THEN 1 ELSE 0 END::BIGINT AS depth_2 FROM d3""")
def compact_incremental(spark, sf):
    """Three sweeps as a conversation grows. With equal tokens, two messages make a leaf; two orphans make a node.

    The second sweep's node joins the first's in a node of depth 2; the third's stays an orphan.
    """
    from dataclasses import replace

    rows = long_sessions(spark, sf).withColumn("last", F.max("seq").over(Window.partitionBy("conversation_id"))).withColumn("token_count", F.lit(100).cast("long"))
    settings, g = replace(SMALL, leaf_chunk_tokens=200), None
    for upto in ("seq <= floor(last / 3)", "seq <= floor(2 * last / 3)", "true"):
        g = compaction.sweep(rows.where(upto).drop("last"), settings, g)
    n = lambda c, name: F.count_if(c).alias(name)
    return g.summaries.groupBy("conversation_id").agg(n(F.col("kind") == "leaf", "leaves"), n(F.col("depth") == 1, "depth_1"), n(F.col("depth") == 2, "depth_2"))


PRESSED = "pressed AS (SELECT * EXCLUDE (token_count), 100::BIGINT AS token_count FROM sessions WHERE seq <= 4 + 2 * (conversation_id % 10))"
#: Messages of 100 tokens: two make a leaf of at most 100, and two orphans a node of at most 100.
LEAF_OF_TWO = """(SELECT conversation_id, (seq - 1) // 2 AS k, min(seq) AS first_seq, max(seq) AS last_seq, string_agg('[' || role || '] ' || CASE WHEN length(content) > 800 THEN substr(content, 1, 800) || chr(10) || '[cut, 100 tokens]' ELSE content END, chr(10) ORDER BY seq) AS text
  FROM pressed JOIN n USING (conversation_id) WHERE seq <= c - 2 GROUP BY 1, 2 HAVING count(*) = 2)"""


@query(S + f""", {PRESSED}, n AS (SELECT conversation_id, count(*) AS c FROM pressed GROUP BY 1),
u AS (SELECT conversation_id, CASE WHEN c >= 17 THEN 'BLOCKING' WHEN c >= 15 THEN 'ASYNC' ELSE 'NONE' END AS u FROM n),
l AS (SELECT l.*, substr(text, 1, 400) AS content FROM {LEAF_OF_TWO} l JOIN u USING (conversation_id) WHERE u = 'BLOCKING' OR (u = 'ASYNC' AND k = 0)),
o AS (SELECT conversation_id, count(*) AS n, string_agg(content, chr(10) ORDER BY k) AS text FROM l GROUP BY 1 HAVING count(*) >= 2)
SELECT conversation_id, 0 AS depth, first_seq::BIGINT AS first_seq, last_seq::BIGINT AS last_seq, 0::BIGINT AS n_children, content FROM l
UNION ALL SELECT conversation_id, 1, NULL, NULL, n, substr(text, 1, 400) FROM o""")
def compact_under_pressure(spark, sf):
    """What one cycle makes of conversations of 4 to 22 messages from an empty graph: nothing, one leaf, or all there is."""
    from dataclasses import replace

    rows = long_sessions(spark, sf).where("seq <= 4 + 2 * (conversation_id % 10)").withColumn("token_count", F.lit(100).cast("long"))
    settings = replace(SMALL, leaf_chunk_tokens=200)
    empty = compaction.Dag(*compaction.leaves(rows.limit(0), settings), compaction.empty_edges(rows))
    return nodes_made(rows, compaction.incremental(rows, settings, empty, 2000))


CUT_LEAF = """(SELECT conversation_id, (seq - 1) // 2 AS k, seq, '[' || role || '] ' || CASE WHEN length(content) > 800 THEN substr(content, 1, 800) || chr(10) || '[cut, 100 tokens]' ELSE content END AS line FROM sessions)"""


@query(S + f""", n AS (SELECT conversation_id, count(*) AS c FROM sessions GROUP BY 1),
l AS (SELECT conversation_id, k, substr(string_agg(line, chr(10) ORDER BY seq), 1, 400) AS content FROM {CUT_LEAF} JOIN n USING (conversation_id) WHERE seq <= c - 2 GROUP BY 1, 2 HAVING count(*) = 2),
a AS (SELECT conversation_id, substr(string_agg(content, chr(10) ORDER BY k), 1, 400) AS t FROM l WHERE k < 9 GROUP BY 1),
b AS (SELECT conversation_id, count(*) AS k, substr(string_agg(content, chr(10) ORDER BY k), 1, 400) AS t FROM l WHERE k >= 9 GROUP BY 1)
SELECT conversation_id, 1 AS round, ((c - 18) * 100 + length(a.t) // 4)::BIGINT AS before, ((c - 18 - 2 * k) * 100 + length(substr(a.t || chr(10) || b.t, 1, 400)) // 4)::BIGINT AS after, 10::BIGINT AS kept
FROM n JOIN a USING (conversation_id) JOIN b USING (conversation_id) WHERE (c - 18) * 100 + length(a.t) // 4 >= 1500 AND k >= 2""")
def compact_until_under(spark, sf):
    """Rounds until conversations of 100 tokens a message are under 1,500, from the graph of their first 21 messages.

    A round makes a leaf of each two messages, a node over them and one over this and the node that was there: of
    the given graph's ten nodes, all stay.
    """
    from dataclasses import replace

    rows = long_sessions(spark, sf).withColumn("token_count", F.lit(100).cast("long"))
    settings, history = replace(SMALL, leaf_chunk_tokens=200), []
    given = compaction.sweep(rows.where("seq <= 21"), settings)
    g = compaction.until_under(rows, settings, 2000, given, history=history)
    kept = g.summaries.join(given.summaries.select("summary_id"), "summary_id", "left_semi").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("kept"))
    rounds = reduce(DataFrame.unionByName, history)
    return rounds.join(kept, "conversation_id").select("conversation_id", "round", "before", "after", "kept")


def nodes_made(rows, g):
    """(conversation_id, depth, first_seq, last_seq, n_children, content) of all nodes."""
    spans = g.leaf_edges.join(rows.select(F.col("id").alias("message_id"), "seq"), "message_id").groupBy("summary_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    kids = g.parent_edges.groupBy(F.col("parent_id").alias("summary_id")).agg(F.count(F.lit(1)).alias("n"))
    out = g.summaries.join(spans, "summary_id", "left").join(kids, "summary_id", "left")
    return out.select("conversation_id", "depth", "first_seq", "last_seq", F.coalesce("n", F.lit(0)).alias("n_children"), "content")


@query(M + """, t AS (SELECT conversation_id, sum(token_count)::BIGINT AS tokens, CASE WHEN conversation_id % 3 = 0 THEN NULL ELSE 20 * conversation_id END AS cap FROM messages GROUP BY 1)
SELECT conversation_id, least(1000, coalesce(cap, 1000))::BIGINT AS most, greatest(0, least(1000, coalesce(cap, 1000)) - tokens)::BIGINT AS left_over FROM t""")
def effective_budget(spark, sf):
    """What each conversation leaves of its context, which is 1,000 tokens or a cap of its own."""
    t = messages(spark, sf).groupBy("conversation_id").agg(F.sum("token_count").alias("tokens"))
    cap = F.when(F.col("conversation_id") % 3 != 0, 20 * F.col("conversation_id"))
    most = assemble.effective_limit(F.lit(1000).cast("long"), cap)
    return t.select("conversation_id", most.alias("most"), F.greatest(F.lit(0).cast("long"), most - F.col("tokens")).alias("left_over"))



@query("SELECT conv_id % 12 AS k, CASE WHEN conv_id % 12 >= 2 OR conv_id % 3 >= 2 THEN true ELSE false END AS noted FROM conversations GROUP BY ALL")
def compaction_note(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").select((F.col("conv_id") % 12).alias("k"), (F.col("conv_id") % 3).alias("j")).distinct()
    return c.select("k", assemble.compaction_note(F.col("k"), F.col("j")).isNotNull().alias("noted")).distinct()


ASKING = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))


@query(M + f""", t AS (SELECT id, [w FOR w IN regexp_split_to_array(lower(translate(content, '?,.', '')), '[\\s\\x0b\\x{{85}}\\x{{a0}}]+') IF length(w) > 2 AND w NOT IN ({ASKING})] AS t FROM messages)
SELECT id, array_to_string(list_concat([t[i] || ' ' || t[i + 1] FOR i IN range(1, least(len(t), 4))], t[1:5]), '|') AS terms FROM t""")
def key_terms(spark, sf):
    return messages(spark, sf).select("id", F.array_join(X.key_terms(F.col("content")), "|").alias("terms"))


def vector_cells_topk(spark, sf):
    """The most similar vectors by an index of cells; without a number of probes the search is exact."""
    from threadloom.plans.queries import VECTOR, vectors

    at = place(spark, "cells")
    cells.build(vectors(spark, sf), "vec_id", at)
    return cells.search(spark, at, VECTOR, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def vector_cells_append(spark, sf):
    """The same search over an index that is built of a fourth of the vectors and gets the others in three batches, each sent twice.

    Cells of more than a twentieth of all vectors are split.
    """
    from threadloom.plans.queries import VECTOR, vectors

    at, v = place(spark, "cells"), vectors(spark, sf)
    most = max(1, v.count() // 20)
    cells.build(v.where("vec_id % 4 = 0"), "vec_id", at, cells=8)
    for batch in range(1, 4):
        for _ in range(2):
            cells.append(v.where(F.col("vec_id") % 4 == batch), at, batch, most_rows=most)
    return cells.search(spark, at, VECTOR, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


def grep_english(spark, sf):
    """Messages that hold the stems of all words of an English question; tests hold it against a plain form."""
    return english.search(messages(spark, sf), "content", ENGLISH).select("id", F.round("score", 9).alias("score"))


QUERIES["grep_english"] = grep_english
