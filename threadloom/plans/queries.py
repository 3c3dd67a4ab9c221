"""Queries over the test tables, with equivalent DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.config import SMALL
from threadloom.functions import text as X
from threadloom.functions.vectors import cosine, literal
from threadloom.operators import aggregates, assemble, compaction, dag, expansion, folds, index, integrity, recall, store
from threadloom.sources.scratch import place
from threadloom.sources.tables import MESSAGES_SQL, SESSIONS_SQL, long_sessions, messages
from threadloom.streaming import ingest

QUERY, DOC_QUERY = "the tion", "la de"
VECTOR = [(i % 7 - 3) / 10 for i in range(64)]
SINCE, BEFORE = "2024-01-01 10:00:00", "2024-01-02 00:00:00"
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def vectors(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("label").cast("long").alias("conversation_id"), "embedding")


def graph(spark, sf):
    """Messages and their graph, written once: queries read it several times."""
    rows = long_sessions(spark, sf)
    return rows, compaction.sweep(rows, SMALL)


def families(spark, sf):
    """A graph of depth 2 from the test tables: regions over nations over suppliers."""
    read = lambda name: spark.read.parquet(f"{sf}/{name}.parquet")
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    node = lambda df, letter, column, depth: df.select(key(letter, column).alias("summary_id"), F.lit(depth).alias("depth"))
    r, n, x = read("region"), read("nation"), read("supplier")
    nodes = node(r, "r", "r_regionkey", 2).union(node(n, "n", "n_nationkey", 1)).union(node(x, "s", "s_suppkey", 0))
    edges = n.select(key("r", "n_regionkey").alias("parent_id"), key("n", "n_nationkey").alias("child_id")).union(x.select(key("n", "s_nationkey"), key("s", "s_suppkey")))
    return nodes, edges


SNIP = "CASE WHEN length({0}) <= 200 THEN {0} ELSE substr({0}, 1, 197) || '...' END"


def bm25_sql(table: str, key: str, text: str, words: list[str], extra: str = "", p: str = "") -> str:
    """Scores of rows with all words, over statistics of the whole table."""
    n = ", ".join(f"count(*) FILTER (WHERE list_contains(t, '{w}')) AS n{i}" for i, w in enumerate(words))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * len(list_filter(t, lambda x: x = '{w}')) * 2.2 / (len(list_filter(t, lambda x: x = '{w}')) + 1.2 * (0.25 + 0.75 * len(t) / avgdl))" for i, w in enumerate(words))
    have = " AND ".join(f"list_contains(t, '{w}')" for w in words)
    return f"""tok{p} AS (SELECT *, regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}\\p{{N}}]+') AS t FROM {table}),
    st{p} AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl, {n} FROM tok{p}),
    ranked{p} AS (SELECT tok{p}.*, {score} AS score FROM tok{p}, st{p} WHERE {have} {extra})"""


@query("WITH " + MESSAGES_SQL + ", " + bm25_sql("messages", "id", "content", ["the", "tion"]) + f" SELECT id, {SNIP.format('content')} AS snippet, round(score, 6) AS score FROM ranked ORDER BY round(score, 9) DESC, id LIMIT 20")
def grep_messages_bm25(spark, sf):
    found = recall.bm25(messages(spark, sf), "content", recall.query_terms(recall.sanitise(QUERY)))
    return found.orderBy(F.desc(F.round("score", 9)), "id").limit(20).select("id", X.snippet(F.col("content")).alias("snippet"), F.round("score", 6).alias("score"))


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + bm25_sql("d", "doc_id", "text", ["la", "de"]) + " SELECT doc_id, round(score, 6) AS score FROM ranked ORDER BY round(score, 9) DESC, doc_id LIMIT 50")
def docs_fts_top(spark, sf):
    d = docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return recall.bm25(d, "text", recall.query_terms(DOC_QUERY)).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(50).select("doc_id", F.round("score", 6).alias("score"))


@query("WITH " + MESSAGES_SQL + f" SELECT id, conversation_id, {SNIP.format('content')} AS snippet FROM messages WHERE lower(content) LIKE '%was the%'")
def grep_like(spark, sf):
    return recall.like(messages(spark, sf), ["content"], "was the").select("id", "conversation_id", X.snippet(F.col("content")).alias("snippet"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(en|fr)/[0-9]{3}\\b')")
def grep_regex(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return recall.regex(p, "url", r"/(?P<lang>en|fr)/[0-9]{3}\b").select("page_id", "url")


@query("WITH " + MESSAGES_SQL + f" SELECT id, seq FROM messages WHERE created_at >= TIMESTAMP '{SINCE}' AND created_at < TIMESTAMP '{BEFORE}' AND lower(content) LIKE '%the%'")
def grep_time_range(spark, sf):
    m = store.in_range(messages(spark, sf), F.to_timestamp(F.lit(SINCE)), F.to_timestamp(F.lit(BEFORE)))
    return recall.like(m, ["content"], "the").select("id", "seq")


VEC = "[" + ", ".join(str(x) for x in VECTOR) + "]::DOUBLE[]"
COS = f"list_cosine_similarity(embedding::DOUBLE[], {VEC})"


@query(f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings ORDER BY {COS} DESC, vec_id LIMIT 20")
def vector_topk(spark, sf):
    return recall.vector_top(vectors(spark, sf), VECTOR, 20, "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id, round({COS}, 6) AS score FROM embeddings WHERE {COS} >= 0.05 AND label <> 0 AND label IN (0, 1, 2, 3) ORDER BY {COS} DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    found = recall.vector_top(vectors(spark, sf), VECTOR, 10, "vec_id", exclude=0, conversation_ids=[0, 1, 2, 3], min_score=0.05)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), " + bm25_sql("d", "doc_id", "text", ["la", "de"]) + f""",
f AS (SELECT doc_id AS id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM ranked QUALIFY rank < 50),
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY {COS} DESC, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 50),
u AS (SELECT id, rank, 0 AS l FROM f UNION ALL SELECT id, rank, 1 FROM v)
SELECT id, round(sum(1.0::DOUBLE / (60 + rank + 1)), 9) AS score FROM u GROUP BY id ORDER BY score DESC, min(l * 1000 + rank) LIMIT 20""")
def rrf_hybrid(spark, sf):
    by_text = docs_fts_top(spark, sf).select(F.col("doc_id").alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")) - 1).alias("rank"))
    top = recall.vector_top(vectors(spark, sf), VECTOR, 50, "vec_id")
    by_vector = top.select(F.col("vec_id").alias("id"), (F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")) - 1).alias("rank"))
    return recall.hybrid(by_text, by_vector, 20).select("id", "score")


@query("WITH " + MESSAGES_SQL + " SELECT id, conversation_id, seq FROM messages QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 2")
def tail_n(spark, sf):
    return folds.tail(messages(spark, sf), 2).select("id", "conversation_id", "seq")


@query("WITH " + MESSAGES_SQL + " SELECT conversation_id, count(*) AS messages, sum(token_count)::BIGINT AS tokens, max(seq) AS last_seq FROM messages GROUP BY ALL")
def token_totals(spark, sf):
    return aggregates.totals(messages(spark, sf), "conversation_id")


@query("WITH " + MESSAGES_SQL + """, m AS (SELECT * FROM messages WHERE id % 5 <> 2), r AS (SELECT conversation_id, min(seq) lo, max(seq) hi FROM m GROUP BY 1),
e AS (SELECT conversation_id, unnest(range(lo, hi + 1)) AS seq FROM r)
SELECT e.conversation_id, count(*) AS n_missing, min(e.seq) AS first_missing FROM e ANTI JOIN m ON m.conversation_id = e.conversation_id AND m.seq = e.seq GROUP BY 1""")
def seq_gaps(spark, sf):
    found = integrity.gaps(messages(spark, sf).where("id % 5 <> 2"), "conversation_id", "seq")
    return found.groupBy("conversation_id").agg(F.sum("n").alias("n_missing"), F.min("first").alias("first_missing"))


CHUNKS_SQL = "WITH RECURSIVE " + SESSIONS_SQL + """, e AS (
  SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq) AS rn FROM
    (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) AS back FROM sessions) WHERE back > 2),
walk AS (
  SELECT conversation_id, id, seq, rn, token_count, 0 AS chunk, token_count AS total, 1 AS size, false AS closed FROM e WHERE rn = 1
  UNION ALL
  SELECT e.conversation_id, e.id, e.seq, e.rn, e.token_count,
    CASE WHEN w.closed OR (w.total + e.token_count > 300 AND NOT (e.token_count > 300 AND w.size < 2)) THEN w.chunk + 1 ELSE w.chunk END,
    CASE WHEN w.closed OR (w.total + e.token_count > 300 AND NOT (e.token_count > 300 AND w.size < 2)) THEN e.token_count ELSE w.total + e.token_count END,
    CASE WHEN w.closed OR (w.total + e.token_count > 300 AND NOT (e.token_count > 300 AND w.size < 2)) THEN 1 ELSE w.size + 1 END,
    NOT w.closed AND w.total + e.token_count > 300 AND e.token_count > 300 AND w.size < 2
  FROM walk w JOIN e ON e.conversation_id = w.conversation_id AND e.rn = w.rn + 1),
g AS (SELECT conversation_id, chunk, count(*) AS n, max(token_count) AS biggest, max(chunk) OVER (PARTITION BY conversation_id) AS last FROM walk GROUP BY 1, 2),
chunks AS (SELECT w.conversation_id, w.id, w.seq, w.chunk::BIGINT AS chunk FROM walk w JOIN g USING (conversation_id, chunk) WHERE NOT (g.chunk = g.last AND g.n < 2 AND g.biggest <= 300))"""
LINES = """string_agg('[' || role || '] ' || CASE WHEN length(content) > 1200 THEN substr(content, 1, 1200) || chr(10) || '[cut, ' || token_count || ' tokens]' ELSE content END, chr(10) ORDER BY s.seq)"""
DAG_SQL = CHUNKS_SQL + f""", lv AS (
  SELECT s.conversation_id, chunk, substr({LINES}, 1, 400) AS content, sum(token_count)::BIGINT AS source_token_count, min(s.seq) AS a, max(s.seq) AS z,
         arg_min(created_at, s.seq) AS earliest_at, arg_max(created_at, s.seq) AS latest_at FROM sessions s JOIN chunks c ON c.id = s.id GROUP BY 1, 2),
leaf AS (SELECT 'sum_' || substr(sha256(conversation_id || ':' || a || ':' || z), 1, 12) AS summary_id, conversation_id, 'leaf' AS kind, 0 AS depth, content,
  length(content) // 4 AS token_count, source_token_count, earliest_at, latest_at, latest_at AS created_at, chunk FROM lv),
leaf_edges AS (SELECT summary_id, id AS message_id FROM chunks JOIN leaf USING (conversation_id, chunk)),
cond AS (SELECT conversation_id, list(summary_id ORDER BY created_at, summary_id) AS kids, substr(string_agg(content, chr(10) ORDER BY created_at, summary_id), 1, 400) AS content,
  sum(token_count)::BIGINT AS source_token_count, arg_min(earliest_at, (created_at, summary_id)) AS earliest_at, arg_max(latest_at, (created_at, summary_id)) AS latest_at, max(created_at) AS created_at FROM leaf GROUP BY 1 HAVING count(*) >= 2),
top AS (SELECT *, 'sum_' || substr(sha256(array_to_string(kids, ',')), 1, 12) AS summary_id FROM cond),
parent_edges AS (SELECT summary_id AS parent_id, unnest(kids) AS child_id FROM top),
summaries AS (SELECT * EXCLUDE (chunk) FROM leaf UNION ALL SELECT summary_id, conversation_id, 'condensed', 1, content, length(content) // 4, source_token_count, earliest_at, latest_at, created_at FROM top),
roots AS (SELECT * FROM summaries WHERE summary_id NOT IN (SELECT child_id FROM parent_edges))"""


@query(CHUNKS_SQL + " SELECT conversation_id, id, seq, chunk FROM chunks")
def leaf_sweep(spark, sf):
    return folds.leaf_sweep(long_sessions(spark, sf), None, SMALL.fresh_tail, SMALL.leaf_chunk_tokens, SMALL.leaf_min_fanout)


@query(CHUNKS_SQL + " SELECT conversation_id, id, seq, chunk FROM chunks")
def leaf_sweep_blocks(spark, sf):
    """The same chunks, where each conversation is cut in blocks by many tasks."""
    return folds.leaf_sweep(long_sessions(spark, sf), None, SMALL.fresh_tail, SMALL.leaf_chunk_tokens, SMALL.leaf_min_fanout, one_task_rows=0)


@query(CHUNKS_SQL + " SELECT conversation_id, id, seq FROM chunks WHERE chunk = 0")
def leaf_chunks(spark, sf):
    return leaf_sweep(spark, sf).where("chunk = 0").drop("chunk")


@query(DAG_SQL + " SELECT summary_id, conversation_id, content, token_count, source_token_count, earliest_at, latest_at FROM leaf")
def leaf_create(spark, sf):
    nodes, _ = compaction.leaves(long_sessions(spark, sf), SMALL)
    return nodes.select("summary_id", "conversation_id", "content", "token_count", "source_token_count", "earliest_at", "latest_at")


@query(DAG_SQL + " SELECT summary_id, conversation_id, 1 AS depth, content, source_token_count, earliest_at, latest_at, len(kids) AS n_children FROM top")
def condense_level(spark, sf):
    _, g = graph(spark, sf)
    kids = g.parent_edges.groupBy(F.col("parent_id").alias("summary_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return g.summaries.where("kind = 'condensed'").join(kids, "summary_id").select("summary_id", "conversation_id", "depth", "content", "source_token_count", "earliest_at", "latest_at", "n_children")


FAMILY_SQL = """WITH e AS (SELECT 'r' || n_regionkey AS parent_id, 'n' || n_nationkey AS child_id FROM nation UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


@query(FAMILY_SQL + " SELECT parent_id AS ancestor, child_id AS descendant, 1 AS distance FROM e UNION ALL SELECT a.parent_id, b.child_id, 2 FROM e a JOIN e b ON a.child_id = b.parent_id")
def dag_closure(spark, sf):
    return dag.closure(families(spark, sf)[1])


@query(DAG_SQL + " SELECT summary_id, conversation_id, depth FROM roots")
def roots(spark, sf):
    _, g = graph(spark, sf)
    return dag.roots(g.summaries, g.parent_edges).select("summary_id", "conversation_id", "depth")


@query(FAMILY_SQL + """, t AS (SELECT 'r' || r_regionkey AS summary_id, 2 AS depth FROM region), u AS (SELECT 'n' || n_nationkey AS summary_id, 1 AS depth FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT child_id FROM e SEMI JOIN t ON t.summary_id = e.parent_id)),
v AS (SELECT 's' || s_suppkey AS summary_id, 0 AS depth FROM supplier WHERE 's' || s_suppkey NOT IN (SELECT child_id FROM e WHERE parent_id IN (SELECT summary_id FROM t UNION ALL SELECT summary_id FROM u))) SELECT * FROM t UNION ALL SELECT * FROM u UNION ALL SELECT * FROM v""")
def eligible(spark, sf):
    """Grandchildren come back by this rule: regions and suppliers, no nations."""
    return dag.eligible(*families(spark, sf), 2, "parent_of_included")


@query(DAG_SQL + " SELECT depth, kind, count(*) AS summaries, sum(token_count)::BIGINT AS tokens FROM summaries GROUP BY 1, 2")
def stats_by_depth(spark, sf):
    return aggregates.by_depth(graph(spark, sf)[1].summaries)


@query(DAG_SQL + " SELECT max(depth) AS max_depth, count(*) FILTER (WHERE kind = 'leaf') AS leaves, count(*) FILTER (WHERE kind = 'condensed') AS condensed, count(*) AS total FROM summaries")
def compaction_stats(spark, sf):
    return aggregates.compaction_stats(graph(spark, sf)[1].summaries)


@query(DAG_SQL + """, x AS (SELECT s.conversation_id, sum(token_count) AS m FROM sessions s GROUP BY 1), y AS (SELECT conversation_id, sum(source_token_count) AS l FROM leaf GROUP BY 1), z AS (SELECT conversation_id, sum(token_count) AS r FROM roots GROUP BY 1)
SELECT x.conversation_id, t AS tokens, CASE WHEN t / 1500.0 >= 0.85 THEN 'BLOCKING' WHEN t / 1500.0 >= 0.75 THEN 'ASYNC' ELSE 'NONE' END AS urgency
FROM (SELECT x.conversation_id, (greatest(0, m - coalesce(l, 0)) + coalesce(r, 0))::BIGINT AS t FROM x LEFT JOIN y USING (conversation_id) LEFT JOIN z USING (conversation_id)) x""")
def urgency(spark, sf):
    rows, g = graph(spark, sf)
    return compaction.context_tokens(rows, g).withColumn("urgency", compaction.urgency(F.col("tokens"), 1500, 0.75, 0.85))


@query(DAG_SQL + ", b AS (SELECT conversation_id, (1200 - sum(token_count)) * 0.4::DOUBLE AS budget FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 2) GROUP BY 1)" + """,
c AS (SELECT l.*, budget, row_number() OVER (PARTITION BY conversation_id ORDER BY earliest_at, created_at, summary_id) AS k FROM leaf l JOIN b USING (conversation_id) WHERE budget > 0),
f AS (SELECT conversation_id, k, summary_id, CASE WHEN token_count > budget THEN 0 ELSE token_count END AS used, token_count <= budget AS keep FROM c WHERE k = 1
  UNION ALL SELECT c.conversation_id, c.k, c.summary_id, CASE WHEN f.used + c.token_count > c.budget THEN f.used ELSE f.used + c.token_count END, f.used + c.token_count <= c.budget FROM f JOIN c ON c.conversation_id = f.conversation_id AND c.k = f.k + 1)
SELECT conversation_id, summary_id, k::INT AS place FROM f WHERE keep""")
def assemble_budget(spark, sf):
    """Over leaves only (no condensed level), so that several compete for the budget."""
    from dataclasses import replace

    rows = long_sessions(spark, sf)
    nodes, edges = compaction.leaves(rows, SMALL)
    g = compaction.Dag(nodes, edges, spark.createDataFrame([], "parent_id string, child_id string"))
    out = assemble.assemble(rows, g, replace(SMALL, max_context_tokens=1200))
    return out.select("conversation_id", "summary_id", "place")


WORDS_SQL = "list_filter(regexp_split_to_array(lower(content), '[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]+'), lambda w: w <> '')"
LITE = " + ".join(f"CASE WHEN len(list_filter(w, lambda x: x = '{t}')) > 0 THEN len(list_filter(w, lambda x: x = '{t}')) * 2.2 / (len(list_filter(w, lambda x: x = '{t}')) + 1.2 * (0.25 + 0.75 * len(w) / mean)) ELSE 0 END" for t in ("the", "and", "of"))


@query(DAG_SQL + ", b AS (SELECT conversation_id, (1200 - sum(token_count)) * 0.4::DOUBLE AS budget FROM (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq DESC) <= 2) GROUP BY 1)" + f""",
w0 AS (SELECT l.*, budget, {WORDS_SQL} AS w FROM leaf l JOIN b USING (conversation_id) WHERE budget > 0), w1 AS (SELECT *, avg(len(w)) OVER (PARTITION BY conversation_id) AS mean FROM w0), w2 AS (SELECT *, {LITE} AS score FROM w1),
c AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY round(score, 9) DESC, earliest_at, created_at, summary_id) AS k FROM w2),
f AS (SELECT conversation_id, k, summary_id, score, CASE WHEN token_count > budget THEN 0 ELSE token_count END AS used, token_count <= budget AS keep FROM c WHERE k = 1
  UNION ALL SELECT c.conversation_id, c.k, c.summary_id, c.score, CASE WHEN f.used + c.token_count > c.budget THEN f.used ELSE f.used + c.token_count END, f.used + c.token_count <= c.budget FROM f JOIN c ON c.conversation_id = f.conversation_id AND c.k = f.k + 1)
SELECT conversation_id, summary_id, k::INT AS place, round(score, 6) AS score FROM f WHERE keep""")
def assemble_bm25lite(spark, sf):
    from dataclasses import replace

    rows = long_sessions(spark, sf)
    nodes, edges = compaction.leaves(rows, SMALL)
    g = compaction.Dag(nodes, edges, spark.createDataFrame([], "parent_id string, child_id string"))
    return assemble.assemble(rows, g, replace(SMALL, max_context_tokens=1200), prompt="the and of").select("conversation_id", "summary_id", "place", F.round("score", 6).alias("score"))


@query(DAG_SQL + " SELECT m.id AS message_id, e.summary_id FROM sessions m JOIN leaf_edges e ON e.message_id = m.id WHERE lower(m.content) LIKE '%the%'")
def grep_covering(spark, sf):
    rows, g = graph(spark, sf)
    cover = dag.covering(g.leaf_edges, g.summaries)
    return recall.like(rows, ["content"], "the").select(F.col("id").alias("message_id")).join(cover, "message_id")


FOUND_SQL = DAG_SQL + ", " + bm25_sql("sessions", "id", "content", ["the", "tion"], p="m") + ", " + bm25_sql("summaries", "summary_id", "content", ["the", "tion"], p="s") + f""",
found AS (SELECT * FROM (SELECT 'message' AS type, id::VARCHAR AS id, {SNIP.format('content')} AS content_snippet, conversation_id, role AS what, seq::VARCHAR AS pos, round(score, 9) AS s, 0 AS src FROM rankedm ORDER BY s DESC, id LIMIT 20)
  UNION ALL SELECT * FROM (SELECT 'summary', summary_id AS id, {SNIP.format('content')}, conversation_id, kind, depth::VARCHAR, round(score, 9) AS s, 1 FROM rankeds ORDER BY s DESC, id LIMIT 20))"""


@query(FOUND_SQL + """, r AS (SELECT *, row_number() OVER (ORDER BY src, s DESC, id) AS rank FROM found ORDER BY src, s DESC, id LIMIT 20),
cover AS (SELECT message_id::VARCHAR AS id, arg_min(summary_id, (created_at, summary_id)) AS covers FROM leaf_edges JOIN leaf USING (summary_id) GROUP BY 1)
SELECT CASE WHEN type = 'summary' THEN r.id ELSE covers END AS summary_id, min(rank) AS rank, string_agg(r.id, ',' ORDER BY rank) AS matches FROM r LEFT JOIN cover ON cover.id = r.id GROUP BY 1""")
def grep_grouped(spark, sf):
    rows, g = graph(spark, sf)
    found = recall.grouped(recall.grep(rows, g.summaries, QUERY, limit=20), dag.covering(g.leaf_edges, g.summaries))
    return found.select("summary_id", F.col("rank").cast("long").alias("rank"), F.array_join(F.transform("matches", lambda x: x.id), ",").alias("matches"))


@query(FOUND_SQL + " SELECT type, id, content_snippet, conversation_id, what, pos, round(s, 6) AS score FROM found ORDER BY src, s DESC, id LIMIT 20 OFFSET 5")
def grep_all_scopes(spark, sf):
    return all_scopes(*graph(spark, sf))


LETTERS = "abcdefghilmnorst"
LETTERS_SQL = "[" + ", ".join(f"(length(content) - length(replace(content, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"
LETTERS_OF = [float(QUERY.count(c)) for c in LETTERS]
ONE = "AND conversation_id = 3"


@query(DAG_SQL + ", " + bm25_sql("sessions", "id", "content", ["the", "tion"], ONE, "m") + ", " + bm25_sql("summaries", "summary_id", "content", ["the", "tion"], ONE, "s") + f""",
allrows AS (SELECT id::VARCHAR AS id, 0 AS src, content, conversation_id FROM sessions UNION ALL SELECT summary_id, 1, content, conversation_id FROM summaries),
text AS (SELECT id, row_number() OVER (ORDER BY src, s DESC, id) - 1 AS rank FROM (SELECT * FROM (SELECT id::VARCHAR AS id, round(score, 9) AS s, 0 AS src FROM rankedm ORDER BY s DESC, id LIMIT 40) UNION ALL SELECT * FROM (SELECT summary_id AS id, round(score, 9) AS s, 1 AS src FROM rankeds ORDER BY s DESC, id LIMIT 40)) QUALIFY rank < 40),
vec AS (SELECT *, list_cosine_similarity({LETTERS_SQL}, {LETTERS_OF}::DOUBLE[]) AS c FROM allrows WHERE conversation_id = 3),
near AS (SELECT id, src, row_number() OVER (PARTITION BY src ORDER BY round(c, 9) DESC, id) - 1 AS rank FROM vec WHERE c >= 0.35 QUALIFY rank < 12),
u AS (SELECT id, rank, 0 AS l FROM text UNION ALL SELECT id, rank, 1 FROM near WHERE src = 0),
both_ranks AS (SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY id),
fused AS (SELECT id, row_number() OVER (ORDER BY score DESC, first) - 1 AS rank FROM both_ranks QUALIFY rank < 40),
z AS (SELECT id, 0 AS part, rank FROM fused UNION ALL SELECT id, 1, rank FROM near WHERE src = 1 AND id NOT IN (SELECT id FROM fused))
SELECT * FROM (SELECT row_number() OVER (ORDER BY part, rank) - 1 AS place, CASE src WHEN 0 THEN 'message' ELSE 'summary' END AS type, id, {SNIP.format('content')} AS content_snippet,
  CASE WHEN id IN (SELECT id FROM text) THEN '' ELSE 'vector' END AS source FROM z JOIN allrows USING (id)) WHERE place < 40""")
def hybrid_grep(spark, sf):
    """Words and vectors together in one conversation, with rows; the vectors are the letter counts of the texts."""
    rows, g = graph(spark, sf)
    count = lambda texts: [[float(t.count(c)) for c in "abcdefghilmnorst"] for t in texts]
    message_vectors = ingest.backfill(rows, rows.limit(0).select("id"), count)
    nodes = g.summaries.select(F.col("summary_id").alias("id"), "conversation_id", "content")
    summary_vectors = ingest.backfill(nodes, nodes.limit(0).select("id"), count)
    found = recall.hybrid_grep(rows, g.summaries, QUERY, LETTERS_OF, message_vectors, summary_vectors, conversation_id=3, limit=40, top_k=12)
    return found.select("place", "type", "id", "content_snippet", F.coalesce(F.col("metadata")["source"], F.lit("")).alias("source"))


def grep_indexed(spark, sf):
    """The same search over full-text indexes of messages and summaries."""
    rows, g = graph(spark, sf)
    at = place(spark, "indexes")
    index.build(rows, "id", "content", f"{at}/message")
    index.build(g.summaries, "summary_id", "content", f"{at}/summary")
    return all_scopes(rows, g, {k: f"{at}/{k}" for k in ("message", "summary")})


QUERIES["grep_indexed"], ORACLES["grep_indexed"] = grep_indexed, ORACLES["grep_all_scopes"]


def all_scopes(rows, g, indexes=None):
    of = lambda a, b: F.coalesce(F.col("metadata")[a], F.col("metadata")[b])
    found = recall.grep(rows, g.summaries, QUERY, limit=20, offset=5, indexes=indexes)
    return found.select("type", "id", "content_snippet", "conversation_id", of("role", "kind").alias("what"), of("seq", "depth").alias("pos"), F.round("score", 6).alias("score"))


@query(DAG_SQL + " SELECT s.summary_id, s.kind, CASE WHEN kind = 'leaf' THEN (SELECT count(*) FROM leaf_edges e WHERE e.summary_id = s.summary_id) ELSE 0 END AS source_message_count, CASE WHEN kind = 'leaf' THEN 0 ELSE (SELECT count(*) FROM parent_edges p WHERE p.parent_id = s.summary_id) END AS n_children FROM summaries s")
def describe(spark, sf):
    _, g = graph(spark, sf)
    return dag.describe(g.summaries, g.parent_edges, g.leaf_edges).select("summary_id", "kind", "source_message_count", F.size("child_ids").cast("long").alias("n_children"))


@query(DAG_SQL + " SELECT e.summary_id, m.id, m.seq, m.role FROM leaf_edges e JOIN sessions m ON m.id = e.message_id")
def expand_leaves(spark, sf):
    rows, g = graph(spark, sf)
    return dag.sources(g.leaf_edges, rows).select("summary_id", "id", "seq", "role")


@query(f"""WITH RECURSIVE h AS (SELECT vec_id, {COS} AS score, (vec_id * 37) % 900 AS t, row_number() OVER (ORDER BY {COS} DESC, vec_id) AS k FROM embeddings QUALIFY k <= 5),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id::VARCHAR) AS n FROM h WHERE score >= 0.05),
f AS (SELECT n, vec_id, score, CASE WHEN t > 1000 THEN 0 ELSE t END AS used, t <= 1000 AS keep FROM r WHERE n = 1
  UNION ALL SELECT r.n, r.vec_id, r.score, CASE WHEN f.used + r.t > 1000 THEN f.used ELSE f.used + r.t END, f.used + r.t <= 1000 FROM f JOIN r ON r.n = f.n + 1)
SELECT vec_id::VARCHAR AS id, n::INT AS place, round(score, 6) AS score FROM f WHERE keep""")
def cross_session_threshold(spark, sf):
    """The embedded rows stand for summaries with token counts of their own."""
    rows = vectors(spark, sf)
    hits = recall.vector_top(rows, VECTOR, 5, "vec_id").select(F.col("vec_id").cast("string").alias("id"), "score")
    summaries = rows.select(F.col("vec_id").cast("string").alias("summary_id"), "conversation_id", (F.col("vec_id") * 37 % 900).alias("token_count"))
    return assemble.cross_session(hits, summaries, 0.05, 1000).select("id", "place", F.round("score", 6).alias("score"))


FAULTY_SQL = DAG_SQL + """, m AS (SELECT * FROM sessions WHERE id % 7 <> 3),
sm AS (SELECT * REPLACE (token_count + CASE WHEN summary_id LIKE 'sum_4%' THEN 1 ELSE 0 END AS token_count) FROM summaries WHERE summary_id NOT LIKE 'sum_0%'),
le AS (SELECT * FROM leaf_edges WHERE summary_id NOT LIKE 'sum_1%' UNION ALL SELECT * FROM leaf_edges WHERE summary_id LIKE 'sum_3%' UNION ALL SELECT 'other', message_id FROM leaf_edges WHERE message_id % 11 = 0),
pe AS (SELECT * FROM parent_edges WHERE parent_id < 'sum_8'),
bad AS (
  SELECT 'sequence_contiguous' AS name, (SELECT count(*) FROM (SELECT lead(seq) OVER (PARTITION BY conversation_id ORDER BY seq) - seq AS d FROM m) WHERE d > 1) AS n
  UNION ALL SELECT 'leaf_sources_exist', (SELECT count(*) FROM le WHERE message_id NOT IN (SELECT id FROM m))
  UNION ALL SELECT 'parents_exist', (SELECT count(*) FROM pe WHERE parent_id NOT IN (SELECT summary_id FROM sm)) + (SELECT count(*) FROM pe WHERE child_id NOT IN (SELECT summary_id FROM sm))
  UNION ALL SELECT 'leaves_have_sources', (SELECT count(*) FROM sm WHERE kind = 'leaf' AND summary_id NOT IN (SELECT summary_id FROM le))
  UNION ALL SELECT 'condensed_have_children', (SELECT count(*) FROM sm WHERE kind = 'condensed' AND summary_id NOT IN (SELECT parent_id FROM pe))
  UNION ALL SELECT 'no_duplicate_references', (SELECT count(*) FROM (SELECT 1 FROM le GROUP BY summary_id, message_id HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM pe GROUP BY parent_id, child_id HAVING count(*) > 1))
  UNION ALL SELECT 'one_leaf_per_message', (SELECT count(*) FROM (SELECT 1 FROM le GROUP BY message_id HAVING count(DISTINCT summary_id) > 1))
  UNION ALL SELECT 'tokens_agree', (SELECT count(*) FROM sm WHERE token_count <> length(content) // 4))"""


@query(FAULTY_SQL + " SELECT name, n = 0 AS passed, n || ' bad' AS details FROM bad")
def integrity_checks(spark, sf):
    """Of a graph with faults: messages, nodes and edges are gone or doubled, and token counts are wrong."""
    rows, g = graph(spark, sf)
    like = lambda c, d: F.col(c).startswith(f"sum_{d}")
    nodes = g.summaries.where(~like("summary_id", 0)).withColumn("token_count", F.col("token_count") + like("summary_id", 4).cast("long"))
    e = g.leaf_edges
    edges = e.where(~like("summary_id", 1)).union(e.where(like("summary_id", 3))).union(e.where("message_id % 11 = 0").select(F.lit("other"), "message_id"))
    return integrity.checks(rows.where("id % 7 <> 3"), compaction.Dag(nodes, edges, g.parent_edges.where("parent_id < 'sum_8'")))


@query(DAG_SQL + " SELECT conversation_id, count(*) AS orphans FROM leaf WHERE summary_id NOT IN (SELECT child_id FROM parent_edges JOIN top ON top.summary_id = parent_id WHERE conversation_id % 2 = 0) GROUP BY 1")
def orphan_leaves(spark, sf):
    """Of a graph whose odd conversations have lost their upper edges."""
    _, g = graph(spark, sf)
    even = g.summaries.where("conversation_id % 2 = 0").select(F.col("summary_id").alias("parent_id"))
    g = compaction.Dag(g.summaries, g.leaf_edges, g.parent_edges.join(even, "parent_id", "left_semi"))
    return integrity.orphans(g).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT doc_id, length(t) // 4 AS quarter, greatest(1, length(t) // 4) AS at_least_one, len(regexp_extract_all(t, '[^\\s\\x{0B}]+')) AS words FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def token_estimates(spark, sf):
    """Three estimates of the tokens of a text; a null text counts as empty."""
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf).select("doc_id", X.tokens_div4(t).alias("quarter"), X.tokens_at_least_one(t).alias("at_least_one"), X.tokens_words(t).alias("words"))


WHITE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
MEDIA_SQL = (r"data:[a-zA-Z0-9]+/[a-zA-Z0-9.+\-]+;base64,[A-Za-z0-9+/=\n]{20,}", f"MEDIA:/[^{WHITE}]+", f"([0-9a-fA-F]{{2}}[{WHITE}]*){{32,}}", r"[\x{80}-\x{ff}]{16,}")


def replaced(text: str, *patterns: str) -> str:
    for p in patterns:
        text = f"regexp_replace({text}, '{p}', '', 'g')"
    return text


@query(f"""WITH a AS (SELECT doc_id, text, {" OR ".join(f"regexp_matches(text, '{p}')" for p in MEDIA_SQL)} AS has, regexp_replace({replaced('text', *MEDIA_SQL)}, '\n{{3,}}', chr(10) || chr(10), 'g') AS rest FROM documents),
b AS (SELECT *, {replaced('rest', f'^[{WHITE}]+', f'[{WHITE}]+$')} AS bare FROM a)
SELECT doc_id, CASE WHEN NOT has OR text IS NULL THEN text WHEN bare = '' THEN '[Media attachment]' ELSE bare || ' [with media attachment]' END AS annotated FROM b""")
def media_annotate(spark, sf):
    return docs(spark, sf).select("doc_id", X.annotate_media(F.col("text")).alias("annotated"))


STOPS = ", ".join(f"'{w}'" for w in sorted(X.STOP_WORDS))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+'), lambda w: length(w) > 2 AND w NOT IN ({STOPS})) AS w FROM documents)
SELECT doc_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS keywords FROM w""")
def keywords(spark, sf):
    """The keywords themselves, once each, in order; none of a null text."""
    return docs(spark, sf).select("doc_id", F.array_join(X.keyword_column(F.coalesce("text", F.lit(""))), " ").alias("keywords"))


@query("SELECT source || ':' || lang AS key, count(*) AS n FROM documents WHERE regexp_matches(source || ':' || lang, '^src1[^:]*:.*$') GROUP BY 1")
def session_glob(spark, sf):
    key = F.concat("source", F.lit(":"), "lang")
    rows = docs(spark, sf).select(key.alias("key"))
    return rows.where(X.matches_globs(F.col("key"), ["src1*:**"])).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, length(text) AS query_len, substr(sha256(text), 1, 12) AS query_hash FROM documents")
def query_fingerprint(spark, sf):
    """Null for a null text."""
    return docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("query_len"), X.fingerprint(F.col("text")).alias("query_hash"))


@query("WITH " + SESSIONS_SQL + """, s AS (SELECT *, count(*) OVER (PARTITION BY conversation_id) AS n FROM sessions),
st AS (SELECT conversation_id, list({'r': role, 'c': content} ORDER BY seq) AS o FROM s WHERE seq <= n - 3 GROUP BY 1), inc AS (SELECT conversation_id, list({'r': role, 'c': content} ORDER BY seq) AS i FROM s WHERE seq > n - 3 - conversation_id % 4 GROUP BY 1)
SELECT conversation_id, coalesce(list_max(list_filter(range(0, least(len(o), len(i)) + 1), lambda k: k = 0 OR list_slice(o, len(o) - k + 1, len(o)) = list_slice(i, 1, k))), 0)::INT AS "drop" FROM inc LEFT JOIN st USING (conversation_id)""")
def overlap_dedup(spark, sf):
    """Stored: all but the last three messages; incoming: these and none to three of what is stored."""
    rows = long_sessions(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("conversation_id")))
    return folds.overlap(rows.where("seq <= n - 3").drop("n"), rows.where("seq > n - 3 - conversation_id % 4").drop("n"))


@query("SELECT user_id, count(*) AS events, max(ts) AS last_ts FROM events GROUP BY 1")
def events_incremental(spark, sf):
    at, path = place(spark, "events"), f"{sf}/event[s].parquet"  # a pattern: the source takes no single file by name
    return ingest.event_state(spark, path, spark.read.parquet(path).schema, f"{at}/stream", f"{at}/table").select("user_id", "events", "last_ts")


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def events_by_type(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("WITH " + SESSIONS_SQL + " SELECT conversation_id, sum(token_count)::BIGINT AS tokens, CASE WHEN sum(token_count) / 8000.0 >= 0.85 THEN 'BLOCKING' WHEN sum(token_count) / 8000.0 >= 0.75 THEN 'ASYNC' ELSE 'NONE' END AS urgency FROM sessions GROUP BY 1")
def pressure(spark, sf):
    return ingest.pressure(long_sessions(spark, sf), 8000)


@query("WITH " + MESSAGES_SQL + f""", v AS (SELECT *, {LETTERS_SQL} AS v FROM messages WHERE id % 3 <> 0 AND regexp_matches(content, '[^' || '""" + WHITE + f"""' || ']'))
SELECT id, conversation_id, list_sum(v) AS total, round(list_cosine_similarity(v, {LETTERS_OF}::DOUBLE[]), 5) AS score FROM v""")
def embedding_backfill(spark, sf):
    """Messages without a vector get one (a third has one); the vectors are the letter counts of the texts."""
    m = messages(spark, sf)
    count = lambda texts: [[float(t.count(c)) for c in "abcdefghilmnorst"] for t in texts]
    made = ingest.backfill(m, m.where("id % 3 = 0").select("id"), count)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return made.select("id", "conversation_id", total.alias("total"), F.round(cosine(F.col("embedding"), literal(LETTERS_OF)), 5).alias("score"))


@query("SELECT avg(quality::DOUBLE) AS overall, (SELECT avg(a) FROM (SELECT avg(quality::DOUBLE) AS a FROM labels GROUP BY toxic)) AS task_average FROM labels")
def benchmark_accuracy(spark, sf):
    return aggregates.accuracy(spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null"), "toxic", "quality")


@query(f"SELECT a.label AS label, round(avg({COS}), 6) AS mean_score, count(*) AS n FROM embeddings a GROUP BY 1")
def cosine_by_label(spark, sf):
    return vectors(spark, sf).groupBy(F.col("conversation_id").cast("int").alias("label")).agg(F.round(F.avg(cosine(F.col("embedding"), literal(VECTOR))), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))


ASKED = "CASE doc_id % 3 WHEN 1 THEN 'all ' || chr(10) || 'time: ' WHEN 2 THEN 'How did  it affect ' ELSE '' END || coalesce(text, '')"


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 'direct' WHEN r < 0.35 OR (r <= 0.7 AND n <= 3) THEN 'shallow' ELSE 'delegate' END AS action FROM (
  SELECT doc_id, n, 500.0 * n * CASE WHEN regexp_matches(q, 'last month|past year|all time|history|everything|since |over the past') THEN 1.5 ELSE 1 END
    * CASE WHEN n >= 5 OR regexp_matches(q, 'compare|relationship between|how did [\\p{{L}}\\p{{M}}\\p{{N}}_]+ affect') THEN 1.3 ELSE 1 END / 5000 AS r
  FROM (SELECT doc_id, doc_id % 7 AS n, regexp_replace(lower({ASKED}), '[' || '{WHITE}' || ']+', ' ', 'g') AS q FROM documents))""")
def expansion_policy(spark, sf):
    """The policy for a question a document (its text, by turns after words that ask for more) with none to six candidates."""
    begin = F.when(F.col("doc_id") % 3 == 1, "all \ntime: ").when(F.col("doc_id") % 3 == 2, "How did  it affect ").otherwise("")
    asked = F.concat(begin, F.coalesce("text", F.lit("")))
    return docs(spark, sf).select("doc_id", expansion.policy(asked, F.col("doc_id") % 7, F.lit(5000)).alias("action"))


def _more() -> None:
    from threadloom.plans import store_queries, stream_queries

    for module in (store_queries, stream_queries):
        QUERIES.update(module.QUERIES)
        ORACLES.update(module.ORACLES)
    QUERIES["index_search"], ORACLES["index_search"] = store_queries.index_search, store_queries.index_sql()
    QUERIES["index_replay"], ORACLES["index_replay"] = store_queries.index_replay, store_queries.replay_sql()
    QUERIES["vector_cells_topk"], ORACLES["vector_cells_topk"] = store_queries.vector_cells_topk, ORACLES["vector_topk"]
    QUERIES["vector_cells_append"], ORACLES["vector_cells_append"] = store_queries.vector_cells_append, ORACLES["vector_topk"]


_more()
