"""Operators on small tables written here."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.config import SMALL, Settings, from_env
from threadloom.functions import text as X
from threadloom.operators import assemble, compaction, dag, expansion, folds, integrity, recall, store
from threadloom.plans.queries import ORACLES, QUERIES

MESSAGE = "id long, conversation_id long, seq long, role string, content string, token_count long, tool_call_id string, tool_name string, created_at timestamp"


def rows(spark, data):
    full = [(i, c, s, r, t, k, *([None] * 3)) if len(x) == 6 else (*x, None) for x in data for (i, c, s, r, t, k) in [x[:6]]]
    return spark.createDataFrame(full, MESSAGE).withColumn("created_at", F.timestamp_seconds("seq"))


@pytest.mark.parametrize(
    ("tokens", "limit", "fanout", "expected"),
    [
        ([30, 30, 100000, 30], 1000, 4, [0, 0, 0, -1]),
        ([200, 200, 300], 500, 4, [0, 0, -1]),
        ([5000, 10, 10], 100, 2, [0, 1, 1]),
        ([10, 10], 100, 4, [-1, -1]),
        ([], 100, 4, []),
    ],
)
def test_chunks(tokens, limit, fanout, expected):
    assert folds.cut_chunks(tokens, limit, fanout) == expected


def select_once(tokens, limit, fanout):
    """One selection by the plain rule: how many of the first rows it takes."""
    n = total = 0
    broke = False
    for t in tokens:
        if n and total + t > limit:
            broke = True
            if t > limit and n < fanout:
                n += 1
            break
        n, total = n + 1, total + t
    return 0 if not broke and n < fanout and not any(t > limit for t in tokens[:n]) else n


def test_chunks_equal_repeated_selection():
    rng = random.Random(5)
    for _ in range(2000):
        tokens = [rng.choice([1, 5, 20, 60, 150]) for _ in range(rng.randint(0, 14))]
        expected, at, k = [-1] * len(tokens), 0, 0
        while at < len(tokens) and (n := select_once(tokens[at:], 100, 3)):
            expected[at : at + n] = [k] * n
            at, k = at + n, k + 1
        assert folds.cut_chunks(tokens, 100, 3) == expected


def test_overlap(spark):
    old = rows(spark, [(1, 1, 1, "user", "a", 1), (2, 1, 2, "assistant", "b", 1), (3, 1, 3, "user", "c", 1)])
    new = rows(spark, [(8, 1, 1, "assistant", "b", 1), (9, 1, 2, "user", "c", 1), (10, 1, 3, "user", "d", 1), (11, 2, 1, "user", "x", 1)])
    assert {tuple(r) for r in folds.overlap(old, new).collect()} == {(1, 2), (2, 0)}


def test_skip_fill_skips_and_goes_on(spark):
    df = spark.createDataFrame([(1, 1, 50, 100.0), (1, 2, 80, 100.0), (1, 3, 50, 100.0), (2, 1, 101, 100.0)], "g int, n int, token_count long, budget double")
    assert sorted((r.g, r.n) for r in folds.skip_fill(df, "g", ["n"], "budget").collect()) == [(1, 1), (1, 3)]


def test_heartbeats(spark):
    data = [(1, 1, 1, "user", "read heartbeat.md", 1), (2, 1, 2, "tool", "x", 1), (3, 1, 3, "assistant", " HEARTBEAT_OK ", 1), (4, 1, 4, "user", "heartbeat.md", 1), (5, 1, 5, "user", "hello", 1), (6, 1, 6, "assistant", "heartbeat_ok", 1)]
    assert sorted(r.id for r in folds.heartbeats(rows(spark, data)).collect()) == [1, 2, 3]


def test_repair(spark):
    data = [(1, 1, 1, "tool", "late", 1, "a", None), (2, 1, 2, "assistant", "call", 1, "a", "f"), (3, 1, 3, "tool", "again", 1, "a", None), (4, 1, 4, "assistant", "call", 1, None, "g"), (5, 1, 5, "tool", "orphan", 1, "zz", None), (6, 1, 6, "user", "end", 1, None, None)]
    m = spark.createDataFrame([(*x, None) for x in data], MESSAGE)
    out = folds.repair_transcript(m).orderBy("place").collect()
    assert [(r.id, r.tool_call_id) for r in out] == [(2, "a"), (1, "a"), (4, "toolu_4_4"), (-1, "toolu_4_4"), (6, None)]


def test_recall_and_graph(spark):
    data = [(i, 1, i, "user", f"note {i} about the café", 100) for i in range(1, 13)]
    m = rows(spark, data)
    g = compaction.sweep(m, SMALL)
    assert g.summaries.where("kind = 'leaf'").count() == 3 and g.summaries.where("depth = 1").count() == 1
    assert all(r.passed for r in integrity.checks(m, g).collect())
    hits = recall.grep(m, g.summaries, "CAFE note", limit=3, scope="messages").collect()
    assert [h.id for h in hits] == ["1", "10", "11"]
    assert recall.grep(m, g.summaries, "note 3?", scope="messages").count() == 0
    assert recall.grep(m, g.summaries, r"note 1\d", scope="messages", mode="regex").count() == 3
    with pytest.raises(PermissionError):
        dag.expand("x", g.summaries, g.parent_edges, g.leaf_edges, m)
    leaf = g.leaf_edges.first().summary_id
    assert dag.expand(leaf, g.summaries, g.parent_edges, g.leaf_edges, m, True).count() == 3
    assert assemble.rendered(assemble.assemble(m, g, Settings(fresh_tail=2, max_context_tokens=2000)), folds.tail(m, 2)).count() == 1


def test_grandchildren_come_back(spark):
    s = spark.createDataFrame([("d", 2), ("c", 1), ("l", 0)], "summary_id string, depth int")
    e = spark.createDataFrame([("d", "c"), ("c", "l")], "parent_id string, child_id string")
    assert [r.summary_id for r in dag.eligible(s, e, 2).collect()] == ["d"]
    assert sorted(r.summary_id for r in dag.eligible(s, e, 2, "parent_of_included").collect()) == ["d", "l"]
    assert {tuple(r) for r in dag.closure(e).collect()} == {("d", "c", 1), ("c", "l", 1), ("d", "l", 2)}


def test_fusion_and_vectors(spark):
    lists = [spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank int") for ids in ("abc", "bda")]
    assert [r.id for r in recall.fuse(lists).orderBy(F.desc("score"), "first").collect()][:2] == ["b", "a"]
    v = spark.createDataFrame([("x", 1, [1.0, 0.0]), ("y", 2, [0.0, 1.0]), ("z", 2, [0.0, 0.0])], "id string, conversation_id long, embedding array<float>")
    assert [r.id for r in recall.vector_top(v, [1.0, 0.1], 5, "id", min_score=0.5).collect()] == ["x"]
    assert recall.vector_top(v, [1.0, 0.1], 5, "id", conversation_ids=[]).count() == 0
    changed = store.upsert_vectors(v, spark.createDataFrame([("x", 9, [0.5, 0.5])], "id string, conversation_id long, embedding array<float>"))
    assert changed.where("id = 'x'").first().conversation_id == 1


def test_text():
    assert recall.sanitise('"a" AND b* NOT (c)') == "a b c"
    j = X.json_text
    assert j('{"message": {"content": [{"type": "text", "text": "hi"}]}}') == "hi" and j("plain") == "plain" and j(None) is None and j("") == ""
    assert j('{"foo": "bar"}') == "bar" and j('{"transcript": "hi", "text": "a", "data": "no"}') == "a\nhi" and j("{}") == "" and j("[]") == ""
    assert j('{"segments": [{"text": "a"}, "b", 3, {"x": " "}], "content": "no"}') == "a\nb" and j('{"payload": {"n": 1}, "a": "s", "b": "t"}') == "s\nt"
    assert j("true") == "True" and j("1.5") == "1.5" and j('"x"') == "x" and j("null") == "null" and j("{bad") == "{bad"
    deep = lambda n: '{"text":' * n + '"z"' + "}" * n
    assert j(deep(6)) == "z" and j(deep(7)) == "" and j("[" * 100000) == "[" * 100000
    assert X.keywords("What did the Parser do with parser tokens") == ["parser", "tokens"]
    assert X.glob_regex("agent:*:**") == "^agent:[^:]*:.*$"


def test_condensed_content_has_its_own_target(spark):
    leaf = "summary_id string, conversation_id long, depth int, content string, token_count long, earliest_at timestamp, latest_at timestamp, kind string, created_at timestamp"
    nodes = spark.createDataFrame([(f"s{i}", 1, 0, chr(97 + i) * 1000, 250, None, None, "leaf", None) for i in range(4)], leaf).withColumn("created_at", F.timestamp_seconds(F.substring("summary_id", 2, 1).cast("long")))
    edges = spark.createDataFrame([], "parent_id string, child_id string")
    whole = "\n".join(chr(97 + i) * 1000 for i in range(4))
    content = lambda *a: compaction.condense(nodes, edges, 0, 2, *a)[0].first().content
    assert Settings().condensed_target_tokens == 2000 and from_env(env={"THREADLOOM_CONDENSED_TARGET_TOKENS": "7"}).condensed_target_tokens == 7
    assert content(2000) == whole and content(100) == whole[:400]
    assert content(100, lambda t: F.concat(F.lit("all: "), F.substring(t, 1, 3))) == "all: aaa"


def test_media(spark):
    df = spark.createDataFrame([("see MEDIA:/tmp/a.png",), ("MEDIA:/a",), ("plain",)], "t string")
    assert [r[0] for r in df.select(X.annotate_media(F.col("t"))).collect()] == ["see [with media attachment]", "[Media attachment]", "plain"]


def media_runs(text):
    """Where media is: (start, end), by hand."""
    out = []
    for kind, mark in ((0, "data:"), (1, "MEDIA:/")):
        at = text.find(mark)
        while at >= 0:
            end = at + len(mark)
            if kind:
                while end < len(text) and not text[end].isspace():
                    end += 1
                good = end > at + len(mark)
            else:
                m = re.match(r"[^\s/;,]+/[^\s,]+?;base64,", text[end:])
                start = end + m.end() if m else 0
                end = start
                while m and end < len(text) and (text[end] in "+/=\n" or (text[end].isascii() and text[end].isalnum())):
                    end += 1
                good = bool(m) and end - start >= 20
            out += [(at, end)] if good else []
            at = text.find(mark, end if good else at + 1)
        if out:
            return out
    return out


def annotated(text):
    """annotate_media by taking kind after kind out of the text."""
    if text is None:
        return None
    found = False
    for pattern in (None, r"(?:[0-9a-fA-F]{2}\s*){32,}", r"[\x80-\xff]{16,}"):
        if pattern is None:
            while runs := media_runs(text):
                found, text = True, text[: runs[0][0]] + text[runs[0][1] :]
        else:
            found, text = found or bool(re.search(pattern, text)), re.sub(pattern, "", text)
    if not found:
        return text
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return text + " [with media attachment]" if text else "[Media attachment]"


def test_media_of_all_documents(spark, tmp_path):
    url, dump, latin = "data:image/png;base64," + "aGk+" * 9, "0a 1B\n" * 16, "é" * 16
    texts = [None, "", " ", "plain", url, f"a {url}\nb", "MEDIA:/x/y.png", "see MEDIA:/x\xa0and\x1cMEDIA:/y on", dump, f"q\n{dump}\n\n\nz", dump[:-3], "0a\u2003" * 32, "ab" * 20000 + "z", latin, latin[1:], f"\x1c{latin}\u3000", f"x {latin} MEDIA:/z {url} {dump}", f"a\n\n{latin}\n\n\nb"]
    rng = random.Random(7)
    texts += ["".join(rng.choice([url, "MEDIA:/", "0a", "fF " * 31, latin, "é" * 15, "g", " ", "\n", "\xa0", "\x1f"]) for _ in range(rng.randint(0, 9))) for _ in range(500)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r.annotated for r in QUERIES["media_annotate"](spark, str(tmp_path)).collect()}
    assert found == {i: annotated(t) for i, t in enumerate(texts)}
    assert sum(found[i] != t for i, t in enumerate(texts)) > 200


def test_questions_that_ask_for_more(spark):
    asked = {"all \n time": "b", "Since may": "b", "my History": "b", "sincere": "", None: "", "over\u2003the  past": "b", "how did rain affect it": "m", "How did élan affect it": "m", "how did it not affect it": "", "COMPARE everything": "bm"}
    rows = spark.createDataFrame([(q,) for q in asked], "q string").select("q", X.asks(F.col("q"), X.BROAD_TIME).alias("b"), X.asks(F.col("q"), X.MULTI_HOP).alias("m"))
    assert {r.q: "b" * r.b + "m" * r.m for r in rows.collect()} == asked


def test_substrings_and_patterns_of_any_kind(spark):
    rows = spark.createDataFrame([(1, "C:\\dir\\x"), (2, "c:/dir"), (3, "nun"), (4, "a\nb"), (5, None), (6, "\u0667 x")], "id long, content string")
    ids = lambda x: [r.id for r in x.orderBy("id").collect()]
    assert ids(recall.like(rows, ["content"], "c:\\DIR")) == [1] and ids(recall.like(rows, ["content"], "\\")) == [1] and ids(recall.like(rows, ["content"], "c:_dir")) == [1, 2]
    assert ids(recall.regex(rows, "content", "(?P<a>n)u(?P=a)")) == [3] and ids(recall.regex(rows, "content", "(?P<my_a>n)u(?P=my_a)")) == [3]
    assert ids(recall.regex(rows, "content", r"\d")) == [6] and ids(recall.regex(rows, "content", "(c)?(?(1):|C:)")) == [1, 2]
    with pytest.raises(re.error):
        recall.regex(rows, "content", "(")


def test_accents_of_one_or_two_characters(spark):
    import unicodedata

    rows = spark.createDataFrame([(1, "el ñame verde"), (2, unicodedata.normalize("NFD", "el ñame")), (3, "el name"), (4, "na me"), (5, "Việt Nam")], "id long, content string")
    for q in ("ñame", unicodedata.normalize("NFD", "ÑAME"), "name"):
        assert {r.id for r in recall.bm25(rows, "content", recall.query_terms(q)).collect()} == {1, 2, 3}
    assert [r.id for r in recall.bm25(rows, "content", recall.query_terms("viet")).collect()] == [5]


def test_policy_grants_breaker(spark):
    assert expansion.decide("x", 1, 5000) == "shallow" and expansion.decide("history", 4, 5000) == "delegate" and expansion.decide("x", 0, 1) == "direct"
    g = expansion.Grant("me", [1], token_cap=10)
    assert g.allows(1) and not g.allows(2) and g.consume(10) and not g.valid()
    t = [0.0]
    b = expansion.CircuitBreaker(2, 5, lambda: t[0])
    b.failed("k"), b.failed("k")
    assert not b.allows("k")
    t[0] = 6
    assert b.allows("k")
    assert from_env(env={"THREADLOOM_FRESH_TAIL": "3"}).fresh_tail == 3


def test_grants():
    t = [0.0]
    g = expansion.Grants(lambda: t[0])
    a, b = g.create("me", [1], ttl=5, token_cap=10), g.create("me", [2])
    assert g.allows(a.grant_id, 1) and not g.allows(a.grant_id, 2) and g.consume(a.grant_id, 4) and not g.consume(a.grant_id, 7)
    assert g.revoke(b.grant_id) and not g.valid(b.grant_id) and not g.revoke("none")
    t[0] = 5
    assert not g.valid(a.grant_id) and g.clean_up() == 2 and not g.valid(a.grant_id)


def test_repair_of_repeated_calls(spark):
    data = [(1, 1, 1, "assistant", "call", 1, "a", "f"), (2, 1, 2, "assistant", "again", 1, "a", "f"), (3, 1, 3, "tool", "out", 1, "a", None)]
    out = folds.repair_transcript(spark.createDataFrame([(*x, None) for x in data], MESSAGE)).orderBy("place").collect()
    assert [r.id for r in out] == [1, 3, 2]


def test_summaries_are_appended(spark):
    found = spark.createDataFrame([("m1", 0), ("s1", 1)], "id string, place int")
    hits = spark.createDataFrame([("s1", 0.9), ("s2", 0.5), ("s3", 0.8), ("gone", 0.7)], "id string, score double")
    known = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "summary_id string")
    assert [r.id for r in recall.append_summaries(found, hits, known, 3).collect()] == ["m1", "s1", "s3"]


def test_failed_embeddings_stay_open(spark):
    from threadloom.streaming import ingest

    m = spark.createDataFrame([(1, 7, "a"), (2, 7, " \t\n"), (3, 8, "boom")], "id long, conversation_id long, content string")

    def embed(texts):
        if "boom" in texts:
            raise OSError
        return [[1.0] for _ in texts]

    done, failed = ingest.settled(ingest.backfill(m, m.limit(0).select("id"), embed, batch=1))
    assert [r.id for r in done.collect()] == [1] and [tuple(r) for r in failed.collect()] == [(8, 1)]


def test_state_goes_on(spark, tmp_path):
    from threadloom.streaming import ingest

    schema = "user_id long, ts timestamp"
    for k in range(2):
        spark.createDataFrame([(u, None) for u in (1, 1, 2 + k)], schema).withColumn("ts", F.timestamp_seconds(F.lit(k))).write.mode("append").parquet(str(tmp_path / "in"))
        out = ingest.event_state(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, str(tmp_path / "ck"), str(tmp_path / "out"))
    assert {(r.user_id, r.events) for r in out.collect()} == {(1, 4), (2, 1), (3, 1)}


def test_hard_fanout_and_until_none(spark):
    m = rows(spark, [(i, 1, i, "user", f"note {i}", 100) for i in range(1, 13)])
    wide = Settings(fresh_tail=2, leaf_chunk_tokens=300, leaf_min_fanout=2, condensed_min_fanout=4)
    soft, hard = compaction.sweep(m, wide), compaction.sweep(m, wide, hard=True)
    assert soft.summaries.where("depth > 0").count() == 0 and hard.summaries.where("depth = 1").count() == 1
    again = compaction.sweep(m, wide, hard)
    assert again.summaries.count() == hard.summaries.count() and compaction.incremental(m, wide, hard, 0).summaries.count() == hard.summaries.count()


def test_incremental_leaves_the_others_alone(spark):
    m = rows(spark, [(100 * c + i, c, i, "user", f"note {c} {i}", 100 if c == 1 else 10) for c in (1, 2) for i in range(1, 13)])
    settings = Settings(fresh_tail=2, leaf_chunk_tokens=20, leaf_min_fanout=1, condensed_min_fanout=2)
    quiet = compaction.sweep(m.where("conversation_id = 2"), settings, levels=0)
    assert quiet.summaries.count() >= 2
    g = compaction.incremental(m, settings, quiet, 1000)
    made = {(r.conversation_id, r.kind) for r in g.summaries.collect()}
    assert made == {(1, "leaf"), (1, "condensed"), (2, "leaf")} and g.summaries.where("conversation_id = 2").count() == quiet.summaries.count()
    assert g.leaf_edges.count() == g.leaf_edges.distinct().count()


def test_memory(spark):
    from threadloom.plans.api import Memory

    m = Memory(rows(spark, [(i, 1, i, "user", f"note {i} on rain", 100) for i in range(1, 9)]), SMALL).compact()
    m = m.ingest(rows(spark, [(8, 1, 1, "user", "note 8 on rain", 100), (20, 1, 2, "user", "new snow", 100)]))
    assert m.messages.count() == 9 and m.messages.where("seq = 9").first().content == "new snow"
    assert m.search("snow", scope="messages").count() == 1 and m.compact().stats().count() >= 1
    assert all(r.passed for r in m.check().collect()) and m.context().count() == 1
    leaf = m.graph.leaf_edges.first().summary_id
    assert m.describe(leaf).first().source_message_count > 0 and m.expand(leaf, True).count() > 0


def test_urgency(spark):
    df = spark.createDataFrame([(500,), (600,), (850,)], "t long")
    assert [r[0] for r in df.select(compaction.urgency(F.col("t"), 1000, 0.6, 0.85)).collect()] == ["NONE", "ASYNC", "BLOCKING"]


def test_sqlite_source(spark, tmp_path):
    import sqlite3

    from threadloom.sources.transcripts import SqliteSource

    c = sqlite3.connect(tmp_path / "s.db")
    c.execute("CREATE TABLE messages (id INTEGER PRIMARY KEY, content TEXT)")
    c.executemany("INSERT INTO messages VALUES (?, ?)", [(i, f"m{i}") for i in range(10)])
    c.commit()
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlite_store").option("path", str(tmp_path / "s.db")).option("table", "messages").option("schema", "id bigint, content string").load()
    assert df.count() == 10


def test_transcript(spark, tmp_path):
    from threadloom.sources.transcripts import transcript

    lines = ['{"type":"user","message":{"role":"user","content":"hello"}}', "broken", '{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"a"},{"type":"tool_use","text":"no"}]}}', '{"type":"user","message":{"role":"user","content":"<system-reminder>x"}}', '{"type":"system","message":{"role":"user","content":"no"}}']
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    assert [(r.role, r.content) for r in transcript(spark, str(tmp_path / "t.jsonl")).orderBy("line").collect()] == [("user", "hello"), ("assistant", "a")]
