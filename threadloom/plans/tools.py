"""The tools that a host's model may call, and the hooks by which a host drives a store.

A ``Host`` holds the store of many sessions and is their single writer; changes are appended rows.
"""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import aggregates, assemble, compaction, recall, store
from threadloom.operators.compaction import Dag
from threadloom.operators.expansion import Grant, expand_query
from threadloom.plans.api import Memory
from threadloom.sources.scratch import saved
from threadloom.sources.tables import SCHEMAS
from threadloom.streaming.ingest import backfill, settled

#: Names of the tools.
TOOLS = ("grep", "describe", "expand", "stats", "expand_query", "ingest", "compact", "get_context", "session_end", "backfill")
RECALL_POLICY = "Earlier parts of this conversation may be summaries. Search them with grep, look at one with describe, and read the original messages with expand before you rely on details."


@runtime_checkable
class Adapter(Protocol):
    """What a host calls, turn by turn."""

    def on_turn_start(self, session_key: str, user_message: str) -> str | None: ...

    def on_turn_end(self, session_key: str, messages: list[dict]) -> None: ...

    def on_session_end(self, session_key: str) -> None: ...

    def get_tools(self) -> list[dict]: ...

    def handle_tool_call(self, name: str, arguments: dict) -> str: ...

    def system_block(self) -> str: ...


def rows_of(df: DataFrame) -> list[dict]:
    """A short result as plain values, by Spark's JSON."""
    return [json.loads(r.j) for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("j")).collect()]


class Host:
    """A store with sessions by key. ``answer`` writes answers from texts, ``embed`` makes vectors of texts."""

    def __init__(self, memory: Memory, conversations: DataFrame | None = None, answer: Callable[[str], str] | None = None, embed: Callable | None = None):
        spark = memory.messages.sparkSession
        self.spark, self.memory, self.answer, self.embed = spark, memory, answer, embed
        self.conversations = spark.createDataFrame([], SCHEMAS["conversations"]) if conversations is None else conversations
        self.vectors = spark.createDataFrame([], SCHEMAS["embeddings"])
        self.summary_vectors = spark.createDataFrame([], SCHEMAS["embeddings"])
        if memory.graph is None:
            none = compaction.leaves(memory.messages.limit(0), memory.settings)
            self._keep(Dag(*none, spark.createDataFrame([], SCHEMAS["summary_parents"])))

    def _keep(self, graph: Dag, messages: DataFrame | None = None) -> None:
        m = self.memory
        self.memory = Memory(m.messages if messages is None else messages, m.settings, graph, m.ignored)

    def session(self, session_key: str) -> int:
        """The id of the active conversation of a key, which is made if there is none."""
        mine = self.conversations.where((F.col("session_key") == session_key) & F.col("active"))
        found = mine.agg(F.max("id")).first()[0]
        if found is None:
            keys = self.spark.createDataFrame([(session_key, "")], "session_key string, title string")
            new = saved(store.get_or_create(self.conversations, keys, datetime.now(timezone.utc).replace(tzinfo=None)), "conversation")
            self.conversations = self.conversations.unionByName(new, allowMissingColumns=True)
            found = new.first().id
        return found

    def _of(self, conversation_id: int) -> tuple[DataFrame, Dag]:
        here = F.col("conversation_id") == conversation_id
        g = self.memory.graph
        return self.memory.messages.where(here), Dag(g.summaries.where(here), g.leaf_edges, g.parent_edges)

    def _put(self, conversation_id: int, graph: Dag) -> None:
        """A conversation's new graph in the place of its old one."""
        others = self.memory.graph.summaries.where(F.col("conversation_id") != conversation_id)
        self._keep(Dag(others.unionByName(graph.summaries), graph.leaf_edges, graph.parent_edges))

    # tools

    def grep(self, query: str, scope: str = "all", conversation_id: int | None = None, limit: int = 20) -> DataFrame:
        """Searches messages and summaries for all words of a query, and with an embedder by nearness too."""
        m, nodes = self.memory.messages, self.memory.graph.summaries
        if self.embed is None:
            return recall.grep(m, nodes, query, scope, conversation_id, limit)
        return recall.hybrid_grep(m, nodes, query, self.embed([query])[0], self.vectors, self._summary_vectors(), scope, conversation_id, limit)

    def _summary_vectors(self) -> DataFrame:
        """Vectors of all summaries: those that have none are embedded first; failures stay to be embedded."""
        rows = self.memory.graph.summaries.select(F.col("summary_id").alias("id"), "conversation_id", "content")
        made, _ = settled(saved(backfill(rows, self.summary_vectors, self.embed), "summary-vectors"))
        if not made.isEmpty():
            self.summary_vectors = self.summary_vectors.unionByName(made, allowMissingColumns=True)
        return self.summary_vectors

    def describe(self, summary_id: str) -> DataFrame:
        """Tells what a summary covers, without its sources."""
        return self.memory.describe(summary_id)

    def expand(self, summary_id: str) -> DataFrame:
        """Gives the messages or summaries that a summary was made of, to the host's sub-agent."""
        return self.memory.expand(summary_id, is_sub_agent=True)

    def stats(self) -> DataFrame:
        """Counts summaries and their tokens by depth."""
        return aggregates.by_depth(self.memory.graph.summaries)

    def expand_query(self, conversation_id: int, query: str) -> dict:
        """Answers a question from the parts of a conversation that it is about."""
        if self.answer is None:
            return {"answer": "", "cited": [], "tokens": 0, "steps": 0, "reason": "no answerer"}
        return expand_query(self.memory.messages, self.memory.graph, query, Grant("tool", [conversation_id]), conversation_id, self.answer)

    def ingest(self, session_key: str, messages: list[dict]) -> dict:
        """Appends messages to a session, which is made if it is new."""
        who = self.session(session_key)
        if not messages:
            return {"conversation_id": who, "ingested": 0}
        size = lambda m: m["token_count"] if m.get("token_count") is not None else len(m.get("content") or "") // 4
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        data = [(i, m["role"], m.get("content") or "", size(m), m.get("tool_call_id"), m.get("tool_name")) for i, m in enumerate(messages)]
        new = self.spark.createDataFrame(data, "n long, role string, content string, token_count long, tool_call_id string, tool_name string")
        new = new.withColumn("conversation_id", F.lit(who)).withColumn("created_at", F.lit(now).cast("timestamp")).withColumnRenamed("n", "place")
        mine = self.memory.messages.where(F.col("conversation_id") == who)
        numbered = store.append_messages(mine, new, "place").withColumn("id", F.xxhash64("conversation_id", "seq"))
        fresh = saved(numbered.select("id", "conversation_id", F.col("seq").cast("long").alias("seq"), "role", "content", "token_count", "tool_call_id", "tool_name", "created_at"), "messages")
        self._keep(self.memory.graph, self.memory.messages.unionByName(fresh, allowMissingColumns=True))
        return {"conversation_id": who, "ingested": len(messages)}

    def compact(self, session_key: str) -> dict:
        """Compacts a session as far as it goes."""
        who = self.session(session_key)
        rows, graph = self._of(who)
        before = graph.summaries.count()
        made = compaction.sweep(rows, self.memory.settings, graph)
        self._put(who, made)
        return {"conversation_id": who, "created": made.summaries.count() - before}

    def get_context(self, session_key: str, max_tokens: int = 100_000) -> str | None:
        """Gives a session's summaries and latest messages as one text; null for an empty session."""
        from dataclasses import replace

        rows, graph = self._of(self.session(session_key))
        settings = replace(self.memory.settings, max_context_tokens=max_tokens)
        text = Memory(rows, settings, graph).context().first()
        return text.context if text and text.context.strip() else None

    def session_end(self, session_key: str) -> dict:
        """Compacts a session for the last time; its conversation is inactive from now on."""
        done = self.compact(session_key)
        self.conversations = store.deactivate(self.conversations, [done["conversation_id"]])
        return done | {"active": False}

    def backfill(self, batch_size: int = 256, conversation_id: int | None = None) -> dict:
        """Makes vectors of the messages that have none."""
        if self.embed is None:
            return {"embedded": 0, "failed": 0, "reason": "no embedder"}
        rows = self.memory.messages if conversation_id is None else self.memory.messages.where(F.col("conversation_id") == conversation_id)
        todo = rows.withColumn("id", F.col("id").cast("string"))
        made, failed = settled(saved(backfill(todo, self.vectors, self.embed, batch_size), "vectors"))
        counts = {"embedded": made.count(), "failed": failed.agg(F.coalesce(F.sum("failed"), F.lit(0))).first()[0]}
        self.vectors = store.upsert_vectors(self.vectors, made)
        return counts

    # hooks

    def get_tools(self) -> list[dict]:
        """The tools in the form of function calls: names, purposes and parameters, taken from the methods."""
        kinds = {"str": "string", "int": "integer", "list[dict]": "array"}
        out = []
        for name in TOOLS:
            method = getattr(self, name)
            given = inspect.signature(method).parameters.values()
            shapes = {p.name: {"type": kinds[str(p.annotation).split(" | ")[0]]} | ({} if p.default is p.empty else {"default": p.default}) for p in given}
            needed = [p.name for p in given if p.default is p.empty]
            out.append({"type": "function", "function": {"name": name, "description": inspect.getdoc(method), "parameters": {"type": "object", "properties": shapes, "required": needed}}})
        return out

    def handle_tool_call(self, name: str, arguments: dict) -> str:
        """The result of a tool as JSON; an unknown tool or wrong arguments give an error as JSON."""
        if name not in TOOLS:
            return json.dumps({"error": f"unknown tool: {name}"})
        method = getattr(self, name)
        try:
            inspect.signature(method).bind(**arguments)
        except TypeError as e:
            return json.dumps({"error": str(e)})
        result = method(**arguments)
        return json.dumps(rows_of(result) if isinstance(result, DataFrame) else result)

    def system_block(self) -> str:
        return RECALL_POLICY

    def on_turn_start(self, session_key: str, user_message: str) -> str | None:
        return self.prefetch(session_key, user_message)

    def on_turn_end(self, session_key: str, messages: list[dict]) -> None:
        """Stores a turn's messages and compacts the session if it is under pressure."""
        who = self.ingest(session_key, messages)["conversation_id"]
        rows, graph = self._of(who)
        self._put(who, compaction.incremental(rows, self.memory.settings, graph, self.memory.settings.effective_max_tokens))

    def on_session_end(self, session_key: str) -> None:
        self.session_end(session_key)

    # what some hosts call besides

    def store_message(self, session_key: str, role: str, content: str, **more) -> None:
        self.ingest(session_key, [{"role": role, "content": content} | more])

    def force_compact(self, session_key: str) -> None:
        self.compact(session_key)

    def session_stats(self, session_key: str) -> dict:
        rows, graph = self._of(self.session(session_key))
        m = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).first()
        return {"messages": m.n, "tokens": m.t, "summaries_by_depth": dict(graph.summaries.groupBy("depth").count().collect())}

    def prefetch(self, session_key: str, query: str = "") -> str | None:
        """Context before a turn: a note if much is compacted, what other sessions know about the query, then the session.

        Null for ignored and empty sessions.
        """
        from threadloom.functions.text import matches_globs

        if self.memory.ignored and self.spark.range(1).select(matches_globs(F.lit(session_key), list(self.memory.ignored))).first()[0]:
            return None
        who = self.session(session_key)
        rows, graph = self._of(who)
        levels = graph.summaries.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("d"), F.count_if(F.col("kind") == "condensed").alias("c"))
        note = levels.select(assemble.compaction_note(F.col("d"), F.col("c"))).first()[0]
        text = Memory(rows, self.memory.settings, graph).context(query or None).first()
        parts = [note, self._elsewhere(who, query), text and text.context]
        return "\n\n".join(p for p in parts if p and p.strip()) or None

    def _elsewhere(self, conversation_id: int, query: str) -> str | None:
        """The summaries of other sessions that are nearest to a query and fit their budget."""
        if self.embed is None or not query:
            return None
        s = self.memory.settings
        near = recall.vector_top(self._summary_vectors(), self.embed([query])[0], 10, "id", exclude=conversation_id)
        taken = assemble.cross_session(near.select("id", "score"), self.memory.graph.summaries, s.cross_session_min_score, s.cross_session_tokens)
        return "\n\n".join(r.content for r in taken.orderBy("place").select("content").collect()) or None  # ten at most

    def sync_turn(self, session_key: str, messages: list[dict]) -> None:
        self.on_turn_end(session_key, messages)

    def before_compression(self, session_key: str) -> bool:
        """Compacts until the session fits; true, as the host's own compression isn't needed then."""
        who = self.session(session_key)
        rows, graph = self._of(who)
        self._put(who, compaction.until_under(rows, self.memory.settings, self.memory.settings.effective_max_tokens, graph))
        return True


def adapter(kind: str, memory: Memory, **options) -> Adapter:
    """A host by name: ``generic``, or ``simple`` without vectors and answers."""
    if kind == "generic":
        return Host(memory, **options)
    if kind == "simple":
        return Host(memory, options.get("conversations"))
    raise ValueError(f"unknown kind of host: {kind}; known are generic and simple")
