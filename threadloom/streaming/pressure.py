"""Compaction as messages arrive: the state of each conversation is what its context holds.

State is keyed by conversation (RocksDB): messages that no leaf has, and summaries without a parent. Both count
against the context limit, so pressure itself bounds them. After each message, in the order of ``seq``, the urgency
decides: at the soft threshold one leaf and one node over leaves, at the hard one sweeps until the conversation is
under. So the nodes don't depend on how the stream was cut into batches. A timer closes conversations that are idle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.config import Settings
from threadloom.operators.compaction import Model, message_line
from threadloom.operators.folds import cut_chunks

NODES = "conversation_id BIGINT, summary_id STRING, kind STRING, depth INT, content STRING, token_count BIGINT, source_token_count BIGINT, earliest_at TIMESTAMP, latest_at TIMESTAMP, created_at TIMESTAMP, sources ARRAY<STRING>"
#: The same with times in microseconds, as state and processor hold them.
RAW = NODES.replace("TIMESTAMP", "BIGINT")
TIMES = ("earliest_at", "latest_at", "created_at")
#: Settings of a session that runs such a stream; all stores of an executor share one bound of memory.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


class Message(NamedTuple):
    id: int
    seq: int
    token_count: int
    created_at: int | None
    line: str


class Root(NamedTuple):
    summary_id: str
    depth: int
    token_count: int
    earliest_at: int | None
    latest_at: int | None
    created_at: int | None
    content: str


@dataclass
class Context:
    """A conversation's pending messages and roots, and the nodes that were made of them since ``take``."""

    conversation_id: int
    settings: Settings
    limit: int
    pending: list[Message] = field(default_factory=list)
    roots: list[Root] = field(default_factory=list)
    made: list[tuple] = field(default_factory=list)
    writer: object = None

    def tokens(self) -> int:
        return sum(m.token_count for m in self.pending) + sum(r.token_count for r in self.roots)

    def ratio(self) -> float:
        return self.tokens() / self.limit if self.limit > 0 else 0.0

    def add(self, message: Message) -> None:
        s = self.settings
        self.pending.append(message)
        if self.ratio() >= s.hard_ratio:
            for _ in range(10):
                before, n = self.tokens(), len(self.made)
                self.sweep()
                if self.ratio() < s.soft_ratio or len(self.made) == n or self.tokens() >= before:
                    break
        elif self.ratio() >= s.soft_ratio:
            self.leaf()
            self.node(0, s.condensed_min_fanout)

    def sweep(self) -> None:
        s, depth = self.settings, 0
        while self.leaf():
            pass
        while self.node(depth, min(s.condensed_min_fanout, s.condensed_hard_fanout)):
            depth += 1

    def leaf(self) -> bool:
        s = self.settings
        free = self.pending[: max(0, len(self.pending) - s.fresh_tail)]
        size = cut_chunks([m.token_count for m in free], s.leaf_chunk_tokens, s.leaf_min_fanout).count(0)
        if not size:
            return False
        chunk, self.pending = free[:size], self.pending[size:]
        content = self._written("\n".join(m.line for m in chunk), s.leaf_target_tokens, 0)
        key = f"{self.conversation_id}:{chunk[0].seq}:{chunk[-1].seq}"
        self._made("leaf", key, 0, content, sum(m.token_count for m in chunk), chunk[0].created_at, chunk[-1].created_at, chunk[-1].created_at, [str(m.id) for m in chunk])
        return True

    def node(self, depth: int, fanout: int) -> bool:
        kids = sorted((r for r in self.roots if r.depth == depth), key=lambda r: (r.created_at is not None, r.created_at or 0, r.summary_id))
        if len(kids) < fanout or not kids:
            return False
        self.roots = [r for r in self.roots if r.depth != depth]
        content = self._written("\n".join(r.content for r in kids), self.settings.condensed_target_tokens, depth + 1)
        ids = [r.summary_id for r in kids]
        self._made("condensed", ",".join(ids), depth + 1, content, sum(r.token_count for r in kids), kids[0].earliest_at, kids[-1].latest_at, kids[-1].created_at, ids)
        return True

    def _written(self, text: str, target: int, depth: int) -> str:
        if self.writer is not None:
            return self.writer(target).write(text, depth, "")[0]
        return text[: target * 4]

    def _made(self, kind, key, depth, content, source_tokens, earliest, latest, created, sources) -> None:
        sid = "sum_" + hashlib.sha256(key.encode()).hexdigest()[:12]
        self.roots.append(Root(sid, depth, len(content) // 4, earliest, latest, created, content))
        self.made.append((self.conversation_id, sid, kind, depth, content, len(content) // 4, source_tokens, earliest, latest, created, sources))


class Processor(StatefulProcessor):
    def __init__(self, settings: Settings, limit: int, idle_ms: int | None = None, model: Model | None = None):
        self.settings, self.limit, self.idle_ms, self.model = settings, limit, idle_ms, model

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "id BIGINT, seq BIGINT, token_count BIGINT, created_at BIGINT, line STRING")
        self.roots = handle.getListState("roots", "summary_id STRING, depth INT, token_count BIGINT, earliest_at BIGINT, latest_at BIGINT, created_at BIGINT, content STRING")
        self.writers: dict = {}

    def _writer(self, target: int):
        from threadloom.operators.summaries import Writer

        if target not in self.writers:
            self.writers[target] = Writer(self.model.make(), self.model.effort(target))
        return self.writers[target]

    def _load(self, key) -> Context:
        return Context(key[0], self.settings, self.limit, [Message(*x) for x in self.pending.get()], [Root(*x) for x in self.roots.get()], writer=self.model and self._writer)

    def _store(self, context: Context) -> Iterator[Row]:
        for state, rows in ((self.pending, context.pending), (self.roots, context.roots)):
            if rows:
                state.put([tuple(x) for x in rows])
            else:
                state.clear()
        node = Row(*[field.split()[0] for field in RAW.split(", ")])
        yield from (node(*x) for x in context.made)

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        context = self._load(key)
        for r in sorted(rows, key=lambda r: r.seq):
            context.add(Message(r.id, r.seq, r.token_count, r.created_at, r.line))
        if self.idle_ms is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield from self._store(context)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        context = self._load(key)
        context.sweep()
        yield from self._store(context)

    def close(self) -> None:
        pass


def compacted(messages: DataFrame, settings: Settings, limit: int, idle_ms: int | None = None, model: Model | None = None) -> DataFrame:
    """A stream of new graph nodes, with their sources (ids of messages or children), from a stream of messages.

    Messages of a conversation must arrive in the order of ``seq`` from batch to batch; inside a batch they are put in
    order (a batch's rows of one conversation meet in one task: the source's limits per trigger bound them). A null
    content counts as empty. With ``idle_ms``, a conversation without a message for so long is swept as far as it goes.
    The session needs ``STATE_CONF``.
    """
    text = messages.withColumn("content", F.coalesce("content", F.lit("")))
    rows = text.select("conversation_id", "id", F.col("seq").cast("long").alias("seq"), F.col("token_count").cast("long").alias("token_count"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("created_at"), message_line(settings.leaf_chunk_tokens).alias("line"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    nodes = rows.groupBy("conversation_id").transformWithState(Processor(settings, limit, idle_ms, model), RAW, "Append", mode)
    return nodes.withColumns({c: F.timestamp_micros(c) for c in TIMES})


def edges(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges of stored nodes: (summary_id, message_id) and (parent_id, child_id)."""
    of = nodes.select("summary_id", "kind", F.explode("sources").alias("x"))
    return of.where("kind = 'leaf'").select("summary_id", F.col("x").cast("long").alias("message_id")), of.where("kind = 'condensed'").select(F.col("summary_id").alias("parent_id"), F.col("x").alias("child_id"))
