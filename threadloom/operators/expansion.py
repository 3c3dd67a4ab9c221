"""Deciding on, permitting and running the expansion of summaries for a question."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import BROAD_TIME, MULTI_HOP, asks, keywords
from threadloom.operators import recall
from threadloom.operators.compaction import Dag


def policy(query: Column, candidates: Column, budget: Column, depth: Column | None = None) -> Column:
    """direct, shallow or delegate for each row, from an estimate of 500 tokens a candidate against the budget.

    Questions about a long time count one and a half times, those that need several sources (or have five
    candidates or more) 1.3 times. Without candidates, or inside an expansion, the answer is direct.
    """
    broad = F.when(asks(query, BROAD_TIME), 1.5).otherwise(1.0)
    several = F.when((candidates >= 5) | asks(query, MULTI_HOP), 1.3).otherwise(1.0)
    ratio = F.when(budget > 0, F.lit(500.0) * candidates * broad * several / budget).otherwise(F.lit(float("inf")))
    few = (ratio < 0.35) | ((ratio <= 0.7) & (candidates <= 3))
    direct = (candidates <= 0) if depth is None else (candidates <= 0) | (depth >= 1)
    return F.when(direct, "direct").when(few, "shallow").otherwise("delegate")


def decide(query: str, candidates: int, budget: int, depth: int = 0) -> str:
    """The policy for a single question."""
    row = SparkSession.active().range(1).select(policy(F.lit(query), F.lit(candidates), F.lit(budget), F.lit(depth)))
    return row.first()[0]


@dataclass
class Grant:
    issuer: str
    conversations: list[int]
    summaries: list[str] | None = None
    max_depth: int = 1
    token_cap: int = 8000
    expires_at: float = 0.0
    used: int = 0
    revoked: bool = False
    grant_id: str = field(default_factory=lambda: str(uuid.uuid4()))

    @property
    def remaining(self) -> int:
        return max(0, self.token_cap - self.used)

    def valid(self, now: float | None = None) -> bool:
        return not self.revoked and self.remaining > 0 and (not self.expires_at or (time.time() if now is None else now) < self.expires_at)

    def allows(self, conversation_id: int, summary_id: str | None = None) -> bool:
        return conversation_id in self.conversations and (summary_id is None or self.summaries is None or summary_id in self.summaries)

    def consume(self, tokens: int) -> bool:
        if tokens > self.remaining:
            return False
        self.used += tokens
        return True


class Grants:
    """The grants that were given out: create, look up, check, spend, revoke, clean up."""

    def __init__(self, clock: Callable[[], float] = time.time):
        self.clock, self.held = clock, {}

    def create(self, issuer: str, conversations: list[int], ttl: float = 0.0, **options) -> Grant:
        g = Grant(issuer, list(conversations), expires_at=self.clock() + ttl if ttl else 0.0, **options)
        self.held[g.grant_id] = g
        return g

    def valid(self, grant_id: str) -> bool:
        return grant_id in self.held and self.held[grant_id].valid(self.clock())

    def allows(self, grant_id: str, conversation_id: int, summary_id: str | None = None) -> bool:
        return self.valid(grant_id) and self.held[grant_id].allows(conversation_id, summary_id)

    def consume(self, grant_id: str, tokens: int) -> bool:
        return self.valid(grant_id) and self.held[grant_id].consume(tokens)

    def revoke(self, grant_id: str) -> bool:
        if grant_id not in self.held:
            return False
        self.held[grant_id].revoked = True
        return True

    def clean_up(self) -> int:
        """Forgets grants that are revoked or expired (those that are spent stay); how many."""
        now = self.clock()
        gone = [k for k, g in self.held.items() if g.revoked or (g.expires_at and now >= g.expires_at)]
        for k in gone:
            del self.held[k]
        return len(gone)


class CircuitBreaker:
    """Opens for a key after so many failures, until the cooldown is over."""

    def __init__(self, failures: int = 5, cooldown: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.cooldown, self.clock, self.state = failures, cooldown, clock, {}

    def allows(self, key: str) -> bool:
        n, at = self.state.get(key, (0, 0.0))
        return n < self.most or self.clock() - at >= self.cooldown

    def failed(self, key: str) -> None:
        self.state[key] = (self.state.get(key, (0, 0.0))[0] + 1, self.clock())

    def succeeded(self, key: str) -> None:
        self.state.pop(key, None)


def may_delegate(task: str, parent_task: str, retained: str, *, root: bool = False, read_only: bool = False, parallel: bool = False) -> bool:
    """Whether a task may be handed down: it and what is retained aren't empty, and it isn't the parent's own."""
    return root or read_only or parallel or bool(task.strip() and retained.strip() and task.strip() != parent_task.strip())


def expand_query(messages: DataFrame, graph: Dag, question: str, grant: Grant, conversation_id: int, answer: Callable[[str], str], steps: int = 10) -> dict:
    """Searches, expands at most five summaries in one job, and lets ``answer`` write from what was found."""
    if not grant.valid() or not grant.allows(conversation_id):
        return {"answer": "", "cited": [], "tokens": 0, "steps": 0, "reason": "not permitted"}
    found = recall.grep(messages, graph.summaries, question, "summaries", conversation_id, limit=5)
    ids = [r.id for r in found.select("id").collect()]
    taken = 1
    if not ids and (words := keywords(question)):
        here = graph.summaries.where(graph.summaries.conversation_id == conversation_id).withColumnRenamed("summary_id", "id")
        ids, taken = [r.id for r in recall.any_keyword(here, words, 5).collect()], 2
    if decide(question, len(ids), grant.remaining) == "direct":
        return {"answer": answer(question), "cited": [], "tokens": 0, "steps": taken, "reason": "nothing to expand"}
    ids = [i for i in ids if grant.allows(conversation_id, i)][: steps - taken]
    edges = graph.leaf_edges.where(graph.leaf_edges.summary_id.isin(ids))
    rows = edges.join(messages, edges.message_id == messages.id).orderBy("summary_id", "seq").select("content").collect()  # of five leaves at most, each of a chunk
    text = answer("\n".join(r.content for r in rows))
    grant.consume(min(grant.remaining, len(text)))
    return {"answer": text, "cited": ids, "tokens": len(text), "steps": taken + len(ids), "reason": "expanded"}
