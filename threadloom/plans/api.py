"""A store as one object: ingest, search, compact, context, expand, statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.functions.text import matches_globs
from threadloom.operators import aggregates, assemble, compaction, dag, integrity, recall, store
from threadloom.streaming.ingest import new_rows


@dataclass
class Memory:
    """Immutable: each change returns a new object over new DataFrames."""

    messages: DataFrame
    settings: Settings = field(default_factory=Settings)
    graph: compaction.Dag | None = None
    ignored: tuple[str, ...] = ()

    def ingest(self, rows: DataFrame, order: str = "seq") -> Memory:
        """Appends what is new of the given messages; sessions that an ignore glob names stay out."""
        if self.ignored and "session_key" in rows.columns:
            rows = rows.where(~matches_globs(F.col("session_key"), list(self.ignored))).drop("session_key")
        fresh = store.append_messages(self.messages, new_rows(self.messages, rows), order)
        return Memory(self.messages.unionByName(fresh, allowMissingColumns=True), self.settings, self.graph, self.ignored)

    def compact(self) -> Memory:
        return Memory(self.messages, self.settings, compaction.sweep(self.messages, self.settings, self.graph), self.ignored)

    def on_turn_end(self, rows: DataFrame, limit: int | None = None, order: str = "seq") -> Memory:
        """Takes in what is new and compacts the conversations that are under pressure."""
        m = self.ingest(rows, order)
        none = compaction.Dag(*compaction.leaves(m.messages.limit(0), m.settings), m.messages.sparkSession.createDataFrame([], "parent_id string, child_id string"))
        g = compaction.incremental(m.messages, m.settings, m.graph or none, limit or m.settings.effective_max_tokens)
        return Memory(m.messages, m.settings, g, m.ignored)

    def on_turn_start(self, prompt: str | None = None) -> DataFrame:
        return self.context(prompt)

    def on_session_end(self, conversations: DataFrame, ids: list[int]) -> tuple[Memory, DataFrame]:
        """A full sweep; the given conversations are inactive from now on."""
        return self.compact(), store.deactivate(conversations, ids)

    def _graph(self) -> compaction.Dag:
        return self.graph or compaction.sweep(self.messages, self.settings)

    def search(self, query: str, **options) -> DataFrame:
        return recall.grep(self.messages, self._graph().summaries, query, **options)

    def describe(self, summary_id: str) -> DataFrame:
        g = self._graph()
        return dag.describe(g.summaries.where(F.col("summary_id") == summary_id), g.parent_edges, g.leaf_edges)

    def expand(self, summary_id: str, is_sub_agent: bool = False) -> DataFrame:
        g = self._graph()
        return dag.expand(summary_id, g.summaries, g.parent_edges, g.leaf_edges, self.messages, is_sub_agent)

    def context(self, prompt: str | None = None) -> DataFrame:
        chosen = assemble.assemble(self.messages, self._graph(), self.settings, prompt)
        return assemble.rendered(chosen, assemble.spoken(self.messages, self.settings.fresh_tail))

    def stats(self) -> DataFrame:
        return aggregates.by_depth(self._graph().summaries)

    def check(self) -> DataFrame:
        return integrity.checks(self.messages, self._graph())
