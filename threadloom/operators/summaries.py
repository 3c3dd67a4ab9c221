"""Summaries written by a model: an iterator over texts in order, with retries, a harder second try and a fallback.

A summariser is any function from a prompt to a text (None or an error: failure). Each task makes its own, with a
breaker of its own: after some failures in a row it isn't asked for a while, and texts are cut instead.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Summariser = Callable[[str], "str | None"]
AIMS = ("Keep decisions, names, numbers and open questions of this excerpt.", "Merge these summaries into one account in order of time.", "Keep lasting facts and turning points only.")
HARDER = "Use as few words as you can, in short points."


@dataclass(frozen=True)
class Effort:
    """How hard to try. ``factor``: a summary is cut at so many times its target."""

    target_tokens: int
    attempts: int = 2
    factor: float = 3.0
    failures: int = 5
    cooldown: float = 30.0


def prompt(text: str, depth: int, previous: str, harder: bool = False) -> str:
    """What a summariser is asked, for a level of the graph."""
    parts = [AIMS[min(depth, 2)], HARDER if harder else "", f"Before: {previous}" if previous else "", text]
    return "\n\n".join(p for p in parts if p)


class Writer:
    """One task's summariser."""

    def __init__(self, ask: Summariser, effort: Effort, clock: Callable[[], float] = time.monotonic):
        from threadloom.operators.expansion import CircuitBreaker

        self.ask, self.effort = ask, effort
        self.breaker = CircuitBreaker(effort.failures, effort.cooldown, clock)

    def _asked(self, text: str) -> str | None:
        for _ in range(self.effort.attempts):
            if not self.breaker.allows(""):
                return None
            try:
                out = self.ask(text)
            except Exception:  # a caller's summariser: its failure is counted, not raised
                out = None
            if out is not None and out.strip():
                self.breaker.succeeded("")
                return out.strip()
            self.breaker.failed("")
        return None

    def write(self, text: str, depth: int, previous: str) -> tuple[str, str]:
        """The summary, and how it came about: first, second, cut (both tries too long) or failed (cut without a summariser)."""
        tokens, target = len(text) // 4, self.effort.target_tokens
        most = int(self.effort.factor * target) * 4
        first = self._asked(prompt(text, depth, previous))
        if first is not None and len(first) // 4 < tokens:
            return first[:most], "first"
        second = None if first is None else self._asked(prompt(text, depth, previous, harder=True))
        if second is not None and len(second) // 4 < tokens:
            return second[:most], "second"
        source = second or text
        cut = source if len(source) <= target * 4 else source[: target * 4] + f" [Truncated from {tokens} tokens]"
        return cut[:most], "failed" if first is None else "cut"


def written(rows: DataFrame, make: Callable[[], Summariser], effort: Effort, depth: int = 0, chained: bool = True, observation: Observation | None = None) -> DataFrame:
    """``rows`` (conversation_id, n, text, prior and others) with ``content`` and ``outcome``.

    Rows of a conversation are written in the order of ``n``. With ``chained`` each sees the summary before it, the
    first its ``prior`` (null: nothing); a conversation is then one task's, row after row, never a group in memory.
    ``observation`` counts outcomes. Null texts count as empty, and an empty text has an empty summary.
    """
    schema = rows.schema
    at = [schema.fieldNames().index(c) for c in ("conversation_id", "text", "prior")]
    rows = (rows.repartition("conversation_id") if chained else rows.repartition("conversation_id", "n")).sortWithinPartitions("conversation_id", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, who, last = Writer(make(), effort), None, None
        for batch in batches:
            content, outcome = [], []
            for conversation, text, prior in zip(*(batch.column(i).to_pylist() for i in at)):
                previous = last if chained and who == (conversation,) else prior
                made, how = writer.write(text, depth, previous or "") if text else ("", "first")
                who, last = (conversation,), made
                content.append(made)
                outcome.append(how)
            columns = [*batch.columns, pa.array(content, pa.string()), pa.array(outcome, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "content", "outcome"])

    from pyspark.sql import types as T

    out = rows.mapInArrow(run, T.StructType([*schema.fields, T.StructField("content", T.StringType()), T.StructField("outcome", T.StringType())]))
    if observation is not None:
        out = out.observe(observation, *[F.count_if(F.col("outcome") == x).alias(x) for x in ("first", "second", "cut", "failed")])
    return out
