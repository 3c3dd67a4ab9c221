"""Context assembly under a token budget."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.functions.text import words
from threadloom.operators import dag, folds
from threadloom.operators.compaction import Dag

K1, B = 1.2, 0.75


def effective_limit(most: Column, cap: Column) -> Column:
    """The tokens that a context may have: the model's, or a lower hard cap where there is one (null: none)."""
    return F.least(most, F.coalesce(cap, most))


def prompt_terms(prompt: str) -> list[str]:
    return [t for t in (re.sub(r"\W", "", w.lower()) for w in prompt.split()) if t]


def bm25_lite(summaries: DataFrame, group: str, prompt: str) -> DataFrame:
    """``summaries`` with a score without document frequencies; a term that the prompt repeats counts as often."""
    from pyspark.sql.window import Window

    rows = summaries.withColumn("__w", words(F.lower("content")))
    mean = F.avg(F.size("__w")).over(Window.partitionBy(group))
    score = F.lit(0.0)
    for q in prompt_terms(prompt):
        f = F.size(F.filter("__w", _is(q)))
        score = score + F.when(f > 0, f * (K1 + 1) / (f + K1 * (1 - B + B * F.size("__w") / mean))).otherwise(0.0)
    return rows.withColumn("score", score).drop("__w")


def _is(q: str):
    return lambda x: x == F.lit(q)


def protected(messages: DataFrame, tail: DataFrame) -> DataFrame:
    """Tool results before the tail whose calls are in the tail, without a result there."""
    key = ["conversation_id", "tool_call_id"]
    calls = tail.where((F.col("role") == "assistant") & F.col("tool_call_id").isNotNull()).select(*key)
    have = tail.where("role = 'tool'").select(*key)
    wanted = calls.join(have, key, "left_anti").distinct()
    return messages.where("role = 'tool'").join(tail.select("id"), "id", "left_anti").join(wanted, key, "left_semi")


def assemble(messages: DataFrame, graph: Dag, settings: Settings, prompt: str | None = None, rule: str = "roots", depth: int = 1) -> DataFrame:
    """The summaries that enter each conversation's context, with their ``place``.

    Budget: what the tail and protected results leave of the maximum, times the ratio. Order: by the prompt's
    score if there is one, then depth descending and time. A summary that doesn't fit is skipped.
    """
    tail = folds.tail(messages, settings.fresh_tail)
    used = tail.groupBy("conversation_id").agg(F.sum("token_count").alias("used"))
    if "tool_call_id" in messages.columns:
        more = protected(messages, tail).groupBy("conversation_id").agg(F.sum("token_count").alias("p"))
        used = used.join(more, "conversation_id", "left").select("conversation_id", (F.col("used") + F.coalesce("p", F.lit(0))).alias("used"))
    budget = used.select("conversation_id", ((F.lit(settings.effective_max_tokens) - F.col("used")) * settings.summary_ratio).alias("budget")).where("budget > 0")
    rows = dag.eligible(graph.summaries, graph.parent_edges, depth, rule).join(budget, "conversation_id")
    order = [F.desc("depth"), "earliest_at", "created_at", "summary_id"]
    if prompt and prompt_terms(prompt):
        rows = bm25_lite(rows, "conversation_id", prompt)
        order = [F.desc(F.round("score", 9)), *order]
    return folds.skip_fill(rows, "conversation_id", order, "budget")


def cross_session(hits: DataFrame, summaries: DataFrame, min_score: float, budget: int) -> DataFrame:
    """Of the top hits (id, score), those above the threshold that exist and fit the budget, best first."""
    rows = hits.where(F.col("score") >= min_score).join(summaries, hits.id == summaries.summary_id)
    rows = rows.withColumn("__all", F.lit(0)).withColumn("budget", F.lit(float(budget)))
    return folds.skip_fill(rows, "__all", [F.desc("score"), "summary_id"], "budget").drop("__all")


def bootstrap(summaries: DataFrame, messages: DataFrame, budget: int = 6000) -> tuple[DataFrame, DataFrame]:
    """What a new session takes over from its parents: summaries first, then messages from the latest back."""
    s = summaries.withColumn("budget", F.lit(float(budget)))
    taken = folds.skip_fill(s, "conversation_id", [F.desc("depth"), F.desc("created_at"), "summary_id"], "budget")
    spent = taken.groupBy("conversation_id").agg(F.sum("token_count").alias("spent"))
    m = messages.join(spent, "conversation_id", "left").withColumn("spent", F.coalesce("spent", F.lit(0))).withColumn("budget", F.lit(float(budget)))
    return taken, folds.skip_fill(m, "conversation_id", [F.desc("seq")], "budget", used="spent")


def spoken(messages: DataFrame, tail_size: int) -> DataFrame:
    """What a context shows word for word: the tail, and results before it whose calls are in it, each right after its call.

    A call without a result has a stand-in, and results without a call are left out (see ``folds.repair_transcript``).
    """
    tail = folds.tail(messages, tail_size)
    if not {"tool_call_id", "tool_name"} <= set(messages.columns):
        return tail
    return folds.repair_transcript(tail.unionByName(protected(messages, tail)))


def rendered(summaries: DataFrame, messages: DataFrame) -> DataFrame:
    """(conversation_id, context): summaries in their places, then messages (by ``place``, or without one by ``seq``), one block each."""
    s = summaries.select("conversation_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("at"), F.format_string("[summary depth %d]\n%s", F.col("depth"), F.col("content")).alias("block"))
    at = F.struct(F.col("seq").alias("at"), F.lit(0).alias("sub")) if "place" not in messages.columns else F.struct(F.col("place.at").alias("at"), F.col("place.sub").alias("sub"))
    s = s.withColumn("at", F.struct("at", F.lit(0).alias("sub")))
    m = messages.select("conversation_id", F.lit(1).alias("part"), at.alias("at"), F.format_string("[%s]\n%s", "role", "content").alias("block"))
    return s.unionByName(m).groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "at", "block"))), lambda x: x.block), "\n\n").alias("context"))


def compaction_note(max_depth: Column, condensed: Column) -> Column:
    return F.when((max_depth >= 2) | (condensed >= 2), F.lit("Older parts of this conversation are summaries; expand them for the original words."))
