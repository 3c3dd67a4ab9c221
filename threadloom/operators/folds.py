"""Folds over ordered rows of a conversation, which windows can't express.

Each runs once per conversation over narrow rows (ids, tokens, flags; texts stay out) in Arrow groups.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def tail(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages of each conversation."""
    return messages.withColumn("__r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")))).where(F.col("__r") <= n).drop("__r")


def before_tail(messages: DataFrame, n: int) -> DataFrame:
    return messages.withColumn("__r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")))).where(F.col("__r") > n).drop("__r")


def cut_chunks(tokens: Iterable[int], limit: int, min_fanout: int) -> list[int]:
    """A chunk number for each row, -1 for rows that no chunk takes.

    A chunk ends before the row that would pass the limit; if that row is over the limit by itself and
    the chunk has fewer than ``min_fanout`` rows, the row joins it. Rows at the end that neither reach
    the limit nor ``min_fanout`` stay free.
    """
    out: list[int] = []
    chunk = total = size = 0
    oversized = False
    for t in tokens:
        if size and total + t > limit:
            absorb = t > limit and size < min_fanout
            if absorb:
                out.append(chunk)
            chunk, total, size, oversized = chunk + 1, 0, 0, False
            if absorb:
                continue
        out.append(chunk)
        total, size, oversized = total + t, size + 1, oversized or t > limit
    if size and not oversized and size < min_fanout:
        out[-size:] = [-1] * size
    return out


#: Conversations of more rows than this are cut into chunks by many tasks (see ``operators.chunking``).
ONE_TASK_ROWS = 2_000_000


def leaf_sweep(messages: DataFrame, compacted: DataFrame | None, keep_tail: int, limit: int, min_fanout: int, one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """(conversation_id, id, seq, chunk): all chunks that repeated selection yields, for all conversations at once.

    A conversation of up to ``one_task_rows`` rows is folded by one task, longer ones in blocks, with the same result.
    """
    rows = before_tail(messages.select("conversation_id", "id", "seq", "token_count"), keep_tail)
    if compacted is not None:
        rows = rows.join(compacted.select(F.col("message_id").alias("id")), "id", "left_anti")

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("seq", "ascending"), ("id", "ascending")])
        chunk = cut_chunks(table.column("token_count").fill_null(0).to_pylist(), limit, min_fanout)
        return table.select(["conversation_id", "id", "seq"]).append_column("chunk", pa.array(chunk, pa.int64()))

    folded = lambda part: part.groupBy("conversation_id").applyInArrow(fold, "conversation_id long, id long, seq long, chunk long").where("chunk >= 0")
    long_ = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > one_task_rows).select("conversation_id")
    if long_.isEmpty():
        return folded(rows)
    from threadloom.operators.chunking import chunks

    return folded(rows.join(long_, "conversation_id", "left_anti")).unionByName(chunks(rows.join(long_, "conversation_id", "left_semi"), limit, min_fanout))


def fitting(t: np.ndarray, used: float, budget: float) -> tuple[np.ndarray, float]:
    """Which of some sizes, in order, still fit a budget of which ``used`` is spent, and what is spent then.

    Takes the longest beginning that fits, leaves out the next, and goes on with those that still can fit: what is
    left only shrinks.
    """
    taken, open_ = [], np.flatnonzero(used + t <= budget)
    while len(open_):
        spent = used + np.cumsum(t[open_])
        k = int(np.searchsorted(spent, budget, "right"))
        taken.append(open_[:k])
        used = float(spent[k - 1]) if k else used
        rest = open_[k + 1 :]
        open_ = rest[used + t[rest] <= budget]
    return (np.concatenate(taken) if taken else np.zeros(0, np.int64)), used


def skip_fill(rows: DataFrame, group: str, order: list, budget: str, used: str | None = None) -> DataFrame:
    """Rows in order that fit what is left of the budget, with their ``place``; one that doesn't fit is skipped, and later ones may fit.

    A group's rows (its number and size, no texts) pass through one task batch by batch, and never lie in memory
    together; those over the budget by themselves stay out of it. Null sizes count as 0.
    """
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    start = F.lit(0.0) if used is None else F.col(used).cast("double")
    sizes = ranked.select(group, "__n", F.greatest(F.lit(0.0), F.coalesce(F.col("token_count").cast("double"), F.lit(0.0))).alias("t"), F.col(budget).cast("double").alias("b"), start.alias("u"))

    def fill(batches):
        who, spent = None, 0.0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            t, b, u = (batch.column(i).to_numpy() for i in (2, 3, 4))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            kept = []
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if who != (keys[i],):
                        who, spent = (keys[i],), float(u[i])
                    at, spent = fitting(t[i:j], spent, float(b[i]))
                    kept.append(at + i)
            yield batch.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64))).select([group, "__n"])

    able = sizes.where(F.col("u") + F.col("t") <= F.col("b")).repartition(group).sortWithinPartitions(group, "__n")
    kept = able.mapInArrow(fill, T.StructType([sizes.schema[group], sizes.schema["__n"]]))
    return ranked.join(kept, [group, "__n"]).withColumnRenamed("__n", "place")


def overlap(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """(conversation_id, drop): the longest prefix of the incoming rows that is a suffix of the stored ones."""
    pair = F.struct("seq", F.struct("role", "content").alias("x"))
    lists = lambda df, name: df.groupBy("conversation_id").agg(F.transform(F.array_sort(F.collect_list(pair)), lambda p: p.x).alias(name))
    counts = incoming.groupBy("conversation_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    recent = stored.join(counts, "conversation_id").withColumn("__r", F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("seq")))).where("__r <= n")
    both = lists(incoming, "new").join(lists(recent, "old"), "conversation_id", "left")
    fits = F.filter(F.sequence(F.lit(0), F.least(F.size("new"), F.coalesce(F.size("old"), F.lit(0)))), lambda k: (k == 0) | (F.slice("old", F.size("old") - k + 1, k) == F.slice("new", F.lit(1), k)))
    return both.select("conversation_id", F.coalesce(F.array_max(F.when(F.col("old").isNull(), F.array(F.lit(0))).otherwise(fits)), F.lit(0)).alias("drop"))


HEARTBEAT_MARK, HEARTBEAT_OK = "heartbeat.md", "heartbeat_ok"


def heartbeats(messages: DataFrame) -> DataFrame:
    """(conversation_id, id, cycle) of complete heartbeat cycles: a marked user row, tool rows, the assistant's ok."""
    tool = F.col("role").isin("tool", "tool_call", "tool_result") | F.col("tool_call_id").isNotNull()
    kind = (
        F.when((F.col("role") == "assistant") & (F.lower(F.trim("content")) == HEARTBEAT_OK), "ok")
        .when((F.col("role") == "user") & F.contains("content", F.lit(HEARTBEAT_MARK)), "mark")
        .when(tool, "tool").otherwise("other")
    )
    # a cycle is a run: everything since the last row that isn't a tool row, closed by an ok
    w = Window.partitionBy("conversation_id").orderBy("seq")
    rows = messages.select("conversation_id", "id", "seq", kind.alias("kind"))
    rows = rows.withColumn("run", F.sum(F.when(F.col("kind").isin("mark", "other"), 1).otherwise(0)).over(w))
    opened = Window.partitionBy("conversation_id", "run").orderBy("seq")
    rows = rows.withColumn("head", F.first("kind").over(opened)).withColumn("end", F.min(F.when(F.col("kind") == "ok", F.col("seq"))).over(Window.partitionBy("conversation_id", "run")))
    return rows.where((F.col("head") == "mark") & (F.col("seq") <= F.col("end"))).select("conversation_id", "id", F.col("run").alias("cycle"))


MISSING_RESULT = "[no result was recorded]"


def repair_transcript(messages: DataFrame) -> DataFrame:
    """Each call followed by its first result (or a stand-in), duplicate and orphan results gone.

    Calls with a tool name but no id get one. Tool rows without an id stay where they are. The new order is ``place``.
    """
    call_id = F.when((F.col("role") == "assistant") & F.col("tool_name").isNotNull() & F.col("tool_call_id").isNull(), F.format_string("toolu_%d_%d", "id", "seq")).otherwise(F.col("tool_call_id"))
    m = messages.withColumn("tool_call_id", call_id)
    is_result = (F.col("role") == "tool") & F.col("tool_call_id").isNotNull()
    key = ["conversation_id", "tool_call_id"]
    # of calls with one id the first has the result
    calls = m.where((F.col("role") == "assistant") & F.col("tool_call_id").isNotNull()).groupBy(*key).agg(F.min("seq").alias("call_seq"), F.min_by("tool_name", "seq").alias("call_name"), F.min_by("created_at", "seq").alias("call_at"))
    first = Window.partitionBy(*key).orderBy("seq")
    results = m.where(is_result).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    moved = results.join(calls.select(*key, "call_seq"), key).withColumn("place", F.struct(F.col("call_seq").alias("at"), F.lit(1).alias("sub")))
    absent = calls.join(results.select(*key), key, "left_anti")
    blanks = absent.select(F.lit(-1).cast("long").alias("id"), "conversation_id", F.lit(-1).cast("long").alias("seq"), F.lit("tool").alias("role"), F.lit(MISSING_RESULT).alias("content"), F.lit(0).cast("long").alias("token_count"), "tool_call_id", F.col("call_name").alias("tool_name"), F.col("call_at").alias("created_at"), F.struct(F.col("call_seq").alias("at"), F.lit(1).alias("sub")).alias("place"))
    rest = m.where(~is_result | is_result.isNull()).withColumn("place", F.struct(F.col("seq").alias("at"), F.lit(0).alias("sub")))
    return rest.unionByName(moved.drop("call_seq")).unionByName(blanks)
