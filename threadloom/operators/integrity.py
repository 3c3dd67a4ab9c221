"""Eight checks of a store, and three of its context items, each a row (name, passed, details), and what to do about failures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.operators import dag
from threadloom.operators.compaction import Dag


def result(name: str, bad: DataFrame) -> DataFrame:
    """Passed if there are no bad rows; details count them."""
    return bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("passed"), F.concat(F.col("n").cast("string"), F.lit(" bad")).alias("details"))


def gaps(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, first, n): runs of numbers between the least and the greatest that are absent, each with its length."""
    after = F.lead(column).over(Window.partitionBy(group).orderBy(column))
    return rows.select(group, (F.col(column) + 1).alias("first"), (after - F.col(column) - 1).alias("n")).where("n > 0")


def duplicates(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(key, other).count().where("count > 1")


def checks(messages: DataFrame, graph: Dag, items: DataFrame | None = None) -> DataFrame:
    s, leaf, parent = graph.summaries, graph.leaf_edges, graph.parent_edges
    ids = s.select("summary_id")
    out = [
        result("sequence_contiguous", gaps(messages, "conversation_id", "seq")),
        result("leaf_sources_exist", leaf.join(messages.select(F.col("id").alias("message_id")), "message_id", "left_anti")),
        result("parents_exist", parent.join(ids.select(F.col("summary_id").alias("parent_id")), "parent_id", "left_anti").unionByName(parent.join(ids.select(F.col("summary_id").alias("child_id")), "child_id", "left_anti"))),
        result("leaves_have_sources", s.where("kind = 'leaf'").join(leaf, "summary_id", "left_anti")),
        result("condensed_have_children", s.where("kind = 'condensed'").join(parent.select(F.col("parent_id").alias("summary_id")), "summary_id", "left_anti")),
        result("no_duplicate_references", duplicates(leaf, "summary_id", "message_id").select(F.lit(1)).unionAll(duplicates(parent, "parent_id", "child_id").select(F.lit(1)))),
        result("one_leaf_per_message", leaf.groupBy("message_id").agg(F.countDistinct("summary_id").alias("n")).where("n > 1")),
        result("tokens_agree", s.where(F.col("token_count") != F.floor(F.length("content") / 4))),
    ]
    if items is not None:
        out.append(result("ordinals_contiguous", gaps(items, "conversation_id", "ordinal")))
        lost = items.where("message_id is not null").join(messages.select(F.col("id").alias("message_id")), "message_id", "left_anti").select(F.lit(1))
        gone = items.where("summary_id is not null").join(ids, "summary_id", "left_anti").select(F.lit(1))
        out.append(result("items_exist", lost.unionAll(gone)))
        both = F.col("message_id").isNotNull() == F.col("summary_id").isNotNull()
        wrong = F.col("item_type") != F.when(F.col("message_id").isNotNull(), "message").otherwise("summary")
        out.append(result("items_are_one_kind", items.where(both | wrong)))
    return reduce(DataFrame.unionByName, out)


REPAIRS = {"sequence_contiguous": "renumber", "leaf_sources_exist": "drop edges", "parents_exist": "drop edges", "leaves_have_sources": "drop leaf", "condensed_have_children": "drop node", "no_duplicate_references": "deduplicate edges", "one_leaf_per_message": "keep the earliest leaf", "tokens_agree": "recount", "ordinals_contiguous": "renumber", "items_exist": "drop items", "items_are_one_kind": "drop items"}


def repair_plan(found: DataFrame) -> DataFrame:
    plan = F.create_map(*[F.lit(x) for kv in REPAIRS.items() for x in kv])
    return found.where("not passed").withColumn("action", plan[F.col("name")])


def orphans(graph: Dag) -> DataFrame:
    """Leaves without a parent, which a context lists by themselves."""
    return dag.roots(graph.summaries.where("kind = 'leaf'"), graph.parent_edges)
