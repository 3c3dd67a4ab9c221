"""The graph of summaries: joins, closure, roots, eligibility, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sources(leaf_edges: DataFrame, messages: DataFrame) -> DataFrame:
    """The messages under each leaf."""
    return leaf_edges.join(messages, leaf_edges.message_id == messages.id).drop("message_id")


def children(parent_edges: DataFrame, summaries: DataFrame) -> DataFrame:
    return parent_edges.join(summaries, parent_edges.child_id == summaries.summary_id).drop("child_id")


def roots(summaries: DataFrame, parent_edges: DataFrame) -> DataFrame:
    """Summaries that are nobody's child."""
    return summaries.join(parent_edges.select(F.col("child_id").alias("summary_id")), "summary_id", "left_anti")


def orphans_at(summaries: DataFrame, parent_edges: DataFrame, depth: int) -> DataFrame:
    return roots(summaries.where(F.col("depth") == depth), parent_edges)


def covering(leaf_edges: DataFrame, summaries: DataFrame) -> DataFrame:
    """One summary for each covered message: the earliest, then the least id."""
    return leaf_edges.join(summaries.select("summary_id", "created_at"), "summary_id").groupBy("message_id").agg(F.min(F.struct("created_at", "summary_id")).summary_id.alias("summary_id"))


def closure(parent_edges: DataFrame, levels: int = 100) -> DataFrame:
    """All (ancestor, descendant, distance) of the graph, by a recursive query."""
    spark = parent_edges.sparkSession
    parent_edges.select("parent_id", "child_id").createOrReplaceTempView("__edges")
    return spark.sql(f"""
        WITH RECURSIVE reach (ancestor, descendant, distance) MAX RECURSION LEVEL {levels} AS (
          SELECT parent_id, child_id, 1 FROM __edges
          UNION ALL
          SELECT r.ancestor, e.child_id, r.distance + 1 FROM reach r JOIN __edges e ON r.descendant = e.parent_id)
        SELECT ancestor, descendant, min(distance) AS distance FROM reach GROUP BY ancestor, descendant""")


def eligible(summaries: DataFrame, parent_edges: DataFrame, depth: int, rule: str = "roots") -> DataFrame:
    """Summaries that may enter a context.

    ``roots``: those without a parent. ``parent_of_included``: from the deepest level (``depth``) down,
    a node is left out only if a node that is itself eligible has it as a child, so that grandchildren come back.
    """
    if rule == "roots":
        return roots(summaries, parent_edges)
    taken = summaries.where(F.col("depth") == depth)
    for level in range(depth - 1, -1, -1):
        under = parent_edges.join(taken.select(F.col("summary_id").alias("parent_id")), "parent_id", "left_semi").select(F.col("child_id").alias("summary_id"))
        taken = taken.unionByName(summaries.where(F.col("depth") == level).join(under, "summary_id", "left_anti"))
    return taken


def describe(summaries: DataFrame, parent_edges: DataFrame, leaf_edges: DataFrame) -> DataFrame:
    """Each summary with its child ids (condensed) and number of source messages (leaf)."""
    kids = parent_edges.groupBy(F.col("parent_id").alias("summary_id")).agg(F.array_sort(F.collect_list("child_id")).alias("child_ids"))
    count = leaf_edges.groupBy("summary_id").agg(F.count(F.lit(1)).alias("n"))
    leaf = F.col("kind") == "leaf"
    return summaries.join(kids, "summary_id", "left").join(count, "summary_id", "left").withColumn("child_ids", F.when(leaf, F.array().cast("array<string>")).otherwise(F.coalesce("child_ids", F.array().cast("array<string>")))).withColumn("source_message_count", F.when(leaf, F.coalesce("n", F.lit(0))).otherwise(0)).drop("n")


def expand(summary_id: str, summaries: DataFrame, parent_edges: DataFrame, leaf_edges: DataFrame, messages: DataFrame, is_sub_agent: bool = False) -> DataFrame:
    """One level down: a leaf's messages or a condensed node's children, as one ordered table."""
    if not is_sub_agent:
        raise PermissionError("expansion is for sub-agents")
    m = sources(leaf_edges.where(F.col("summary_id") == summary_id), messages).select(F.lit("message").alias("type"), F.col("id").cast("string").alias("id"), "content", "token_count", F.col("seq").alias("ord"))
    s = children(parent_edges.where(F.col("parent_id") == summary_id), summaries).select(F.lit("summary").alias("type"), F.col("summary_id").alias("id"), "content", "token_count", F.unix_micros("created_at").alias("ord"))
    return m.unionByName(s).orderBy("type", "ord", "id")
