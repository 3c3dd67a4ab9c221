"""Statistics of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(messages: DataFrame, *group: str) -> DataFrame:
    zero = F.lit(0).cast("long")
    return messages.groupBy(*group).agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum("token_count"), zero).alias("tokens"), F.coalesce(F.max("seq"), zero).alias("last_seq"))


def by_depth(summaries: DataFrame, *group: str) -> DataFrame:
    return summaries.groupBy(*group, "depth", "kind").agg(F.count(F.lit(1)).alias("summaries"), F.sum("token_count").alias("tokens"))


def compaction_stats(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"), F.count_if(F.col("kind") == "leaf").alias("leaves"), F.count_if(F.col("kind") == "condensed").alias("condensed"), F.count(F.lit(1)).alias("total"))


def accuracy(rows: DataFrame, kind: str, correct: str) -> DataFrame:
    """Overall and task-average (mean of the means by type) accuracy."""
    per = rows.groupBy(kind).agg(F.avg(F.col(correct).cast("double")).alias("a"), F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("long")).alias("c"))
    return per.agg((F.sum("c") / F.sum("n")).alias("overall"), F.avg("a").alias("task_average"))
