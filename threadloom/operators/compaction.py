"""Compaction: leaves from chunks of messages, condensed nodes from leaves, urgency."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.config import Settings
from threadloom.functions.text import annotate_media, derived_id, truncated
from threadloom.operators import dag, folds, store, summaries
from threadloom.sources.scratch import saved


@dataclass
class Dag:
    summaries: DataFrame
    leaf_edges: DataFrame
    parent_edges: DataFrame


def message_line(limit_tokens: int) -> Column:
    text = annotate_media(F.col("content"))
    cap = limit_tokens * 4
    text = F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit("\n[cut, "), F.col("token_count").cast("string"), F.lit(" tokens]"))).otherwise(text)
    return F.concat(F.lit("["), F.col("role"), F.lit("] "), text)


def summarise(text: Column, source_tokens: Column, target_tokens: int, candidate: Column | None = None) -> Column:
    """A summary that is shorter than its source: the candidate if it is, else the source cut to the target.

    ``candidate`` comes from any summariser (null for failure). Without one, cutting is the deterministic stand-in.
    """
    cut = F.when(F.length(text) <= target_tokens * 4, text).otherwise(F.substring(text, 1, target_tokens * 4))
    if candidate is None:
        return cut
    good = candidate.isNotNull() & (F.floor(F.length(candidate) / 4) < source_tokens)
    return F.when(good, candidate).otherwise(truncated(cut, target_tokens * 4))


@dataclass(frozen=True)
class Model:
    """A summariser for graphs: ``make`` gives each task its own (see ``operators.summaries``)."""

    make: Callable[[], summaries.Summariser]
    attempts: int = 2
    factor: float = 3.0
    failures: int = 5
    cooldown: float = 30.0

    def effort(self, target_tokens: int) -> summaries.Effort:
        return summaries.Effort(target_tokens, self.attempts, self.factor, self.failures, self.cooldown)


def leaves(messages: DataFrame, settings: Settings, compacted: DataFrame | None = None, first_only: bool = False, model: Model | None = None, before: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """New leaves and their edges from a full sweep of all conversations, or with ``first_only`` of one chunk each.

    With a ``model``, each leaf is written with the one before it in view, the first with what ``before`` (graph
    nodes) ends in. Without one, texts are cut.
    """
    chunks = folds.leaf_sweep(messages, compacted, settings.fresh_tail, settings.leaf_chunk_tokens, settings.leaf_min_fanout)
    if first_only:
        chunks = chunks.where("chunk = 0")
    rows = chunks.select("id", "chunk").join(messages, "id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", message_line(settings.leaf_chunk_tokens).alias("line")))), lambda x: x.line), "\n")
    g = rows.groupBy("conversation_id", "chunk").agg(lines.alias("text"), F.sum("token_count").alias("source_token_count"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("created_at", "seq").alias("earliest_at"), F.max_by("created_at", "seq").alias("latest_at"))
    if model is None:
        content = summarise(F.col("text"), F.col("source_token_count"), settings.leaf_target_tokens)
    else:
        g = g.withColumnRenamed("chunk", "n")
        g = g.withColumn("prior", F.lit(None).cast("string")) if before is None else g.join(prior_context(before), "conversation_id", "left")
        g, content = summaries.written(g, model.make, model.effort(settings.leaf_target_tokens)).withColumnRenamed("n", "chunk"), F.col("content")
    sid = derived_id("sum_", 12, F.col("conversation_id"), F.col("first_seq"), F.col("last_seq"))
    nodes = g.select(sid.alias("summary_id"), "conversation_id", F.lit("leaf").alias("kind"), F.lit(0).alias("depth"), content.alias("content"), F.floor(F.length(content) / 4).alias("token_count"), "source_token_count", "earliest_at", "latest_at", F.col("latest_at").alias("created_at"))
    made = g.select("conversation_id", "chunk", sid.alias("summary_id"))
    return nodes, chunks.join(made, ["conversation_id", "chunk"]).select("summary_id", F.col("id").alias("message_id"))


def condense(nodes: DataFrame, parent_edges: DataFrame, depth: int, fanout: int, target_tokens: int, candidate: Callable[[Column], Column] | None = None, model: Model | None = None) -> tuple[DataFrame, DataFrame]:
    """One parent for all orphans of a depth in each conversation that has at least ``fanout`` of them.

    ``candidate`` is a summariser of the children's joined contents (null for failure) as a column; a ``model``
    sees each child under a line that tells its depth.
    """
    orphans = dag.orphans_at(nodes, parent_edges, depth)
    if model is None:
        content = lambda text, n: summarise(text, n, target_tokens, candidate and candidate(text))
        made = store.create_condensed(orphans, "conversation_id", content=content).where(F.size("child_ids") >= fanout)
    else:
        shown = orphans.withColumn("content", F.format_string("[summary depth %d]\n%s", F.col("depth"), F.col("content")))
        made = store.create_condensed(shown, "conversation_id", content=lambda text, n: text).where(F.size("child_ids") >= fanout)
        made = made.withColumnRenamed("content", "text").withColumns({"n": F.lit(0), "prior": F.lit(None).cast("string")})
        names = [*nodes.columns, "child_ids"]
        made = summaries.written(made, model.make, model.effort(target_tokens), depth + 1, chained=False)
        made = made.withColumn("token_count", F.floor(F.length("content") / 4)).select(*names)
    return made.drop("child_ids"), made.select(F.col("summary_id").alias("parent_id"), F.explode("child_ids").alias("child_id"))


def escalated(text: Column, first: Column | None, second: Column | None, target_tokens: int, factor: float = 3.0) -> Column:
    """A summary of bounded length from a summariser's first and harder second try (null for failure).

    The first that is shorter than the text counts; else the second try, or the text, is cut to the target, with
    a note. All are cut at ``factor`` times the target.
    """
    tokens = lambda c: F.floor(F.length(c) / 4)
    first, second = (F.lit(None).cast("string") if c is None else c for c in (first, second))
    again = F.when(first.isNotNull(), second)  # a summariser that failed isn't asked again
    source = F.coalesce(again, text)
    note = F.concat(F.lit(" [Truncated from "), tokens(text).cast("string"), F.lit(" tokens]"))
    best = F.when(tokens(first) < tokens(text), first).when(tokens(again) < tokens(text), again).otherwise(F.concat(F.substring(source, 1, target_tokens * 4), note))
    return F.substring(best, 1, int(factor * target_tokens) * 4)


def sweep(messages: DataFrame, settings: Settings, graph: Dag | None = None, levels: int = 10, candidate: Callable[[Column], Column] | None = None, keep: Callable[[DataFrame, str], DataFrame] = saved, hard: bool = False, model: Model | None = None) -> Dag:
    """Leaves to exhaustion, then condensed nodes level by level until none comes, for all conversations at once.

    With ``graph``, only messages that no leaf has are compacted, and new nodes join its orphans, so that the
    graph grows deeper from sweep to sweep. A conversation in which a level makes no node goes no deeper. ``hard``
    lowers the fan-out of condensed nodes. ``keep`` writes what each level made, as the next ones read it several times.
    """
    nodes, edges = leaves(messages, settings, graph and graph.leaf_edges, model=model, before=graph and graph.summaries)
    nodes = keep(nodes, "leaves")
    edges = keep(edges, "leaf-edges")
    parents = empty_edges(messages)
    if graph is not None:
        nodes, edges, parents = graph.summaries.unionByName(nodes), graph.leaf_edges.unionByName(edges), graph.parent_edges
    fanout = min(settings.condensed_min_fanout, settings.condensed_hard_fanout) if hard else settings.condensed_min_fanout
    going = None
    for depth in range(levels):
        here = nodes if going is None else nodes.join(going, "conversation_id", "left_semi")
        made, links = condense(here, parents, depth, fanout, settings.condensed_target_tokens, candidate, model)
        made = keep(made, f"depth-{depth + 1}")
        if made.isEmpty():
            break
        nodes, parents = nodes.unionByName(made), parents.unionByName(keep(links, f"links-{depth + 1}"))
        going = made.select("conversation_id")
    return Dag(nodes, edges, parents)


def empty_edges(of: DataFrame) -> DataFrame:
    return of.sparkSession.createDataFrame([], "parent_id string, child_id string")


def incremental(messages: DataFrame, settings: Settings, graph: Dag, limit: int, keep: Callable[[DataFrame, str], DataFrame] = saved, model: Model | None = None) -> Dag:
    """One cycle for the conversations under pressure; without pressure a conversation's graph stays as it is.

    At the soft threshold (ASYNC) a conversation gets one leaf, of its oldest chunk, and one node over its leaves
    without a parent, if there are enough. At the hard one (BLOCKING) it is compacted until it is under.
    """
    state = urgency(F.col("tokens"), limit, settings.soft_ratio, settings.hard_ratio)
    tight = keep(context_tokens(messages, graph).select("conversation_id", state.alias("urgency")).where("urgency <> 'NONE'"), "pressure")
    soon = tight.where("urgency = 'ASYNC'").select("conversation_id")
    after = graph
    if not soon.isEmpty():
        own = graph.summaries.join(soon, "conversation_id", "left_semi")
        nodes, edges = leaves(messages.join(soon, "conversation_id", "left_semi"), settings, graph.leaf_edges, True, model, own)
        nodes, edges = keep(nodes, "leaf"), keep(edges, "leaf-edges")
        made, links = condense(own.unionByName(nodes), graph.parent_edges, 0, settings.condensed_min_fanout, settings.condensed_target_tokens, model=model)
        made, links = keep(made, "node"), keep(links, "links")
        after = Dag(graph.summaries.unionByName(nodes).unionByName(made), graph.leaf_edges.unionByName(edges), graph.parent_edges.unionByName(links))
    now = tight.where("urgency = 'BLOCKING'").select("conversation_id")
    if now.isEmpty():
        return after
    return until_under(messages.join(now, "conversation_id", "left_semi"), settings, limit, after, keep=keep, model=model)


def context_tokens(messages: DataFrame, graph: Dag) -> DataFrame:
    """(conversation_id, tokens): messages that no leaf holds, and the summaries at the roots."""
    m = messages.groupBy("conversation_id").agg(F.sum("token_count").alias("m"))
    leaf = graph.summaries.where("kind = 'leaf'").groupBy("conversation_id").agg(F.sum("source_token_count").alias("l"))
    top = dag.roots(graph.summaries, graph.parent_edges).groupBy("conversation_id").agg(F.sum("token_count").alias("r"))
    rows = m.join(leaf, "conversation_id", "left").join(top, "conversation_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select("conversation_id", (F.greatest(zero, F.col("m") - F.coalesce("l", zero)) + F.coalesce("r", zero)).alias("tokens"))


def urgency(tokens: Column, limit: int, soft: float, hard: float) -> Column:
    if limit <= 0:
        return F.lit("NONE")
    ratio = tokens / F.lit(float(limit))
    return F.when(ratio >= hard, "BLOCKING").when(ratio >= soft, "ASYNC").otherwise("NONE")


def until_under(messages: DataFrame, settings: Settings, limit: int, graph: Dag | None = None, rounds: int = 10, keep: Callable[[DataFrame, str], DataFrame] = saved, model: Model | None = None, history: list[DataFrame] | None = None) -> Dag:
    """Hard sweeps over the conversations of ``messages`` that are at the soft threshold or above, round by round.

    Each conversation stops by itself: under the threshold, or when a round hasn't made it smaller. What the graph
    has stays; nodes are added. ``history`` receives (conversation_id, round, before, after) of each round.
    """
    graph = graph or Dag(*leaves(messages.limit(0), settings), empty_edges(messages))
    least = settings.soft_ratio * limit

    def tokens(of: DataFrame, name: str) -> DataFrame:
        return context_tokens(messages.join(of, "conversation_id", "left_semi"), graph).withColumnRenamed("tokens", name)

    sizes = keep(tokens(messages.select("conversation_id").distinct(), "before").where(F.lit(limit > 0) & (F.col("before") >= least)), "open")
    for n in range(rounds):
        if sizes.isEmpty():
            break
        open_ = sizes.select("conversation_id")
        own = Dag(graph.summaries.join(open_, "conversation_id", "left_semi"), graph.leaf_edges, graph.parent_edges)
        rest = graph.summaries.join(open_, "conversation_id", "left_anti")
        made = sweep(messages.join(open_, "conversation_id", "left_semi"), settings, own, keep=keep, hard=True, model=model)
        graph = Dag(rest.unionByName(made.summaries), made.leaf_edges, made.parent_edges)
        change = keep(sizes.join(tokens(open_, "after"), "conversation_id"), f"round-{n + 1}")
        if history is not None:
            history.append(change.withColumn("round", F.lit(n + 1)))
        sizes = change.where((F.col("after") < F.col("before")) & (F.col("after") >= least)).select("conversation_id", F.col("after").alias("before"))
    return graph


def prior_context(nodes: DataFrame) -> DataFrame:
    """(conversation_id, prior): the contents of the last two leaves of each conversation, in order."""
    n = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("created_at"), F.desc("summary_id")))
    two = nodes.where("kind = 'leaf'").withColumn("n", n).where("n <= 2")
    return two.groupBy("conversation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "content"))), lambda x: x.content), "\n\n").alias("prior"))
