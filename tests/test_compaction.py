"""Compaction by a model and under pressure."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.operators import compaction, summaries

MESSAGE = "id long, conversation_id long, seq long, role string, content string, token_count long"
WIDE = Settings(fresh_tail=2, leaf_chunk_tokens=200, leaf_min_fanout=2, condensed_min_fanout=3, condensed_hard_fanout=2, leaf_target_tokens=10, condensed_target_tokens=10)


def rows(spark, sizes, tokens=100):
    """Conversations of so many messages."""
    data = [(1000 * c + i, c, i, "user", f"note {c} {i} " + "word " * 30, tokens) for c, n in sizes.items() for i in range(1, n + 1)]
    return spark.createDataFrame(data, MESSAGE).withColumn("created_at", F.timestamp_seconds("seq"))


def empty(m):
    return compaction.Dag(*compaction.leaves(m.limit(0), WIDE), compaction.empty_edges(m))


def kinds(g):
    return {(r.conversation_id, r.kind, r.depth): r.n for r in g.summaries.groupBy("conversation_id", "kind", "depth").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_one_step_at_the_soft_threshold_and_all_at_the_hard_one(spark):
    m = rows(spark, {1: 10, 2: 16, 3: 18})
    g = compaction.incremental(m, WIDE, empty(m), 2000)
    assert kinds(g) == {(2, "leaf", 0): 1, (3, "leaf", 0): 8, (3, "condensed", 1): 1}
    again = compaction.incremental(m, WIDE, g, 2000)  # under pressure no more
    assert kinds(again) == kinds(g)
    # the third leaf of a step brings a node, though the threshold hasn't changed
    for n, expected in ((19, {(2, "leaf", 0): 2}), (20, {(2, "leaf", 0): 3, (2, "condensed", 1): 1})):
        m = rows(spark, {2: n})
        g = compaction.incremental(m, WIDE, compaction.Dag(g.summaries.where("conversation_id = 2"), g.leaf_edges, g.parent_edges), 2050)
        assert kinds(g) == expected


def test_until_under_keeps_the_graph_and_stops_by_conversation(spark):
    m = rows(spark, {1: 20, 2: 3, 3: 30})
    given = compaction.sweep(m.where("conversation_id = 1 and seq <= 10"), WIDE)
    history = []
    g = compaction.until_under(m, WIDE, 500, given, history=history)
    before = {r.summary_id for r in given.summaries.collect()}
    assert before <= {r.summary_id for r in g.summaries.collect()} and not g.summaries.where("conversation_id = 2").count()
    assert {(r.conversation_id, r.round) for h in history for r in h.collect()} == {(1, 1), (3, 1)}
    tokens = {r.conversation_id: r.tokens for r in compaction.context_tokens(m, g).collect()}
    assert tokens[1] < 375 and tokens[3] < 375 and tokens[2] == 300
    # what can't get smaller ends after one round, here two messages over the limit
    history = []
    compaction.until_under(rows(spark, {5: 2}), WIDE, 100, history=history)
    assert [(r.before, r.after) for h in history for r in h.collect()] == [(200, 200)]
    assert compaction.until_under(m, WIDE, 0).summaries.count() == 0


def test_no_deeper_than_a_level_that_made_nothing(spark):
    m = rows(spark, {1: 30, 2: 6})
    g = compaction.sweep(m.where("conversation_id = 1 and seq <= 14"), WIDE, hard=True)
    assert kinds(g) == {(1, "leaf", 0): 6, (1, "condensed", 1): 1}
    g = compaction.sweep(m, WIDE, g)
    assert kinds(g)[(1, "condensed", 1)] == 2 and kinds(g)[(2, "leaf", 0)] == 2


def write(texts, ask, **options):
    w = summaries.Writer(ask, summaries.Effort(**({"target_tokens": 5} | options)), clock=lambda: 0.0)
    return [w.write(t, 0, "") for t in texts]


def test_how_a_summary_comes_about():
    long = "abcd" * 50
    assert write([long], lambda p: " short ") == [("short", "first")]
    assert write([long], lambda p: "brief" if summaries.HARDER in p else long) == [("brief", "second")]
    assert write([long], lambda p: long + "x") == [((long + "x")[:20] + " [Truncated from 50 tokens]", "cut")]
    assert write([long, "few"], lambda p: None) == [(long[:20] + " [Truncated from 50 tokens]", "failed"), ("few", "failed")]
    assert write([long], lambda p: "y" * 160, factor=3.0) == [("y" * 60, "first")]
    tries = []

    def shaky(p):
        tries.append(p)
        if len(tries) == 1:
            raise OSError
        return "ok"

    assert write([long], shaky) == [("ok", "first")] and len(tries) == 2
    tries.clear()

    def broken(p):
        tries.append(p)
        raise OSError

    assert [how for _, how in write([long] * 5, broken, failures=3)] == ["failed"] * 5 and len(tries) == 3  # then it isn't asked


def echoes():
    """A maker of summarisers that tell what they see: the message numbers before, and those of the text."""

    def make():
        import re

        def ask(p):
            before = re.search(r"Before: (\S*)", p)
            return (before[1].split(">")[-1] if before else "") + ">" + "+".join(re.findall(r"note \d+ (\d+)", p.split("\n\n")[-1]))

        return ask

    return make


def test_leaves_see_what_came_before(spark):
    m = rows(spark, {1: 10, 2: 6})
    model = compaction.Model(echoes())
    nodes, edges = compaction.leaves(m, WIDE, model=model)
    content = lambda n, c: [r.content for r in n.where(F.col("conversation_id") == c).orderBy("earliest_at").collect()]
    assert content(nodes, 1) == [">1+2", "1+2>3+4", "3+4>5+6", "5+6>7+8"] and content(nodes, 2) == [">1+2", "1+2>3+4"]
    # a later sweep begins with the last two leaves of the graph
    first = compaction.sweep(m.where("seq <= 6"), WIDE, model=model)
    more, _ = compaction.leaves(m, WIDE, first.leaf_edges, model=model, before=first.summaries)
    assert content(more, 1) == ["1+2>5+6", "5+6>7+8"] and content(more, 2) == []
    assert compaction.prior_context(first.summaries).where("conversation_id = 1").first().prior == ">1+2\n\n1+2>3+4"


def test_nodes_see_the_depth_of_their_children(spark):
    m = rows(spark, {1: 10})

    def depths():
        import re

        return lambda p: "|".join(re.findall(r"\[summary depth \d+\]", p)) or "leaf"

    g = compaction.sweep(m, WIDE, model=compaction.Model(depths))
    assert [r.content for r in g.summaries.where("depth = 1").collect()] == ["|".join(["[summary depth 0]"] * 4)] or g.summaries.where("depth = 1").first().content.startswith("[summary depth 0]")
    assert g.summaries.where("kind = 'leaf'").select("content").distinct().first().content == "leaf"


def test_outcomes_are_counted(spark):
    seen = Observation("outcomes")
    data = [(1, n, t, None, "x") for n, t in enumerate(["a" * 100, "", None, "b" * 100])]
    table = spark.createDataFrame(data, "conversation_id long, n int, text string, prior string, other string")
    out = summaries.written(table, lambda: lambda p: "s" if "a" * 100 in p else None, summaries.Effort(5), observation=seen)
    got = {r.n: (r.content, r.outcome) for r in out.collect()}
    assert got[0] == ("s", "first") and got[1] == got[2] == ("", "first") and got[3][1] == "failed"
    assert seen.get == {"first": 3, "second": 0, "cut": 0, "failed": 1}


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables(spark, n):
    m = rows(spark, {1: n}) if n else rows(spark, {1: 1}).limit(0)
    for model in (None, compaction.Model(echoes())):
        assert compaction.sweep(m, WIDE, model=model).summaries.count() == 0
    assert compaction.incremental(m, WIDE, empty(m), 10).summaries.count() == 0
