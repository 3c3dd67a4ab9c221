"""Compaction of a stream, cut into batches in several ways."""

import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.config import Settings
from threadloom.operators import compaction
from threadloom.streaming import pressure
from threadloom.streaming.ingest import run_available, upsert_batches

MESSAGE = "id long, conversation_id long, seq long, role string, content string, token_count long"
S = Settings(fresh_tail=2, leaf_chunk_tokens=60, leaf_min_fanout=2, condensed_min_fanout=3, condensed_hard_fanout=2, leaf_target_tokens=20, condensed_target_tokens=20)


@pytest.fixture
def stateful(spark):
    before = {k: spark.conf.get(k, None) for k in pressure.STATE_CONF}
    for k, v in pressure.STATE_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def table(spark, data):
    return spark.createDataFrame(data, MESSAGE).withColumn("created_at", F.timestamp_seconds("seq"))


def conversations(seed):
    rng = random.Random(seed)
    sizes = {c: rng.randint(1, 60) for c in range(1, 8)}
    return [(1000 * c + i, c, i, rng.choice(["user", "assistant"]), None if rng.random() < 0.1 else "w" * rng.randint(0, 300), rng.choice([1, 10, 20, 50, 90])) for c, n in sizes.items() for i in range(1, n + 1)]


def stream(spark, tmp_path, data, cuts, name, **options):
    """Messages in batches: up to these shares of each conversation."""
    schema, out = None, tmp_path / f"{name}-out"
    last = {c: max(x[2] for x in data if x[1] == c) for c in {x[1] for x in data}}
    for low, high in zip([0.0, *cuts], [*cuts, 1.0]):
        part = table(spark, [x for x in data if low * last[x[1]] < x[2] <= high * last[x[1]]])
        schema = part.schema
        part.repartition(2).write.mode("append").parquet(str(tmp_path / name))
        nodes = pressure.compacted(spark.readStream.schema(schema).parquet(str(tmp_path / name)), S, 300, **options)
        run_available(nodes, upsert_batches(str(out)), str(tmp_path / f"{name}-ck"))
    return spark.read.option("basePath", str(out)).schema(pressure.NODES).parquet(str(out))


def plain(data):
    out = []
    for c in sorted({x[1] for x in data}):
        context = pressure.Context(c, S, 300)
        for x in sorted((x for x in data if x[1] == c), key=lambda x: x[2]):
            context.add(pressure.Message(x[0], x[2], x[5], x[2], f"[{x[3]}] {x[4] or ''}"))
        out += context.made
    return sorted((x[:7] + (x[10],) for x in out), key=str)


def test_nodes_do_not_depend_on_batches(stateful, tmp_path):
    data = conversations(1)
    expected = plain(data)
    assert {(x[2], x[3]) for x in expected} >= {("leaf", 0), ("condensed", 1), ("condensed", 2)}
    for name, cuts in (("one", []), ("three", [0.3, 0.7]), ("five", [0.05, 0.1, 0.5, 0.9])):
        got = stream(stateful, tmp_path, data, cuts, name)
        assert sorted(((*r[:7], r[10]) for r in map(tuple, got.collect())), key=str) == expected, name
    leaf_edges, parent_edges = pressure.edges(got)
    assert leaf_edges.count() == leaf_edges.select("message_id").distinct().count() and parent_edges.count() == parent_edges.select("child_id").distinct().count()


def test_steps_equal_those_of_the_batch_operators(stateful):
    """Where a message brings pressure, one cycle over tables makes the nodes that the state makes."""
    data = [(i, 1, i, "user", "w" * (7 * i % 90), 30) for i in range(1, 12)]
    context, graph, cycles = pressure.Context(1, S, 300), None, 0
    for n, x in enumerate(data, 1):
        before = len(context.made)
        context.add(pressure.Message(x[0], x[2], x[5], x[2], f"[{x[3]}] {x[4]}"))
        if len(context.made) > before and cycles < 2:
            m, cycles = table(stateful, data[:n]), cycles + 1
            graph = graph or compaction.Dag(*compaction.leaves(m.limit(0), S), compaction.empty_edges(m))
            graph = compaction.incremental(m, S, graph, 300)
            assert {(r.summary_id, r.depth, r.content) for r in graph.summaries.collect()} == {(y[1], y[3], y[4]) for y in context.made}
    assert cycles == 2


def test_idle_conversations_are_closed(stateful, tmp_path):
    data = [(i, 1, i, "user", "w" * 40, 10) for i in range(1, 11)]
    rows = table(stateful, data)
    rows.write.parquet(str(tmp_path / "in"))
    nodes = pressure.compacted(stateful.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), S, 300, idle_ms=500)
    running = nodes.writeStream.foreachBatch(upsert_batches(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="200 milliseconds").start()
    found, end = [], time.time() + 60
    try:
        while not found and time.time() < end:
            time.sleep(1)
            if running.exception():
                raise running.exception()
            if list((tmp_path / "out").glob("*/*.parquet")):
                found = stateful.read.schema(pressure.NODES).parquet(str(tmp_path / "out")).collect()
    finally:
        running.stop()
    # no pressure, but nobody speaks any more: all but the tail is summed up
    assert {(r.kind, r.depth) for r in found} == {("leaf", 0), ("condensed", 1)}
    assert sorted(int(i) for r in found if r.kind == "leaf" for i in r.sources) == list(range(1, 9))
