"""Chunks in blocks against the fold over a whole conversation."""

import random

import numpy as np
import pytest

from threadloom.operators import chunking, folds


def conversations(seed):
    """Many kinds of sizes: small, none, over the limit, several of these in a row."""
    rng = random.Random(seed)
    kinds = [[1, 5, 20], [0], [0, 0, 0, 3], [30, 99, 100], [101, 5], [500, 1, 0], [101, 5000, 70], [100], [10_000, 0, 0, 1]]
    return {c: [rng.choice(rng.choice(kinds) if c % 3 else kinds[c % 9]) for _ in range(rng.choice([0, 1, 2, 7, 60, 150]))] for c in range(60)}


@pytest.mark.parametrize(("min_fanout", "block_chunks"), [(1, 1), (2, 2), (4, 1), (8, 3), (4, 64)])
def test_blocks_equal_the_fold(spark, min_fanout, block_chunks):
    sizes = conversations(min_fanout)
    data = [(c, 1000 * c + i, 3 * i, t) for c, ts in sizes.items() for i, t in enumerate(ts)]
    random.Random(1).shuffle(data)
    rows = spark.createDataFrame(data, "conversation_id long, id long, seq long, token_count long").repartition(5)
    got = {r.id: r.chunk for r in chunking.chunks(rows, 100, min_fanout, block_chunks=block_chunks).collect()}
    expected = {1000 * c + i: k for c, ts in sizes.items() for i, k in enumerate(folds.cut_chunks(ts, 100, min_fanout)) if k >= 0}
    assert got == expected


def test_beginnings():
    t = np.array([40, 40, 40, 300, 10, 300, 300, 5])
    before, pos = np.cumsum(t) - t, np.arange(8) + 5
    following = np.array([*t[1:], np.nan], float)
    assert chunking.beginnings(pos, before, t, following, 100, 4).tolist() == [7, 9, 9, 9, 11, 12, 12, -1]
    assert chunking.beginnings(pos, before, t, following, 100, 1).tolist() == [7, 8, 8, 9, 10, 11, 12, -1]


def test_long_conversations_take_the_blocks(spark):
    rows = spark.range(3000).selectExpr("1L as conversation_id", "id", "id + 1 as seq", "id % 37 as token_count")
    one, many = folds.leaf_sweep(rows, None, 5, 100, 4), folds.leaf_sweep(rows, None, 5, 100, 4, one_task_rows=100)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    assert chunking.chunks(rows.limit(0), 100, 4).count() == 0
