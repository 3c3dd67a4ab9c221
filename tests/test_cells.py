"""Vector cells that take appends: exact after each, whatever is split, and once each."""

import math
import random

import pytest

from threadloom.operators import cells

SCHEMA = "vec_id long, embedding array<double>"


def best(data, query, k):
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    return [i for _, i in sorted((-round(cosine(query, v), 12), i) for i, v in data if v and any(v))[:k]]


def found(spark, at, query, k=10, probes=None):
    return [r.vec_id for r in cells.search(spark, at, query, k, "vec_id", probes=probes).collect()]


def test_ten_appends_are_exact(spark, tmp_path):
    rng, at = random.Random(2), f"file://{tmp_path}/x"
    point = lambda middle: [x + rng.gauss(0, 0.3) for x in middle]
    middles = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(11)]
    data = [(i, point(middles[0])) for i in range(100)]
    cells.build(spark.createDataFrame(data, SCHEMA), "vec_id", at, cells=4)
    before = len(cells._centres(spark, at))
    for batch in range(1, 11):  # each batch lies elsewhere than all before
        more = [(1000 * batch + i, point(middles[batch])) for i in range(100)] + [(1000 * batch + 200, None), (1000 * batch + 201, [0.0] * 8), (1000 * batch + 202, [])]
        assert cells.append(spark.createDataFrame(more, SCHEMA), at, batch, most_rows=90)
        assert not cells.append(spark.createDataFrame(more, SCHEMA), at, batch, most_rows=90)
        data += more
        query = middles[rng.randrange(batch + 1)]
        assert found(spark, at, query) == best(data, query, 10)
    centres = cells._centres(spark, at)
    assert sum(c.n for c in centres) == 1100 and len(centres) > before and max(c.n for c in centres) <= 180
    held = cells._stored(spark, at).where(cells.F.col("cell").isin([c.cell for c in centres]))
    assert held.count() == held.select("vec_id").distinct().count() == 1100
    queries = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(3)] + middles[3:6]
    hit = sum(len(set(found(spark, at, q, probes=max(1, len(centres) // 3))) & set(best(data, q, 10))) for q in queries)
    assert hit >= 54  # recall of 0.9 with a third of the cells
    cells.build(spark.createDataFrame(data[:50], SCHEMA), "vec_id", at, cells=4)  # begins anew
    assert found(spark, at, middles[0]) == best(data[:50], middles[0], 10)
    assert cells.append(spark.createDataFrame(data[50:100], SCHEMA), at, 0)
    assert found(spark, at, middles[0]) == best(data[:100], middles[0], 10)


def test_equal_vectors_and_empty_index(spark, tmp_path):
    at = f"file://{tmp_path}/y"
    none = spark.createDataFrame([], SCHEMA)
    cells.build(none, "vec_id", at)
    assert cells.append(none, at, 0) and found(spark, at, [1.0, 0.0]) == []
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(30)], SCHEMA)
    assert cells.append(same, at, 1, cells=2) and not cells.append(same, at, 1)
    assert cells.append(spark.createDataFrame([(i, [2.0, 2.0]) for i in range(30, 60)], SCHEMA), at, 2, most_rows=10)
    assert found(spark, at, [1.0, 1.0], 60) == list(range(60)) and len(cells._centres(spark, at)) <= 2
    assert cells.append(none, at, 3, most_rows=10) and len(found(spark, at, [1.0, 1.0], 100)) == 60


@pytest.mark.parametrize("counts, most, expected", [({0: 10, 1: 35, 2: 21}, 20, {1: 2, 2: 2}), ({0: 10_000}, 10, {0: 16}), ({0: 5}, 5, {})])
def test_parts(counts, most, expected):
    assert cells._parts(counts, most) == expected


def test_parts_leave_room():
    counts = {i: 100 for i in range(cells.MOST_CELLS - 2)}
    assert cells._parts(counts, 40) == {0: 3}
