"""Filling a budget in order, against the plain fold."""

import random

from pyspark.sql import functions as F

from threadloom.operators import folds


def plain(sizes, budget, used):
    out = []
    for n, t in enumerate(sizes, 1):
        if used + (t or 0) <= budget:
            used += t or 0
            out.append(n)
    return out


def groups(seed):
    rng = random.Random(seed)
    kinds = [[1, 2, 3], [0, None, 5], [100, 50, 7, 3, 1], [1000, 1], [999]]
    return {g: ([rng.choice(kinds[g % 5]) for _ in range(rng.choice([0, 1, 5, 40, 700]))], rng.choice([0.0, 3.5, 120.0, 470.4, 1e9]), rng.choice([0, 0, 3, 200])) for g in range(50)}


def test_equals_the_fold_in_any_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            made = groups(int(batch))
            data = [(g, n, t, b, u, "text") for g, (ts, b, u) in made.items() for n, t in enumerate(ts)]
            random.Random(2).shuffle(data)
            rows = spark.createDataFrame(data, "g long, n long, token_count long, budget double, spent long, content string")
            got = {}
            for r in folds.skip_fill(rows, "g", ["n"], "budget", used="spent").collect():
                got.setdefault(r.g, []).append(r.place)
                assert r.place == r.n + 1 and r.content == "text"
            assert {g: sorted(x) for g, x in got.items()} == {g: x for g, (ts, b, u) in made.items() if (x := plain(ts, b, u))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_large_group_passes_in_batches(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit("one").alias("g"), "id", (F.col("id") % 1000 + 1).alias("token_count"), F.lit(70_000.0).alias("budget"))
    got = sorted(r.place for r in folds.skip_fill(rows, "g", ["id"], "budget").select("place").collect())
    assert got == plain([i % 1000 + 1 for i in range(n)], 70_000.0, 0)
    assert "collect_list" not in folds.skip_fill(rows, "g", ["id"], "budget")._jdf.queryExecution().toString()
    assert folds.skip_fill(rows.limit(0), "g", ["id"], "budget").count() == 0
