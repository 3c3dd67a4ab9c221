"""Sessions whose length grows with the data."""

from __spark_entry__ import queries


def test_bootstrap_reads_sessions_of_any_length(spark, tmp_path):
    rows = [(c, t, "user", "x" * (40 * ((7 * c + t) % 9))) for c in range(130) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    wanted = set()
    for session in range(10):
        used, own = 0, sorted((c * 1000 + t, len(x) // 4) for c, t, _, x in rows if c % 10 == session)
        for i, n in reversed(own):
            if used + n <= 200:
                used += n
                wanted.add((session, i))
    assert {tuple(r) for r in queries()["bootstrap_messages"](spark, str(tmp_path)).collect()} == wanted
