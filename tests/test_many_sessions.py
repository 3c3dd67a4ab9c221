"""Sessions whose number grows with the data."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def test_bootstrap_serves_every_session(spark, tmp_path):
    text = lambda c, t: [None, "", "y" * 900][(c + t) % 3] if c % 11 == 0 else "x" * (40 * ((7 * c + t) % 9))
    counts = {}
    for n in (135, 270):
        rows, sf = [(c, t, "user", text(c, t)) for c in range(n) for t in range(4)], tmp_path / str(n)
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(sf / "conversations.parquet"))
        wanted = []
        for session in range((n + 9) // 10):
            used = 0
            for i, size in sorted(((c * 1000 + t, len(x or "") // 4) for c, t, _, x in rows if c // 10 == session), reverse=True):
                if used + size <= 200:
                    used += size
                    wanted.append((session, i))
        got = sorted(tuple(r) for r in queries()["bootstrap_many_sessions"](spark, str(sf)).collect())
        con = duckdb.connect()
        con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet/*.parquet'")
        assert got == sorted(wanted) == sorted(con.sql(oracle_sql()["bootstrap_many_sessions"]).fetchall())
        counts[n] = len({s for s, _ in got})
    assert counts == {135: 14, 270: 27}
