"""Files that grow, are cut and rewritten, read as a stream."""

import json
import random

from pyspark.sql import functions as F

from threadloom.sources import growing, transcripts
from threadloom.streaming.ingest import run_available, upsert_batches


def read_on(spark, path, checkpoint, target, **options):
    run_available(growing.once(growing.entries(spark, str(path), **options)), upsert_batches(str(target)), str(checkpoint))
    return spark.read.option("basePath", str(target)).parquet(str(target))


def values(df):
    return sorted((r.file.rpartition("/")[2], r.value) for r in df.collect())


def test_each_entry_once(spark, tmp_path):
    logs, go = tmp_path / "logs", lambda **o: read_on(spark, logs, tmp_path / "ck", tmp_path / "out", **o)
    logs.mkdir()
    (logs / "a.jsonl").write_bytes(b"one\ntwo\nthr")
    (logs / "b.jsonl").write_bytes("é\n\n".encode())
    (logs / "c.txt").write_bytes(b"other kind\n")
    assert values(go()) == [("a.jsonl", "one"), ("a.jsonl", "two"), ("b.jsonl", ""), ("b.jsonl", "é")]
    with open(logs / "a.jsonl", "ab") as f:  # the unfinished line ends, and goes on
        f.write(b"ee\nfour\n" + b"x" * 200_000 + b"\nlast")
    after = [("a.jsonl", "four"), ("a.jsonl", "one"), ("a.jsonl", "three"), ("a.jsonl", "two"), ("a.jsonl", "x" * 200_000), ("b.jsonl", ""), ("b.jsonl", "é")]
    assert values(go()) == after
    assert values(go()) == after  # nothing new
    (logs / "a.jsonl").write_bytes(b"one\ntwo\nother\nmore\n")  # rewritten: its beginning is known
    assert values(go()) == sorted([*after, ("a.jsonl", "other"), ("a.jsonl", "more")])
    (logs / "a.jsonl").write_bytes(b"one\n")  # cut
    (logs / "b.jsonl").unlink()
    assert values(go()) == sorted([*after, ("a.jsonl", "other"), ("a.jsonl", "more")])
    with open(logs / "a.jsonl", "ab") as f:
        f.write(b"new\n")
    assert values(go()) == sorted([*after, ("a.jsonl", "other"), ("a.jsonl", "more"), ("a.jsonl", "new")])


def test_ranges_of_any_size_give_each_line_once(tmp_path):
    rng = random.Random(3)
    for k in range(60):
        lines = [bytes(rng.choice(b"abc") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(rng.randint(0, 30))]
        path = tmp_path / f"{k}.jsonl"
        path.write_bytes(b"".join(x + b"\n" for x in lines) + b"rest" * rng.randint(0, 1))
        reader = growing.GrowingReader({"path": str(path), "task_bytes": str(rng.randint(1, 60))})
        end = reader.latestOffset()
        got = [(at, value) for p in reader.partitions({"files": {}}, end) for batch in reader.read(p) for at, value in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
        places = [sum(len(x) + 1 for x in lines[:i]) for i in range(len(lines))]
        assert got == list(zip(places, [x.decode() for x in lines]))
        assert reader.partitions(end, end) == []


def test_offset_reads_ends_only(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * 10 + b"\n" + b"y" * 300_000 + b"\nopen")
    reader = growing.GrowingReader({"path": str(tmp_path)})
    (stop, length, entry), = reader.latestOffset()["files"].values()
    assert (stop, length, entry) == (300_012, 300_001, growing.digest(b"y" * 300_000 + b"\n"))
    path.write_bytes(b"open")
    assert list(reader.latestOffset()["files"].values()) == [[0, 0, ""]]


def test_messages_of_transcripts(spark):
    say = lambda content, role="user", kind=None: json.dumps({"type": kind or role, "message": {"role": role, "content": content}})
    lines = [
        (say("hi "), "hi"), (say("  <system-reminder>x"), None), (say([{"type": "text", "text": "a"}, "b", {"type": "image"}, {"type": "text", "text": "<task-notification> c"}, 5]), "a\nb"), (say("{not json"), "{not json"),
        (say("x Summarize the session transcript below y"), None), (say("[Request interrupted by user]"), None), (say("\x1f ok", "assistant"), "ok"), (say("t", "tool"), None), (say("x", kind="meta"), None), ("no json", None), ("", None), (None, None), ("[1]", None), (say(None), None), (say({"type": "text"}), None), (say([]), None),
    ]
    raw = spark.createDataFrame([(i, x, "clash") for i, (x, _) in enumerate(lines)], "line int, value string, role string")
    found = transcripts.parse(raw)
    assert found.columns == ["line", "role", "content"]
    assert {r.line: r.content for r in found.collect()} == {i: c for i, (_, c) in enumerate(lines) if c is not None}
    assert found.where(F.col("role") == "assistant").count() == 1
