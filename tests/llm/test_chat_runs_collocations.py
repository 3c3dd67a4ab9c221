"""Chat formatting, collocations and periodic runs against plain forms, on odd tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format, collocations, runs

SF = "/root/testdata/sf0.001"
SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()

# ---- chat formatting

RECORDS = [
    ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}], "id": 3}, "messages", [("user", "hi"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "q <|end|> \\ [/INST]"}, {"from": "gpt", "value": "a"}]}, "from_value", [("user", "q <|end|> \\ [/INST]"), ("assistant", "a")]),
    ({"instruction": "do", "input": "x", "output": "y", "meta": {"a": [1, 2], "instruction": 5}}, "instruction", [("user", "do\n\nx"), ("assistant", "y")]),
    ({"instruction": "do", "input": "", "output": "y"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"output": "y", "instruction": "do"}, "instruction", [("user", "do"), ("assistant", "y")]),
    ({"prompt": "p", "completion": "c", "system": "s"}, "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": None}, "prompt_response", [("user", "p"), ("assistant", "")]),
    ([{"role": "odd </s>\\", "content": "x\ny\\"}], "message_list", [("odd </s>\\", "x\ny\\")]),
    ({"messages": [{"role": "user", "content": [{"type": "text", "text": "A"}, {"type": "text", "text": "B"}]}]}, "message_blocks", [("user", "AB")]),
    ({"rows": [{"turn": 2, "role": "assistant", "text": "b"}, {"turn": 1, "role": "user", "text": "a"}, {"turn": 2, "role": "assistant", "text": "b"}]}, "turn_rows", [("user", "a"), ("assistant", "b"), ("assistant", "b")]),
    ({"foo": 1, "messages": "text"}, None, None),
    ({"messages": []}, None, None),
    ({}, None, None),
    (None, None, None),
]


def test_layouts_are_told_by_their_paths(spark):
    rows = spark.createDataFrame([(i, json.dumps(r) if r is not None else None, "clash", "clash") for i, (r, _, _) in enumerate(RECORDS)], "i int, j string, layout string, formatted string")
    rows = chat_format.formatted(chat_format.canonical(rows.withColumn("record", F.parse_json("j")), "record"))
    rows = rows.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked(F.col("formatted"), F.col("loss_spans"))).drop("record")
    for r in rows.collect():
        _, layout, turns = RECORDS[r.i]
        assert r.layout == layout, r
        assert (r.turns and [tuple(t) for t in r.turns]) == turns == (r.back and [tuple(t) for t in r.back])
        assert r.loss == (turns and [t for role, t in turns if role == "assistant"])
        assert turns is None or all(r.formatted[s.start : s.end].replace("\\\\", "\0").replace("\\", "").replace("\0", "\\") == x for s, x in zip(r.loss_spans, r.loss))
    assert rows.where("i = 2").first().paths == ["input", "instruction", "meta.a[]", "meta.instruction", "output"]
    assert chat_format.formatted(chat_format.canonical(rows.select(F.parse_json("j").alias("record")).limit(0), "record")).count() == 0


def test_templates_are_reversible_for_all_texts(spark):
    """Texts made of pieces of control strings; no control string is left inside a text, and all comes back."""
    rng = random.Random(5)
    bits = ["<", ">", "/", "s", "</s>", "<s>", "[INST]", "[/INST]", "[", "]", "INST", "\\", "\\\\", "<<SYS>>", "<</SYS>>", "|", "<|role|>", "<|text|>", "<|end|>", " ", "\n", "é", "😀"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
    made = [(i, [(rng.choice(["user", "assistant", "system", "tool", text()]), text()) for _ in range(rng.choice([0, 1, 3, 9, 300 if i % 50 == 0 else 2]))]) for i in range(300)]
    rows = spark.createDataFrame(made, "i int, turns array<struct<role:string,text:string>>")
    rows = chat_format.formatted(rows).withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked(F.col("formatted"), F.col("loss_spans")))
    control = re.compile("|".join(map(re.escape, chat_format.INST.control())))
    for r in rows.collect():
        turns = made[r.i][1]
        assert [tuple(t) for t in r.back] == turns
        assert r.loss == [t for role, t in turns if role == "assistant"]
        marks = {"user": 2, "assistant": 1, "system": 2}
        assert len(control.findall(r.formatted)) == 1 + sum(marks.get(role, 3) for role, _ in turns)


def chat_digest(turns):
    loss = "".join(t for role, t in turns if role == "assistant")
    return len(turns), SHA("".join(f"{role}\n{t}\n" for role, t in turns)), len(loss), SHA(loss)


def conversations(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").write.parquet(f"{path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:5] for r in chat_format.op11_chat_format(spark, str(path)).collect()}


def test_chat_query(spark, tmp_path):
    ok = chat_digest([("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")])
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "a\\", "x"), (2, 5, None, "t", "x"), (2, None, "user", "", "x"), (None, 0, "user", "n", "x"), (3, 1, "assistant", "same", "x"), (3, 1, "assistant", "same", "x"), (3, 1, "assistant", "less", "x")]
    long = [(4, i, ("user", "assistant")[i % 2], f"[INST] {i} " * 50, "x") for i in range(600)]
    got = conversations(spark, tmp_path / "a", rows + long)
    assert got == {
        -1: ok, 1: chat_digest([("user", "a\\"), ("assistant", "")]), 2: chat_digest([("user", ""), ("", "t")]), None: chat_digest([("user", "n")]),
        3: chat_digest([("assistant", x) for x in ("less", "same", "same")]), 4: chat_digest([(r[2], r[3]) for r in long]),
    }
    assert conversations(spark, tmp_path / "b", [(1, 1, "user", "x", "x")][:0]) == {-1: ok}


# ---- collocations


def plain_collocations(docs, longest=4, least=30, first=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        n[lang] += 0
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = {(lang, w[i : i + k]) for (lang, w), a in often.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= 80 * often[(lang, w[i : i + k])]}
    out = {}
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, _, le, r = min((2000000 * a // (f[(lang, w[:k])] + f[(lang, w[k:])]), k, f[(lang, w[:k])], f[(lang, w[k:])]) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), le, r))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, le, r) in enumerate(sorted(rows)[:first])}


def random_docs(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "b", "éa", "c\x1f", "É", "x" * 40, "Zz", "0", "-"]
    sep = [" ", " ", " ", "  ", "\t", ". ", "\n", ";", "\x0b"]
    return [(rng.choice(["en", "fr", None, "", "und"]), "".join(x for _ in range(rng.randint(0, 60)) for x in (rng.choice(words[: rng.randint(2, 10)]), rng.choice(sep)))) for _ in range(n)] + [("en", None), (None, ""), ("de", " ,"), ("en", "word")]


@pytest.mark.parametrize("max_bits", [28, 3])
def test_collocations(spark, monkeypatch, max_bits):
    """Also with a bit table that is nearly full: it prunes less, and the result is the same."""
    monkeypatch.setattr(collocations, "BLOCK_CHARS", 3000)
    monkeypatch.setattr(collocations, "PAGE_BITS", 1 << 10)
    docs = random_docs(max_bits, 300)
    table = spark.createDataFrame([(lang, t, 1, "x") for lang, t in docs], "lang string, text string, phrase int, f string")
    for longest, least, first in ((4, 30, 2000), (4, 5, 7), (2, 3, 50)):
        got = collocations.collocations(table, longest=longest, least=least, first=first, max_bits=max_bits)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in got.collect()} == plain_collocations(docs, longest, least, first)
    assert collocations.collocations(table.limit(0)).count() == 0
    assert collocations.collocations(table.withColumn("text", F.lit(None).cast("string"))).count() == 0


def test_scores_pass_64_bits(spark):
    rows = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_001, 9_000_000_000_000_007)], "a long, l long, r long")
    assert rows.select(collocations.score()).first()[0] == 2000000 * 9_000_000_000_000_000 // (18_000_000_000_000_008)


def test_collocations_sql(spark):
    d = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet'").fetchall()
    assert {tuple(r) for r in collocations.op12_collocations(spark, SF).collect()} == plain_collocations(d)


# ---- periodic runs


def plain_runs(w, least):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - p:
            s = i
            while i < len(w) - p and w[i] == w[i + p]:
                i += 1
            n = i + p - s
            if i > s and n >= max(least, 2 * p) and not any(all(w[k] == w[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                out.append((s, n, p))
            i += i == s
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_all_kinds_of_sequences():
    rng = random.Random(2)
    for _ in range(6000):
        n, k, least = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 4]), rng.choice([1, 2, 12])
        w = [rng.randrange(k) for _ in range(n)]
        if n > 4 and rng.random() < 0.3:
            a = rng.randrange(n)
            p = 1 + rng.randrange((n - a) // 2 + 1)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert runs.runs_of(w, least) == plain_runs(w, least), w


def test_next_smaller_suffixes():
    rng = random.Random(3)
    for _ in range(1500):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 30))]
        for rising in (True, False):
            f = [x if rising else -x for x in w]
            after, agrees = runs.edges(w, rising)
            for i in range(len(w)):
                j = next((j for j in range(i + 1, len(w)) if f[j:] < f[i:]), len(w))
                e = 0
                while j + e < len(w) and w[i + e] == w[j + e]:
                    e += 1
                assert after[i] == j and (j == len(w) or agrees[i] == e)


def test_comparisons_grow_with_the_length():
    """Words that count comparisons: sequences full of repeats take a bounded number of them for each word."""

    class Word(int):
        seen = 0

        def __eq__(self, other):
            Word.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    fib = [[0], [0, 1]]
    while len(fib[-1]) < 20000:
        fib.append(fib[-1] + fib[-2])
    for whole in ([0] * 20000, fib[-1], [i.bit_count() & 1 for i in range(20000)], [i % 2857 * 7919 % 1000 for i in range(20000)], [x for k in range(2, 200) for x in [0] * k + [1]]):
        per_word = []
        for n in (2000, 16000):
            Word.seen = 0
            runs.runs_of([Word(x) for x in whole[:n]], 1)
            per_word.append(Word.seen / n)
        assert per_word[1] < 12 and per_word[1] < 1.5 * per_word[0] + 1


def plain_collapse(text, least=12):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    found = plain_runs(w, least)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return found, " ".join(x for i, x in enumerate(w) if i not in gone)


def run_docs(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = [f"w{rng.randrange(rng.choice([2, 5, 1000]))}" for _ in range(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            a, b = sorted((rng.randint(0, len(w)), rng.randint(0, len(w))))
            w = w[:a] + w[a:b] * rng.randint(1, 4) + w[b:]
        out.append((i, rng.choice([" ", "\n", "  ", "\t\x0b"]).join(w)))
    return out + [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "\x85 \xa0 é " * 9), (n + 3, "\x85 \xa0 é " * 9), (n + 4, "a " * 30000), (n + 5, " ".join(str(i % 4999) for i in range(25000)) + " z"), (None, "b " * 20)]


def test_collapse(spark):
    docs = run_docs(1, 300)
    rows = runs.collapsed(spark.createDataFrame([(i, t, "x", 7) for i, t in docs], "doc_id long, text string, runs string, other int"))
    expected = Counter()
    for i, t in docs:
        if i is not None and i >= 304:  # long: their runs are known
            continue
        found, left = plain_collapse(t)
        expected[(i, tuple(found), left)] += 1
    got = {(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed): 0 for r in rows.collect()}
    assert len(rows.collect()) == len(docs) and set(expected) <= set(got)
    by_id = {k[0]: k for k in got}
    assert by_id[304][1:] == (((0, 30000, 1),), "a") and by_id[305][1] == ((0, 25000, 4999),)
    assert runs.collapsed(rows.select("doc_id", "text").limit(0)).count() == 0


def test_runs_query(spark, tmp_path):
    docs = run_docs(4, 250)[:-3] + [(None, "b " * 20)]
    spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, start string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = Counter()
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        n, h = len(w), zlib.crc32(("" if i is None else str(i)).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        found, left = plain_collapse(" ".join(w))
        s, length, p = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        expected[(i, len(found), s, length, p, length and 1000 * length // p, SHA("".join(f"{a},{b},{c}\n" for a, b, c in found)), SHA(left))] += 1
    assert Counter(tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()) == expected
