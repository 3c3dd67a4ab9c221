"""The training-data operators against brute force, on tables written here and on the smallest test table."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import common, exact_dedup, langid, linear, mixing, near_dedup, packing, pii, quality_pu, quality_rules, toxicity, urlfilter

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles string, score string, spans string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def table(spark, rows):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, None, s, None, "x", "x", "x") for i, t, s in rows], SCHEMA)


def odd(spark):
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30000))
    rows = [(1, "a b c d e f g h", "s"), (2, "a b c d e f g h", None), (2, "a b c d e f g h", None), (3, "", "s"), (4, None, "t"), (5, "   \n", "t"), (6, long, "s"), (7, long + " tail", "s"), (8, "word", "u"), (None, "solo text here now", "u")]
    return table(spark, rows)


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def classes(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


def test_exact_dedup(spark):
    out = exact_dedup.dedup(odd(spark)).collect()
    assert len(out) == 10
    by = {}
    for r in out:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)} for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {r.keep_id for r in empty} == {4} and len(empty) == 2
    assert exact_dedup.dedup(odd(spark).limit(0)).count() == 0
    assert exact_dedup.distinct_rows(odd(spark)).count() == 7


def test_exact_dedup_survives_collisions(spark):
    docs = table(spark, [(1, "aa", "s"), (2, "ab", "s"), (3, "aa", "s"), (4, "b", "s")])
    out = exact_dedup.dedup(docs, digest=lambda t: F.substring(t, 1, 1)).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in out} == {(1, 3, 2, False), (3, 3, 2, True), (2, 2, 1, True), (4, 4, 1, True)}


def test_stream_goes_on(spark, tmp_path):
    log = str(tmp_path / "log")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k in range(2):
        exact_dedup.arrivals(docs.where(f"doc_id % 2 = {k}"), "doc_id", "text").write.mode("append").parquet(log)
        exact_dedup.run_stream(spark, log, spark.read.parquet(log).schema, str(tmp_path / "ck"))
    state = exact_dedup.state_table(spark, str(tmp_path / "ck"))
    assert state.agg(F.sum("n")).first()[0] == docs.count()


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup(spark, width, percent):
    rng = random.Random(width)
    docs = [(i, t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()]
    base = [f"v{rng.randint(0, 5000)}" for _ in range(200)]
    for k in range(60):  # copies with one to fifteen words changed: chains and borderline pairs
        w = list(base)
        for _ in range(rng.randint(1, 15)):
            w[rng.randrange(200)] = f"x{rng.randint(0, 10**6)}"
        docs.append((10_000 + k, " ".join(w)))
    docs += [(20_000, "one two"), (20_001, "One TWO"), (20_002, None), (20_003, "")]
    expected = classes(docs, width, percent)
    out = near_dedup.near_dups(table(spark, [(i, t, "s") for i, t in docs]), width=width, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_dedup_in_blocks(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "LIST", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 900)
    test_near_dedup(spark, width, percent)


def set_table(spark, sets, comps):
    grams = [np.sort(near_dedup.mix(np.array(sorted(s), np.uint64))) for s in sets]
    return spark.createDataFrame([(i, c, bytearray(g.tobytes())) for i, (c, g) in enumerate(zip(comps, grams))], "id__ long, component long, set binary")


@pytest.mark.parametrize(("listed", "percent"), [(2, 80), (2, 85), (1000, 80), (1000, 85)])
def test_second_round_joins_all_that_is_linked(spark, monkeypatch, listed, percent):
    """All documents in one bucket, any components: what is joined equals what all pairs would join."""
    monkeypatch.setattr(near_dedup, "LIST", listed)
    monkeypatch.setattr(near_dedup, "BLOCK", 500)
    rng = random.Random(listed + percent)
    sets = []
    for family in range(6):
        base = rng.sample(range(10**6), 60)
        for _ in range(15):
            sets.append(set(base[: rng.randint(40, 60)]) | set(rng.sample(range(10**6), rng.randint(0, 12))) | set(range(5)))
    comps = [i if rng.random() < 0.5 else min(i, 15 * (i // 15)) for i in range(len(sets))]
    table_ = set_table(spark, sets, comps)
    buckets = table_.select(F.lit(1).alias("key"), F.col("id__").alias("rep"))
    known = table_.where("component <> id__").select(F.col("id__").alias("rep"), "component")
    scratch = near_dedup.Scratch(spark, "test")
    found = near_dedup.residual(buckets, known, table_.select("id__", "set"), lambda ids: table_.select("id__", "set").join(ids, "id__"), scratch, percent)
    up = list(comps)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(edges):
        for i, c in enumerate(comps):
            up[i] = c
        for a, b in edges:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
        return [top(i) for i in range(len(sets))]

    similar = lambda a, b: 100 * len(a & b) >= percent * len(a | b)
    links = [(r.a, r.b) for r in found.collect()]
    assert all(similar(sets[a], sets[b]) for a, b in links)
    every = [(a, b) for a in range(len(sets)) for b in range(a) if similar(sets[a], sets[b])]
    assert join(links) == join(every) and len(set(join(every))) < len(set(comps))


def test_templates_make_no_candidates(spark):
    """Texts that share 82 of 100 shingles (similarity 0.7) have no rare shingle in common among the first."""
    rng = random.Random(1)
    sets = [set(range(82)) | set(rng.sample(range(1000, 10**9), 18)) for _ in range(400)]
    table_ = set_table(spark, sets, range(len(sets)))
    rows = near_dedup.first_shingles(table_, near_dedup.frequencies(table_), 80)
    assert rows.count() <= 21 * len(sets)
    lists = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if("short").alias("shorts")).where("n > 1 and shorts > 0")
    assert lists.count() == 0


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + i // 2) for i in range(1, 200)]
    edges = spark.createDataFrame(chain, "a long, b long")
    found = {r.rep: r.component for r in near_dedup.components(edges, near_dedup.Scratch(spark, "test"), "cc").collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


def test_near_dedup_odd_rows(spark):
    out = near_dedup.near_dups(odd(spark))
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in out.collect()) == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 6), (7, 6), (8, 8)]
    assert near_dedup.near_dups(odd(spark).limit(0)).count() == 0
    assert set(near_dedup.representatives(odd(spark)).columns) == set(odd(spark).columns)


def test_near_dedup_null_id_shares_a_set(spark):
    text = " ".join(f"w{i}" for i in range(100))
    near, own, alone = text + " tail", "solo text here now", "no id at all in any of these rows"
    docs = [(None, text), (7, text), (5, text), (None, text.upper()), (9, near), (None, own), (None, alone), (None, alone), (None, ""), (None, None), (3, own)]
    rows = table(spark, [(i, t, "s") for i, t in docs])
    out = near_dedup.near_dups(rows).collect()
    expected = [(None, 5, False)] * 2 + [(7, 5, False), (5, 5, True), (9, 5, False), (None, 3, False), (3, 3, True)] + [(None, None, True)] * 4
    order = lambda x: [(v is None, v or 0) for v in x]
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in out), key=order) == sorted(expected, key=order)
    left = near_dedup.representatives(rows)
    assert left.columns == rows.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(5, text), (3, own), (0, alone), (0, alone), (0, ""), (0, "")])


def test_mixing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mixed(docs).collect()}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert got == {(a, b, s, round(t, 6), k) for a, b, s, t, k in c.sql(mixing.oracle()).fetchall()}
    odd_rows = mixing.mixed(odd(spark)).collect()
    assert len(odd_rows) == 10 and all(r.taken <= 2 * r.size for r in odd_rows)
    assert mixing.mixed(odd(spark).limit(0)).count() == 0
    assert mixing.mixed_rows(docs).agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(t for *_, t in got)


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(2)
    for _ in range(5):
        sizes = {f"s{i:02}": rng.choice([0, 1, 10, 100, 1000]) for i in range(rng.randint(1, 9))}
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
        left, free, target = 1.5 * sum(sizes.values()), set(sizes), {}
        while free:
            w = sum(weight[s] for s in free)
            over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
            if not over:
                target |= {s: left * weight[s] / w for s in free}
                break
            target |= {s: 2.0 * sizes[s] for s in over}
            left, free = left - sum(2 * sizes[s] for s in over), free - over
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"), (5, 2, 1), 1.5, 2.0).collect()}
        assert got == pytest.approx(target)


@pytest.fixture(scope="session")
def bpe():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_words_encode_as_whole_texts(bpe):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    t.encode_special_tokens = True
    rng = random.Random(4)
    texts = ["", " ", "a  b", "a \n b\n", " x", "x ", "it's  'll 12 3 é ", "<|endoftext|> a", "\x1c \x1d a"] + ["".join(rng.choice(" \n\tab'1é.　\x85s") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("  \nabZéÿ×ɐ1290.,'!_-#$~|^`[]\\½²’") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    own = packing.ByteBpe(bpe).encode(texts)
    assert [list(np.frombuffer(x, "<u4")) for x in own] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, bpe):
    docs = odd(spark).where("doc_id is null or doc_id <> 2").repartition(3)
    ids = {r.doc_id: packing.ByteBpe(bpe).encode([r.text or ""])[0] + b"\0\0\0\0" for r in docs.collect()}
    pieces = packing.pack(docs, bpe, open_windows=2).collect()
    for key, whole in ids.items():
        own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == whole and all(p.doc_tokens == len(whole) // 4 for p in own)
    seq = {}
    for p in pieces:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs.limit(0), bpe).count() == 0


def check_sequences(pieces, size=1024):
    seq = {}
    for p in pieces:
        seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return seq


def test_packing_of_many_short_documents(spark, bpe, monkeypatch):
    """Three ids each: windows are full of pieces, and leftovers must still come to an end."""
    monkeypatch.setattr(packing, "MERGE_WINDOWS", 8)
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("text")).repartition(6)
    pieces = packing.pack(docs, bpe, open_windows=4).collect()
    seq = check_sequences(pieces)
    assert sum(p.length for p in pieces) == 150_000 and len({p.doc_id for p in pieces}) == 50_000
    assert len(seq) <= 150_000 / 1024 * 1.02 + 1


def test_packing_merges_in_several_groups(spark, bpe, monkeypatch):
    monkeypatch.setattr(packing, "MERGE_WINDOWS", 1)
    docs = spark.range(120).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 13 % 700).cast("int")).alias("text")).repartition(40)
    pieces = packing.pack(docs, bpe, open_windows=3).collect()
    seq = check_sequences(pieces)
    total = sum(p.length for p in pieces)
    assert total == sum({p.doc_id: p.doc_tokens for p in pieces}.values()) and len(seq) <= total / 1024 + 8


def test_sequence_ids_have_room():
    ids = [packing.first_id(t, p) for t in (0, 1, 15) for p in (0, 1, 65_536, packing.PARTITIONS - 1)]
    assert ids == sorted(ids) and len(set(ids)) == len(ids) and ids[-1] + (1 << 35) <= 1 << 63
    with pytest.raises(ValueError):
        packing.first_id(0, packing.PARTITIONS)


def test_little_padding():
    rng, full, windows = random.Random(1), [], []
    p = packing.Packer(1024, 64, lambda w: windows.append(sum(x[2] for x in w)))
    for k in range(3000):
        p.add(k, 0, rng.randint(1, 3000))
    assert 1 - sum(windows) / (1024 * len(windows)) < 0.01 and max(windows) <= 1024


KINDS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(d[::-1])]
            good = {"email": True, "ip": kind == "ip" and max(map(int, m[0].split("."))) <= 255, "card": 12 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0, "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), n, (kind, m.start(), m.end())))
    return [x[2] for x in sorted(out)]


def test_pii(spark):
    rng = random.Random(6)
    for _ in range(20000):
        t = "".join(rng.choice(rng.choice(["0123456789 .-+()@a%_éB", "01.-+@ a", "4111 "])) for _ in range(rng.randint(1, 50)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == plain_spans(t)
    assert [s[0] for s in pii.spans('token = "04dbebab91ab85687d33" IBAN GB82 WEST 1234 5698 7654 32; https://u:p@h.io/x')] == ["secret", "iban", "url", "email"]
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.spans(t)]
    assert found("ssn: 123-45-6789, passport: X1234567; Account no. 12345 678") == [("account", "123-45-6789"), ("account", "X1234567"), ("account", "12345 678")]
    assert found("iban=GB82WEST12345698765432 IBAN GB83 WEST 1234 5698 7654 32") == [("iban", "GB82WEST12345698765432")] and found("account closed, passports") == []
    zeros = "0" * 5000
    assert [s[0] for s in pii.spans(zeros + ".1.1.1")] == ["ip"] and pii.spans(zeros + "1" * 4 + ".1.1.1") == [] and [s[0] for s in pii.spans(zeros + ".0.0." + zeros)] == ["ip"]
    assert pii.find(odd(spark)).where("size(spans) > 0").count() == 0
    assert pii.find(odd(spark).limit(0)).count() == 0 and set(odd(spark).columns) == set(pii.find(odd(spark)).columns)


def test_url_automaton(spark):
    rng = random.Random(8)
    globs = ["*.net\n/*", "a*b?c", "*", "", "a", "*a*", "??", "ab*", "*" + "xyz" * 40 + "*"] + ["".join(rng.choice("ab*?") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    urls = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(300)] + ["x.net\n/p", "q" + "xyz" * 40 + "w", ""]
    hits = urlfilter.Automaton(globs).match([u.encode() for u in urls])
    for k, g in enumerate(globs):
        pattern = re.compile("".join({"*": "(?s:.*)", "?": "(?s:.)"}.get(c, re.escape(c)) for c in g))
        assert [bool(pattern.fullmatch(u)) for u in urls] == list(hits[:, k])
    rows = spark.createDataFrame([(1, "http://A.NET/x?y"), (2, "https://example.net/en/a"), (3, "nothing"), (4, None), (5, "http://notexample.com/de/"), (6, "http://w.example.com/de/#a"), (7, "http://x.net")], "page_id long, url string")
    assert [(r.host, r.rule, r.verdict) for r in urlfilter.judge(rows).orderBy("page_id").collect()] == [("a.net", "net/", "block"), ("example.net", "example.net/en/", "allow"), ("", None, "allow"), ("", None, "allow"), ("notexample.com", None, "allow"), ("w.example.com", "example.com/de/", "block"), ("x.net", None, "allow")]


def test_url_line_feeds_and_odd_tables(spark):
    schema = "page_id long, url string, host int, rule string, verdict string"
    rows = [(1, "http://a.com/b.net\n/c"), (2, "http://a.net\n/c"), (2, "http://a.net\n/c"), (3, "http://x.net/\n"), (4, ""), (5, "http://a.com/www.casino-x\n"), (6, "http://www.casino-x/")]
    out = urlfilter.judge(spark.createDataFrame([(i, u, 1, "x", "y") for i, u in rows], schema)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in out] == [("a.com", "/b.net\n/c", None, "allow"), *[("a.net\n", "/c", None, "allow")] * 2, ("x.net", "/\n", "net/", "block"), ("", "", None, "allow"), ("a.com", "/www.casino-x\n", None, "allow"), ("www.casino-x", "/", None, "block")]
    assert urlfilter.judge(spark.createDataFrame([], schema)).count() == 0


def plain_ftrl(rows, epochs, alpha, beta, l1, l2, size):
    z, n = {}, {}
    weight = lambda i, free: 0.0 if abs(z.get(i, 0)) <= free else -(z[i] - np.sign(z[i]) * free) / ((beta + n.get(i, 0) ** 0.5) / alpha + l2)
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            own = [(i, l1) for i in rows.index[k]] + [(size, 0.0)]
            w = {i: weight(i, free) for i, free in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - rows.label[k]
            for i in w:
                s = ((n.get(i, 0) + g * g) ** 0.5 - n.get(i, 0) ** 0.5) / alpha
                z[i], n[i] = z.get(i, 0) + g - s * w[i], n.get(i, 0) + g * g
    return {i: weight(i, l1) for i in z if i < size and weight(i, l1)}, weight(size, 0.0)


def random_rows(n=60, size=40, seed=3):
    rng = np.random.default_rng(seed)
    rows = linear.Rows.__new__(linear.Rows)
    rows.index = [np.unique(rng.integers(0, size, 6)) for _ in range(n)]
    rows.value = [np.ones(len(i), np.float32) for i in rows.index]
    rows.label = np.array([float(i[0] < 4) for i in rows.index])
    return rows


def test_ftrl_equals_the_plain_rule():
    rows = random_rows()
    m = toxicity.ftrl(rows, 40, epochs=3, l1=0.5 * linear.MAX_ROWS / len(rows))
    w, bias = plain_ftrl(rows, 3, 1.0, 1.0, 0.5, 0.5, 40)
    assert dict(zip(m.index.tolist(), m.weight.tolist())) == pytest.approx(w, rel=1e-5) and m.bias == pytest.approx(bias)


def test_prior_comes_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)

    def rows(good):
        out = linear.Rows.__new__(linear.Rows)
        out.index = [np.unique(rng.integers(0, 50, 8) + (0 if g else 50)) for g in good]
        out.value, out.label = [np.ones(len(i), np.float32) for i in out.index], np.zeros(len(good))
        return out

    pos, unl = rows([True] * 1000), rows(rng.random(1000) < 0.6)
    prior = quality_pu.class_prior(pos, unl)
    assert abs(prior - 0.6) < 0.08
    model = quality_pu.nnpu(pos, unl, prior, epochs=5)
    good, bad = rows([True] * 200), rows([False] * 200)
    assert (good.scores(model.w, model.bias) > 0).mean() > 0.95 and (bad.scores(model.w, model.bias) > 0).mean() < 0.05


def plain_kneser_ney(text_grams, symbols):
    """log P(last | context) of 4-grams by the recursive definition."""
    from collections import Counter

    counts = [None, None, None, None, Counter(text_grams)]
    for order in (3, 2, 1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])

    def p(g):
        order = len(g)
        if not order:
            return 1 / (symbols + 1)
        own = counts[order]
        ones, twos = (sum(c == k for c in own.values()) for k in (1, 2))
        d = min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9)
        same = [c for x, c in own.items() if x[:-1] == g[:-1]]
        if not same:
            return p(g[1:])
        return max(own.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

    return p


def test_kneser_ney_equals_the_plain_definition():
    texts = ["the cat sat on the mat", "that hat is at the cot", "tttt"]
    symbols, place, _ = langid.padded(*langid.normalise(texts))
    grams = ["".join(map(chr, symbols[i - 3 : i + 1])) for i in place]
    p = plain_kneser_ney(grams, len({g[-1] for g in grams}))
    m = langid.Model({"en": langid.gram_counts(texts)})
    asked = sorted(set(grams)) + ["tha ", "xxxx", "zthe", "at o"]
    packed = np.array([sum(ord(c) << (16 * (3 - k)) for k, c in enumerate(g)) for g in asked], np.uint64)
    assert m.lookup(3, packed)[:, 0] == pytest.approx([np.log(p(g)) for g in asked], abs=1e-4)


def test_language_ties_and_unknown_languages(spark):
    text = "the cat sat on the mat and saw that the rat ran "
    m = langid.train(spark.createDataFrame([(i, f"{text} {i}{text[i:]}", x) for i in range(60) for x in ("b", "a")], "doc_id long, text string, lang string"))
    rng = random.Random(0)
    noise = " ".join("".join(rng.choice("qxzjkvwpy") for _ in range(7)) for _ in range(80))
    pred, score, _, rejected = m.decide([text, noise, "xq"])
    assert pred[0] == "a" and score[0] == pytest.approx(0.5) and list(rejected) == [False, True, False]


@pytest.mark.parametrize("kind", ["op3", "op6", "op7"])
def test_classifiers_on_odd_tables(spark, kind):
    """Nulls, empty and very long texts, repeated rows, clashing columns; no labels, null labels, empty tables."""
    module = {"op3": quality_pu, "op6": quality_rules, "op7": toxicity}[kind]
    label = "toxic" if kind == "op7" else "quality"
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    null = spark.createDataFrame([(1, None), (None, 1), (6, 1), (6, 1), (8, 0)], f"doc_id long, {label} int")
    apply = (lambda d, m: quality_rules.judged(quality_rules.measure(d, m)).withColumn("score", F.col("probability"))) if kind == "op6" else module.score
    for labels in (none, null):
        model = module.train(odd(spark), labels)
        out = apply(odd(spark), model)
        rows = out.collect()
        assert len(rows) == 10 and all(0 <= r.score <= 1 for r in rows) and {"lang", "spans"} <= set(out.columns)
        by = {}
        for r in rows:
            by.setdefault(r.text or "", set()).add(r.score)
        assert all(len(x) == 1 for x in by.values())
        assert apply(odd(spark).limit(0), model).count() == 0
    assert module.train(odd(spark).limit(0), null) is not None


def test_quality_counts(spark):
    rng = random.Random(9)
    texts = ["", None, "a b", "x y z w v " * 3 + "end", "é# ñ|\n\nq\nq\n q\n"] + ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    model = quality_rules.Model(np.zeros(1 << quality_rules.BITS), 0.0)
    rows = quality_rules.measure(table(spark, [(i, t, "s") for i, t in enumerate(texts)]), model).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_quality_does_not_depend_on_neighbours():
    model = quality_rules.Model(np.random.default_rng(5).normal(size=1 << quality_rules.BITS), 0.1)
    texts = ["", "a", None, "ab", "abc", "abcd", "é", "ten words or so that end in one more word", "\n\n", "x y", ""]
    alone = [model.probability(quality_rules.featurise([t]))[0] for t in texts]
    assert list(model.probability(quality_rules.featurise(texts))) == pytest.approx(alone)
    assert list(model.probability(quality_rules.featurise(texts[::-1]))) == pytest.approx(alone[::-1])


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality_pu.op3_quality_classifier(spark, sf).where("held_out").join(labels, "doc_id")
    assert q.where("quality = predicted").count() / q.count() > 0.9
    t = toxicity.op7_toxicity(spark, sf).where("held_out").join(labels, "doc_id")
    assert t.where("toxic = predicted").count() / t.count() > 0.85
    r = quality_rules.op6_quality_rules(spark, sf).join(labels, "doc_id").where(linear.held_out("doc_id"))
    assert r.where("kept = (quality = 1)").count() / r.count() > 0.85


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    out = langid.op10_language_id(spark, sf).join(docs, "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = langid.identify(table(spark, [(1, None, "s"), (2, "12 !?", "s"), (3, "", "s"), (4, "the", "s")]), model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][:3] == ["und"] * 3 and all(r.rejected for r in rows[:3]) and 0 <= rows[3].score <= 1
    empty = langid.train(table(spark, []).withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(odd(spark), empty).where("not rejected").count() == 0


def test_language_of_one_document(spark):
    own = "żółw je źdźbło trawy i śpi w cieniu drzewa nad rzeką"
    docs = [(i, f"the cat sat on the mat and number {'abcdefgh'[i]} ran away from the dog", "en") for i in range(8)] + [(8, own, "pl")]
    model = langid.train(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    pred, _, _, rejected = model.decide([own, "źdźbło trawy nad rzeką", "the dog sat on the mat"])
    assert model.languages == ["en", "pl"] and pred == ["pl", "pl", "en"] and not rejected[0]


def test_language_of_symbols_beyond_the_basic_plane():
    m = langid.Model({"en": langid.gram_counts(["the cat sat on the mat"]), "es": langid.gram_counts(["lo que se ve"])})
    pred, score, _, rejected = m.decide(["\U0001F600\U0001F680", "\U0001D7D8", "the \U0001F600 cat", "\U00020000\U0001D400"])
    assert pred[:2] == ["und"] * 2 and list(score[:2]) == [0, 0] and list(rejected) == [True, True, False, False]
    assert list(langid.normalise(["a\U0001F600b"])[0]) == list(langid.normalise(["a b"])[0])
    assert list(langid.normalise(["\U00020000\U0001D400"])[0]) == [0xAC00] * 2


def test_probabilities_sum_to_one():
    g, n = langid.gram_counts(["the cat sat on the mat", "that hat"])
    m = langid.Model({"en": (g, n)})
    letters = np.unique(g & np.uint64(0xFFFF))
    context = (g[3] >> np.uint64(16)) << np.uint64(16)
    total = np.exp(m.lookup(3, context | letters)).sum() + np.exp(m.lookup(3, np.array([context | np.uint64(0x4E2D)]))).sum()
    assert total == pytest.approx(1, abs=0.02)


def test_pipeline(spark):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, SF)
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    last = {}
    for i, t in docs:
        last[t] = max(last.get(t, -1), i)
    left = {i: t for t, i in last.items()}
    kept = {i for i, (_, c) in classes(list(left.items()), 5, 80).items() if i == c}
    found = {r.doc_id for r in pieces.select("doc_id").distinct().collect()}
    assert found <= kept and len(found) > len(kept) / 2


def test_pipeline_exactly(spark):
    """Each document comes as often as plain forms of the stages say, and each copy's ids lie in the pieces once."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    known = {r.doc_id for r in langid.identify(docs, langid.train(docs)).where("not rejected").select("doc_id").collect()}
    rows = [r for r in duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall() if r[0] in known]
    last = {}
    for i, t, _ in rows:
        last[t] = max(last.get(t, -1), i)
    left = {i: t for t, i in last.items()}
    kept = {i for i, (_, c) in classes(list(left.items()), 5, 80).items() if i == c}
    stay = pa.table({"doc_id": [i for i, _, _ in rows if i in kept], "text": [t for i, t, _ in rows if i in kept], "source": [x for i, _, x in rows if i in kept]})
    con = duckdb.connect()
    con.register("stay", stay)
    times = {i: taken // size for i, size, taken in con.execute(f"SELECT doc_id, size, taken FROM ({mixing.oracle('stay')})").fetchall() if size}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected, found = {}, {}
    for i, n in times.items():
        ids = [*tokenizer.encode(left[i], add_special_tokens=False).ids, 0]
        if n:
            expected[i] = (len(ids), {at: n for at in range(len(ids))})
    for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "doc_tokens").collect():
        _, seen = found.setdefault(r.doc_id, (r.doc_tokens, {}))
        for at in range(r.start, r.start + r.length):
            seen[at] = seen.get(at, 0) + 1
    assert known and len(kept) < len(left) < len(rows) and max(times.values()) == 2 and min(times.values()) == 0
    assert found == expected


def test_frequencies_are_collected_as_bytes(spark, monkeypatch):
    """The driver gets a byte a slot, in strips, and no table of counts."""
    rng, plain = np.random.default_rng(3), {}
    sets = [np.unique(rng.integers(0, 2000, 300)).astype(np.uint64) for _ in range(40)]
    for s in sets:
        for slot in near_dedup.slots(s):
            plain[slot] = plain.get(slot, 0) + 1
    monkeypatch.delattr("pyspark.sql.DataFrame.toArrow", raising=False)
    monkeypatch.delattr("pyspark.sql.classic.dataframe.DataFrame.toArrow", raising=False)
    found = near_dedup.frequencies(spark.createDataFrame([(bytearray(s.tobytes()),) for s in sets], "set binary"))
    wanted = np.zeros(near_dedup.SLOTS, np.uint8)
    for slot, n in plain.items():
        wanted[slot] = min(int(6 * np.log2(n)), 255)
    assert (found == wanted).all() and len(np.unique(found)) > 5


def test_a_worker_keeps_one_large_thing(bpe):
    encode = packing.encoder(bpe)
    assert packing.encoder(bpe).__self__ is encode.__self__
    common.kept()
    assert packing.encoder(bpe).__self__ is not encode.__self__


def test_words_are_encoded_once_a_block(bpe):
    """Texts whose words repeat, begin with white space or follow several spaces, in blocks that meet a small cache."""
    from tokenizers import Tokenizer

    own, whole = packing.ByteBpe(bpe), Tokenizer.from_file(bpe)
    own.CACHE = 5
    texts = ["", " ", "a", "a b a b", "  a  b", "x \n y", "a  b 　c  d", "日本 語 日本", "don't stop, don't", "b\tc b\td", "é́ é ééé", "a" * 50 + " " + "a" * 50]
    for block in (texts, texts[::-1], texts[3:5], [], texts):
        assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(block)] == [whole.encode(t, add_special_tokens=False).ids for t in block]
