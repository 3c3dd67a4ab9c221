"""Periodic runs of words and their collapse, by Lyndon arrays on an ordered alphabet (operator 13).

Every run (a maximal stretch of period q and at least 2q words) holds a Lyndon word of length q that is the
longest one at its place, under an order of the words or under its reverse. So the edges (i, next smaller
suffix of i) of both orders give all candidates, at most two a word, and each needs its extensions only.

The next smaller suffixes come from one scan with a chain of candidates. The scan remembers the furthest
match seen so far (a copy of an earlier stretch): a comparison inside the copy takes the answer that the
original had, and only one that reaches its end goes on, from there. No suffix array or tree is built, and
no stretch of words is hashed.

Before that, words that occur once in a stretch cut it: each word of a run occurs in it twice. This is done
for a block of texts at once, and leaves little to scan of ordinary prose.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import map_text

#: A run has this many words at least.
LEAST = 12
#: Stretches are cut at single words so many times at most; what is left is scanned as it is.
CUTS = 8
WORDS = r"[^\x20\x09-\x0D]+"
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def edges(w: list[int], rising: bool = True) -> tuple[list[int], list[int]]:
    """For each place the next smaller suffix (or the end), and how far the two agree.

    Words are compared by number, or with ``rising`` false by its reverse; a suffix that is a prefix of
    another is the smaller one in both.
    """
    n = len(w)
    before, agrees_before = [-1] * n, [0] * n  # the previous smaller suffix, and how far it agrees
    after, agrees_after = [n] * n, [0] * n
    copy = shift = reach = 0  # w[copy:reach] equals w[copy - shift:reach - shift]; no match has got further than reach
    for y in range(1, n):
        c, popped, known = y - 1, -1, 0
        while c >= 0:
            if popped >= 0 and agrees_before[popped] != known:
                e = min(known, agrees_before[popped])
            else:
                e, open_ = known, True
                if y < reach:
                    if y - c == shift:
                        e, open_ = reach - y, False
                    elif c >= copy:
                        b, x = c - shift, y - shift
                        seen = agrees_before[x] if before[x] == b else agrees_after[b] if after[b] == x else -1
                        if 0 <= seen < reach - y:
                            e, open_ = seen, False
                        elif seen >= 0 and reach - y > e:
                            e = reach - y
                if open_:
                    i, j = c + e, y + e
                    while j < n and w[i] == w[j]:
                        i += 1
                        j += 1
                    e = j - y
                    if j > reach:
                        copy, shift, reach = y, y - c, j
            if y + e < n and (w[c + e] < w[y + e]) == rising:
                agrees_before[y] = e
                break
            after[c], agrees_after[c] = y, e
            popped, known, c = c, e, before[c]
        before[y] = c
    return after, agrees_after


def runs_of(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``least`` items, by start, then period."""
    found = set()
    for rising in (True, False):
        after, agrees = edges(w, rising)
        done: dict[int, int] = {}  # by period, the end of the stretch that was looked at last
        for i, r in enumerate(agrees):
            if r:
                j = after[i]
                p, end = j - i, j + r
                if done.get(p) != end:
                    done[p] = end
                    s, t = i - 1, j - 1
                    while s >= 0 and w[s] == w[t]:
                        s -= 1
                        t -= 1
                    if end - s - 1 >= max(least, 2 * p):
                        found.add((s + 1, end - s - 1, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Ranges of places that can hold runs: stretches of one text in which (nearly) every word occurs twice."""
    at, group = np.arange(len(ids)), doc.astype(np.int64)
    size = int(ids.max()) + 1 if len(ids) else 1
    out_of = None
    for _ in range(CUTS):
        _, back, count = np.unique(group * size + ids[at], return_inverse=True, return_counts=True)
        at = at[count[back] > 1]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] >= least if len(at) else np.zeros(0, bool)
        at, group = at[keep], group[keep]
        if len(at) == out_of or not len(at):
            break
        out_of = len(at)
    if not len(at):
        return []
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(first, [*first[1:], len(at)])]


def block_runs(texts: list[str | None], least: int = LEAST) -> tuple[list[list[dict]], list[bytes]]:
    """Of each text its runs, and the words that stay, joined by one space."""
    words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]  # bytes split at the contract's white space only
    counts = [len(x) for x in words]
    flat = [x for own in words for x in own]
    ids = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy()
    doc, first = np.repeat(np.arange(len(texts)), counts), np.cumsum([0, *counts])
    found: list[list[dict]] = [[] for _ in texts]
    kept = np.ones(len(flat), bool)
    for a, b in stretches(ids, doc, least):
        d = int(doc[a])
        for s, n, p in runs_of(ids[a:b].tolist(), least):
            found[d].append({"start": a + s - int(first[d]), "length": n, "period": p})
            kept[a + s + p : a + s + n] = False
    left = [b" ".join(own) if not f else b" ".join([x for x, k in zip(own, kept[i:].tolist()) if k]) for own, f, i in zip(words, found, first)]
    return found, left


def collapsed(docs: DataFrame, text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed``, the text without
    the repeats of its runs: of each run the first ``period`` words stay, words are joined by one space.

    Words are separated by \\x20 and \\x09-\\x0D. Null and empty texts have no runs and an empty collapsed text.
    A text is handled whole, however long it is; rows are independent of each other, so repeated rows are
    treated alike and an empty table stays empty. Columns named ``runs`` and ``collapsed`` are replaced,
    all others pass through.
    """
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(texts):
        found, left = block_runs(texts, least)
        return [pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())]

    return map_text(docs, text_col, run, [T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])


def repeated(text: Column, id_col: Column) -> Column:
    """The contract's texts: where crc32 of the id ends in 0, the words from one place on repeat with a period."""
    h = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w).cast("long")
        place = F.struct((g % n).alias("a"), n.alias("n"))
        made = F.transform(F.array(place), lambda x: F.struct(x.a.alias("a"), (F.lit(1) + F.floor((x.n - x.a) / (3 + g % 8))).alias("p")))
        return F.element_at(F.transform(made, lambda x: F.array_join(F.transform(w, lambda v, i: F.when(i < x.a, v).otherwise(F.get(w, (x.a + (i - x.a) % x.p).cast("int")))), " ")), 1)

    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORDS), F.lit(0))
    return F.when((h % 10 == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.element_at(F.transform(F.array(words), periodic), 1)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = collapsed(docs.select("doc_id", repeated(F.col("text"), F.col("doc_id")).alias("text")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("length"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    rows = rows.withColumn("best", best).withColumn("length", -F.col("best.length"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), "length", F.col("best.period").alias("period"),
        F.floor(F.col("length") * 1000 / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
