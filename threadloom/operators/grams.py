"""An index of character trigrams for substrings and patterns: which documents can hold a text at all.

A document that holds a string holds each of its trigrams, case aside. A search looks up the trigrams that its query
needs, takes the documents that have them, and then asks the real predicate (``recall.like``, ``recall.regex``) about
those only: the index never decides, so results are those of a scan. It may therefore name documents that have
changed or gone, and needs no tombstones; all rows that are searched must have been given to it, with their present texts.

Tables (``sources.snapshots``): postings (gram, ids, batch), sorted by gram, of which each row lists the documents of one
block of texts; grams (gram, n, batch), the number of documents of each gram; segments (batch, n). Of a long string only the rarest trigrams are read. Where the query needs none, or
where those it needs are nearly everywhere, there is nothing to save, and the rows are scanned.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as parsed_patterns

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators import recall
from threadloom.sources.snapshots import Change, Snapshots

WRITER = "grams"
#: Of the trigrams of one string, so many (the rarest) are looked up.
PER_STRING = 6
#: Texts of about so many characters make one row a trigram; a merge makes lists of about so many documents.
BLOCK_CHARS, LISTED = 2_000_000, 20_000
#: If more than this share of the documents can match, the rows are scanned.
MOST_OF_ALL = 0.5
#: Letters that match a letter other than their lower case when case is ignored (long s, Kelvin sign, dotless i).
LOOSE = frozenset("ksi")


def folded(text: Column) -> Column:
    """Lower case, in which a part of a text is a part of the folded text: the sigma at a word's end is the usual one."""
    return F.translate(F.lower(text), "ς", "σ")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, ids): the different trigrams of folded texts, each with its documents, a row for each block of texts.

    None of a null or of less than three characters. A row a gram and block, instead of one a gram and document, is what is dealt out and sorted.
    """
    schema = T.StructType([T.StructField("gram", T.StringType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType))])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ends = np.cumsum([len(t) for t in texts])
            cuts = [0, *(np.flatnonzero(np.diff(ends // BLOCK_CHARS)) + 1).tolist(), len(texts)]
            for i, j in itertools.pairwise(cuts):
                if i < j:
                    grams, lists = gram_lists(texts[i:j], batch.column(0).slice(i, j - i))
                    yield pa.RecordBatch.from_arrays([grams, lists], names=schema.names)

    rows = docs.select(F.col(id_col).alias("id"), folded(F.col(text_col)).alias("text")).where("length(text) >= 3")
    return rows.mapInArrow(run, schema)


def gram_lists(texts: list[str], ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The trigrams of texts of three characters or more, and the ids of the texts of each."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(len(texts)), size - 2)
    at = np.arange(len(owner)) + 2 * owner  # each text has two places at which no trigram begins
    keys = points[at] << np.uint64(42) | points[at + 1] << np.uint64(21) | points[at + 2]
    order = np.argsort(keys, kind="stable")  # texts stay in order
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    once = new.copy()
    once[1:] |= owner[1:] != owner[:-1]
    keys, starts = keys[new], np.append(np.flatnonzero(new[once]), once.sum())
    low = np.uint64((1 << 21) - 1)
    chars = np.stack([keys >> np.uint64(42), keys >> np.uint64(21) & low, keys & low], 1).astype(np.uint32).tobytes().decode("utf-32-le")
    return pa.array([chars[k : k + 3] for k in range(0, len(chars), 3)]), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), ids.take(pa.array(owner[once])))


def build(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """A new index of these documents; what was at the place is replaced by a new version."""
    with Snapshots(docs.sparkSession, path).begin() as change:
        _segment(change, docs, id_col, text_col, 0, change.replace)


def append(docs: DataFrame, id_col: str, text_col: str, path: str, batch: int) -> bool:
    """Adds new or changed documents; false if this batch, or a later one, is there already."""
    change = Snapshots(docs.sparkSession, path).begin()
    if change.is_applied(WRITER, batch):
        return False
    with change:
        _segment(change, docs, id_col, text_col, batch, change.append)
    return True


def _segment(change: Change, docs: DataFrame, id_col: str, text_col: str, batch: int, put) -> None:
    mark = F.lit(batch).cast("bigint").alias("batch")
    rows = postings(docs, id_col, text_col).select("*", mark)
    # one gram's postings lie together, and a gram that all documents have is split into several files
    put("postings", rows.hint("rebalance", F.col("gram")).sortWithinPartitions("gram"))
    counted = _counted(change)
    put("grams", counted.select("gram", "n", mark).sortWithinPartitions("gram"))
    put("segments", docs.agg(F.count(F.lit(1)).alias("n")).select(mark, "n"))
    change.mark(WRITER, batch)


def _counted(change: Change) -> DataFrame:
    return change.last("postings").groupBy("gram").agg(F.sum(F.size("ids")).cast("long").alias("n"))


def merge(living: DataFrame, id_col: str, path: str) -> None:
    """One segment without the documents that are not among ``living`` any more, and without repeated postings."""
    with Snapshots(living.sparkSession, path).begin() as change:
        batch = F.lit(change.base["applied"][WRITER]).cast("bigint").alias("batch")
        there = living.select(F.col(id_col).alias("__id"))
        rows = change.read("postings").select("gram", F.explode("ids").alias("id")).join(there, F.col("id").eqNullSafe(F.col("__id")), "left_semi")
        parts = F.lit(-(-living.count() // LISTED) or 1)  # a gram that all documents have makes several lists
        rows = rows.select("gram", "id").distinct().groupBy("gram", F.pmod(F.xxhash64("id"), parts).alias("part"))
        rows = rows.agg(F.collect_list("id").alias("ids"), F.count_if(F.col("id").isNull()).alias("nulls"))
        rows = rows.select("gram", F.when(F.col("nulls") > 0, F.array_append("ids", F.lit(None))).otherwise(F.col("ids")).alias("ids"), batch)
        change.replace("postings", rows.hint("rebalance", F.col("gram")).sortWithinPartitions("gram"))
        change.replace("grams", _counted(change).select("gram", "n", batch).sortWithinPartitions("gram"))
        change.replace("segments", living.agg(F.count(F.lit(1)).alias("n")).select(batch, "n"))


def needs_of_like(query: str) -> list[list[str]]:
    """What a substring query with the wildcards % and _ needs: its pieces, each by itself."""
    return [[piece] for piece in re.split("[%_]", query) if piece]


def needs_of_pattern(pattern: str) -> list[list[str]]:
    """What a text must hold for a Python pattern to be found in it: of each list at least one string.

    Taken from the parse of ``re`` itself: runs of literal characters, also inside groups, repeats that come at least
    once and positive assertions; of alternatives one string each, if every one of them needs one.
    """
    tree = parsed_patterns.parse(pattern)
    return _needs(tree, bool(tree.state.flags & re.IGNORECASE))[1]


def _needs(items, loose: bool) -> tuple[str | None, list[list[str]]]:
    """(the text, if the items can only match one; what they need)."""
    run, whole, found = "", True, []

    def end(start: str = "") -> None:
        nonlocal run
        if len(run) >= 3:
            found.append([run])
        run = start

    for op, value in items:
        name = str(op)
        if name == "LITERAL" and not (loose and (not chr(value).isascii() or chr(value).lower() in LOOSE)):
            run += chr(value)
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            inner, off = (value[3], loose or bool(value[1] & re.IGNORECASE)) if name == "SUBPATTERN" else (value, loose)
            text, more = _needs(inner, off)
            if text is not None:
                run += text
            else:
                whole = False
                end()
                found += more
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            whole = False
            text, more = _needs(value[2], loose)
            if value[0] == 0:
                end()
            elif text is not None:  # the first stands behind what was before, the last before what comes
                run += text * min(value[0], 8)
                end(text)
            else:
                end()
                found += more
        elif name == "BRANCH":
            whole = False
            end()
            each = [_needs(branch, loose)[1] for branch in value[1]]
            if all(each):
                found.append([s for e in each for s in max(e, key=lambda c: min(map(len, c)))])
        elif name == "ASSERT":
            found += _needs(value[1], loose)[1]
        elif name not in ("AT", "ASSERT_NOT"):  # a class, any character, a reference: whatever they match, it parts the run
            whole = False
            end()
    text = run if whole else None
    end()
    return text, found


@dataclass
class Lookup:
    """What a search reads: of each need the grams of its strings; how many postings and documents that makes at most."""

    grams: list[list[list[str]]]
    postings: int
    most: int
    documents: int

    @property
    def worthwhile(self) -> bool:
        return bool(self.grams) and self.most <= MOST_OF_ALL * self.documents


def lookup(spark: SparkSession, path: str, needs: list[list[str]], version: int | None = None) -> Lookup:
    """Chooses the grams to read by their numbers of documents, one small read of the table of grams.

    A need with a string of less than three characters can't be looked up and is left to the predicate.
    """
    store = Snapshots(spark, path)
    split = []
    for need in needs:
        cut = [list(dict.fromkeys(s[i : i + 3] for i in range(len(s) - 2))) for s in (_folded(spark, s) for s in need)]
        if cut and all(cut):
            split.append(cut)
    documents = store.read("segments", version).agg(F.sum("n")).first()[0] or 0
    wanted = sorted({g for cut in split for string in cut for g in string})
    rows = store.read("grams", version).where(F.col("gram").isin(wanted)).groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row a gram of the query
    n = {r.gram: r.n for r in rows}
    rare = lambda string: sorted(string, key=lambda g: (n.get(g, 0), g))[:PER_STRING]
    chosen = [[rare(string) for string in cut] for cut in split]
    upper = [sum(n.get(string[0], 0) for string in cut) for cut in chosen]
    read = {g for cut in chosen for string in cut for g in string}
    return Lookup(chosen, sum(n.get(g, 0) for g in read), min(upper, default=documents), documents)


def _folded(spark: SparkSession, text: str) -> str:
    """By Spark's own functions, which fold the constant when they plan: no job."""
    return spark.sql("SELECT translate(lower(:t), 'ς', 'σ')", {"t": text}).first()[0]


def candidates(spark: SparkSession, path: str, found: Lookup, version: int | None = None) -> DataFrame:
    """(id) of the documents that have the grams of a lookup, once each."""
    wanted = sorted({g for cut in found.grams for string in cut for g in string})
    own = Snapshots(spark, path).read("postings", version).where(F.col("gram").isin(wanted)).select("gram", F.explode("ids").alias("id"))
    has = own.groupBy("id").agg(F.collect_set("gram").alias("__g"))  # at most the grams of the query
    one = lambda string: F.size(F.array_intersect("__g", F.array(*map(F.lit, string)))) == len(string)
    every = [reduce(Column.__or__, [one(string) for string in cut]) for cut in found.grams]
    return has.where(reduce(Column.__and__, every)).select("id")


def _narrowed(rows: DataFrame, id_col: str, path: str, needs: list[list[str]], version: int | None) -> DataFrame:
    found = lookup(rows.sparkSession, path, needs, version)
    if not found.worthwhile:
        return rows
    ids = candidates(rows.sparkSession, path, found, version).withColumnRenamed("id", "__gram_id")
    return rows.join(ids, F.col(id_col).eqNullSafe(F.col("__gram_id")), "left_semi")


def like(rows: DataFrame, id_col: str, column: str, query: str, path: str, version: int | None = None) -> DataFrame:
    """``recall.like`` over the rows that the index names."""
    return recall.like(_narrowed(rows, id_col, path, needs_of_like(query), version), [column], query)


def regex(rows: DataFrame, id_col: str, column: str, pattern: str, path: str, version: int | None = None) -> DataFrame:
    """``recall.regex`` over the rows that the index names."""
    return recall.regex(_narrowed(rows, id_col, path, needs_of_pattern(pattern), version), column, pattern)
