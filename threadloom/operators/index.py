"""A full-text index of immutable segments: postings (term, batch, block, at, tf, docs), lengths (id, batch, block, at, dl) and tombstones.

Each batch of documents is a segment. A document that comes again, or goes, leaves a tombstone for the place that it
has; nothing is rewritten until ``merge`` makes one segment of what lives. All of it is one set of versioned
tables (``sources.snapshots``): a batch that is replayed finds itself applied and changes nothing, a search reads one
version, and of two writers at once the second is refused.

A task numbers its documents in blocks of about ``BLOCK_BYTES`` of text. A row of postings lists the places (``at``) in one
block of the documents that have a term, and how often (``tf``) they have it, as packed 32-bit integers; the row of the empty term
lists all documents of the block, their ids and their lengths. So texts aren't dealt out, and what is sorted and written is a row a term and block. A search reads
the rows of its own terms only (each file is sorted by term, so that a scan skips the other pages): a word that all documents
have is no hot key, as its lists end with their blocks. Numbers of documents and their mean length are sums that each
segment has written, less those of tombstones.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.functions.text import LATIN, parted
from threadloom.operators.recall import B, K1
from threadloom.sources.scratch import short_batches
from threadloom.sources.snapshots import Change, Snapshots

WRITER = "index"
#: A block has about so many bytes of text, of which each document takes some, however short it is; merged blocks about so many words.
BLOCK_BYTES, LEAST_BYTES, BLOCK_WORDS = 12_000_000, 64, 2_000_000
#: What names a document, wherever it is.
PLACE = ["batch", "block", "at"]


def _schema(id_type: T.DataType) -> T.StructType:
    doc = T.StructType([T.StructField("id", id_type), T.StructField("dl", T.LongType())])
    return T.StructType([T.StructField("term", T.StringType()), T.StructField("block", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("tf", T.BinaryType()), T.StructField("docs", T.ArrayType(doc))])


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, block, at, tf, docs) of all documents, in blocks that no two tasks share; a null text is empty."""
    schema = _schema(docs.schema[id_col].dataType)

    def run(batches):
        first, number = TaskContext.get().partitionId() << 32, itertools.count()
        held, size = [], 0

        def block():
            ids, texts = (pa.concat_arrays([h[i] for h in held]) for i in (0, 1))
            held.clear()
            terms, term, at, tf = _postings_of(texts)
            docs = pa.StructArray.from_arrays([ids, pa.array(np.bincount(at, tf, len(ids)).astype(np.int64))], ["id", "dl"])
            return _block(first + next(number), docs, terms, term, at, tf)

        for batch in batches:
            if batch.num_rows:
                ids, texts = batch.column(0), pa.array([t.translate(LATIN) for t in batch.column(1).to_pylist()], pa.string())
                ends = size + np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + LEAST_BYTES)
                full = np.flatnonzero(np.diff(ends // BLOCK_BYTES, prepend=size // BLOCK_BYTES)) + 1
                start, size = 0, int(ends[-1])
                for stop in full.tolist():
                    held.append((ids.slice(start, stop - start), texts.slice(start, stop - start)))
                    start = stop
                    yield block()
                if start < len(ids):
                    held.append((ids.slice(start), texts.slice(start)))
        if held:
            yield block()

    rows = docs.select(F.col(id_col).alias("id"), parted(F.coalesce(text_col, F.lit(""))).alias("text"))
    return rows.mapInArrow(run, schema)


def _postings_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of texts in order, and of each posting the term's number, the text's and how often it comes, in this order."""
    words = pc.ascii_split_whitespace(texts)
    coded = words.flatten().dictionary_encode()
    terms, rank = _sorted(coded.dictionary)
    keys = rank[coded.indices.to_numpy()] * len(texts) + pc.list_parent_indices(words).to_numpy()
    keys.sort()
    if len(terms) and terms[0].as_py() == "":  # what is before a first space and behind a last one is no term
        keys = keys[np.searchsorted(keys, len(texts)) :]
    starts = np.flatnonzero(_changes(keys))
    return terms, *np.divmod(keys[starts], len(texts)), np.diff(np.append(starts, len(keys)))


def _sorted(terms: pa.Array) -> tuple[pa.Array, np.ndarray]:
    order = pc.sort_indices(terms).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return terms.take(pa.array(order)), rank


def _changes(keys: np.ndarray) -> np.ndarray:
    """Where a sorted array has another value than before."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return new


def _block(block: int, docs: pa.Array, terms: pa.Array, term: np.ndarray, at: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The rows of a block: that of its documents, and one for each term, of postings that are sorted by term and document."""
    own = np.flatnonzero(_changes(term))
    rows = len(own) + 1
    starts = np.concatenate([[0], own, [len(term)]])
    listed = pa.ListArray.from_arrays(pa.array([0, *[len(docs)] * rows], pa.int32()), docs, mask=pa.array(np.arange(rows) > 0))
    names = pa.concat_arrays([pa.array([""]), terms.take(pa.array(term[own]))])
    return pa.RecordBatch.from_arrays([names, pa.array(np.full(rows, block), pa.int64()), _packed(starts, at), _packed(starts, tf), listed], names=["term", "block", "at", "tf", "docs"])


def _packed(starts: np.ndarray, numbers: np.ndarray) -> pa.Array:
    """Lists of numbers that begin at these places, the last of which is the end."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer((4 * starts).astype(np.int32)), pa.py_buffer(numbers.astype("<i4"))])


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, and how many there are in each."""
    lists = lists.cast(pa.binary())
    _, ends, data = lists.buffers()
    ends = np.frombuffer(ends, np.int32)[lists.offset : lists.offset + len(lists) + 1] if len(lists) else np.zeros(1, np.int32)
    return np.frombuffer(data or b"", "<i4", (ends[-1] - ends[0]) // 4, ends[0]), np.diff(ends) // 4


def _spread(batches):
    """A row for each document of a row of postings."""
    for batch in batches:
        (at, n), (tf, _) = _unpacked(batch["at"]), _unpacked(batch["tf"])
        row = pa.array(np.repeat(np.arange(batch.num_rows), n))
        yield pa.RecordBatch.from_arrays([*(batch[c].take(row) for c in ("term", "batch", "block")), pa.array(at), pa.array(tf)], names=["term", "batch", "block", "at", "tf"])


def build(docs: DataFrame, id_col: str, text_col: str, path: str) -> None:
    """A new index of these documents; what was at the place is replaced by a new version."""
    store = Snapshots(docs.sparkSession, path)
    with store.begin() as change:
        _segment(change, docs, id_col, text_col, 0, change.replace)
        change.replace("tombstones", change.last("lengths").limit(0))
        change.mark(WRITER, 0)


def _segment(change: Change, docs: DataFrame, id_col: str, text_col: str, batch: int, put) -> None:
    with short_batches(docs.sparkSession):
        _put(change, postings(docs, id_col, text_col), batch, put)
        if not change.last("lengths").groupBy("id").count().where("count > 1").isEmpty():  # texts of one id are one document: this is rare
            for name in ("postings", "lengths"):
                change.tables[name]["parts"].pop()
            whole = docs.groupBy(F.col(id_col).alias("id")).agg(F.concat_ws(" ", F.collect_list(text_col)).alias("text"))
            _put(change, postings(whole, "id", "text"), batch, put)
    put("segments", _sums(change.last("lengths"), batch))


def _put(change: Change, rows: DataFrame, batch: int, put) -> None:
    put("postings", rows.select("term", F.lit(batch).cast("bigint").alias("batch"), "block", "at", "tf", "docs").sortWithinPartitions("term", "block"))
    docs = change.last("postings").where("term = ''").select("batch", "block", F.posexplode("docs").alias("at", "doc"))
    put("lengths", docs.select("doc.id", *PLACE, "doc.dl"))


def _sums(lengths: DataFrame, batch: int) -> DataFrame:
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).select(F.lit(batch).cast("bigint").alias("batch"), "n", "total")


def living(change: Change) -> DataFrame:
    """(id, batch, block, at, dl) of the documents that no tombstone names."""
    return change.read("lengths").join(change.read("tombstones").select(*PLACE), PLACE, "left_anti")


def append(docs: DataFrame, id_col: str, text_col: str, path: str, batch: int) -> bool:
    """Adds a batch of documents as a segment; false if this batch, or a later one, is there already.

    A document that the index has is superseded: the old one gets a tombstone.
    """
    change = Snapshots(docs.sparkSession, path).begin()
    if change.is_applied(WRITER, batch):
        return False
    with change:
        again = living(change).join(docs.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
        change.append("tombstones", again)
        _segment(change, docs, id_col, text_col, batch, change.append)
        change.mark(WRITER, batch)
    return True


def remove(ids: DataFrame, path: str, batch: int) -> bool:
    """Takes documents (id) out: writes tombstones, nothing else; false for a replay."""
    change = Snapshots(ids.sparkSession, path).begin()
    if change.is_applied(WRITER, batch):
        return False
    with change:
        change.append("tombstones", living(change).join(ids.select("id").distinct(), "id", "left_semi"))
        change.mark(WRITER, batch)
    return True


def merge(spark: SparkSession, path: str) -> None:
    """One segment of all that lives; searches before and after give the same scores.

    Blocks are dealt to new ones of about ``BLOCK_WORDS``, each of which is made by itself.
    """
    with Snapshots(spark, path).begin() as change:
        batch = change.base["applied"][WRITER]
        total = change.read("segments").agg(F.sum("total")).first()[0] - (change.read("tombstones").agg(F.sum("dl")).first()[0] or 0)
        part = F.pmod(F.xxhash64("batch", "block"), F.lit(-(-total // BLOCK_WORDS) or 1)).alias("part")
        lists = change.read("postings").where("term <> ''").select("term", "batch", "block", "at", "tf", part)
        gone = change.read("tombstones").select(*PLACE, F.lit(True).alias("gone"))
        docs = change.read("lengths").join(gone, PLACE, "left").select("id", *PLACE, "dl", F.coalesce("gone", F.lit(False)).alias("gone"), part)
        rows = lists.groupBy("part").cogroup(docs.groupBy("part")).applyInArrow(_merged, _schema(docs.schema["id"].dataType))
        _put(change, rows, batch, change.replace)
        change.replace("segments", _sums(change.last("lengths"), batch))
        change.replace("tombstones", change.read("tombstones").limit(0))


def _merged(key: tuple, lists: pa.Table, docs: pa.Table) -> pa.Table:
    """A new block of the living documents of some old ones."""
    docs = docs.sort_by([(name, "ascending") for name in PLACE]).combine_chunks()
    batches, blocks = np.unique(docs["batch"].to_numpy()), np.unique(docs["block"].to_numpy())
    place = lambda t: np.searchsorted(batches, t["batch"].to_numpy()) * len(blocks) + np.searchsorted(blocks, t["block"].to_numpy())
    old, first = np.unique(place(docs), return_index=True)  # an old block's documents are numbered from here
    alive = ~docs["gone"].to_numpy()
    new, n = np.cumsum(alive) - 1, max(int(alive.sum()), 1)
    coded = lists["term"].combine_chunks().dictionary_encode()
    terms, rank = _sorted(coded.dictionary)
    (at, each), (tf, _) = (_unpacked(lists[name].combine_chunks()) for name in ("at", "tf"))
    at = np.repeat(first[np.searchsorted(old, place(lists))], each) + at
    kept = alive[at]
    keys = np.repeat(rank[coded.indices.to_numpy()], each)[kept] * n + new[at[kept]]
    order = np.argsort(keys)
    docs = docs.filter(pa.array(alive)).select(["id", "dl"]).to_struct_array().combine_chunks()
    return pa.Table.from_batches([_block(key[0].as_py(), docs, terms, *np.divmod(keys[order], n), tf[kept][order])])


def search(spark: SparkSession, path: str, words: list[str], version: int | None = None) -> DataFrame:
    """(id, score) of the documents that have all words, by BM25."""
    store = Snapshots(spark, path)
    version = store.manifest(version)["version"]
    query = list(dict.fromkeys(words))
    dead = store.read("tombstones", version)
    own = store.read("postings", version).where(F.col("term").isin(query) & (F.col("term") != ""))
    own = own.select("term", "batch", "block", "at", "tf").mapInArrow(_spread, "term string, batch bigint, block bigint, at int, tf int").join(dead.select(*PLACE), PLACE, "left_anti")
    gone = dead.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    held = store.read("segments", version).agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = (held.n or 0) - gone.n, (held.total or 0) - gone.total
    mean = total / n if n and total else 1.0
    found = dict(own.groupBy("term").count().collect())  # a row a query word
    weight = F.create_map(*[x for w in query for x in (F.lit(w), F.greatest(F.log((F.lit(float(n)) - found.get(w, 0) + 0.5) / (F.lit(float(found.get(w, 0))) + 0.5)), F.lit(1e-6)) * words.count(w))])
    all_of = own.groupBy(*PLACE).agg(F.count(F.lit(1)).alias("have"), F.collect_list(F.struct("term", "tf")).alias("p")).where(F.col("have") == len(query))
    part = lambda x: weight[x.term] * x.tf * (K1 + 1) / (x.tf + K1 * (1 - B + B * F.col("dl") / F.lit(mean)))
    score = F.aggregate(F.array_sort("p"), F.lit(0.0), lambda s, x: s + part(x))
    return all_of.join(store.read("lengths", version), PLACE).select("id", score.alias("score"))
