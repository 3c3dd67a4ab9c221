"""MinHash near-deduplication (operator 8).

One permutation: each shingle is hashed once; its high bits name a bin and the least hash of a bin
is the bin's minimum. Empty bins borrow from a random full one (optimal densification: the place is
drawn from the bin's number and the attempt, alike for all documents). Bands of bins give bucket
keys. In a bucket one hub is linked with every other member (a star), so that pairs grow with the
members, not their square. Stars that sketches don't speak against are confirmed on full shingle sets.

Links that no star holds (both ends differ from the hub) are found in a second round, over the members
of buckets that still hold several components. It is exact: two sets that are similar enough share a
shingle among the first few of each, in any one order of all shingles. The order is by frequency, rare
ones first, so that passages many documents share don't make candidates. Documents of different
components that share such a shingle are compared: by twos where a shingle has few documents, else in
blocks on full sets, of which only links that join components are put out.

A shingle is known by a 64-bit hash, so sets are sets of hashes: two different shingles of a pair are
taken for one with a probability of about 1e-13 for a pair of sets of 1,000.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import Scratch, given_back, kept, map_text
from threadloom.llm.vectext import Block, U, mix, ngrams

#: A pair of similarity 0.8 shares no band with a probability of 2e-5, one of 0.85 with 1e-7.
BANDS, ROWS = 28, 5
BINS = BANDS * ROWS
#: Up to this many ids (8 bytes each) are broadcast to pick out candidates' texts; beyond, texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Documents with one rare shingle are compared by twos up to this many (at most so many candidates a row), else in blocks.
LIST = 32
#: Shingles of the documents in one block of the exact search; two blocks meet in a task.
BLOCK = 500_000
#: Frequencies of shingles are kept by so many hash slots: a byte each is broadcast, whatever the input.
#: Shingles that share a slot count as more frequent than they are; this costs time only.
SLOTS = 1 << 22
#: Slots whose frequencies one task turns into bytes.
STRIP = 1 << 16
#: Sketches of 8 bits a bin agree about as often as the sets are similar. A star's edge is left out if they
#: agree less than the threshold by so many standard deviations (its ends then meet in the second round).
#: Small sets fill fewer bins by themselves, and so their sketches count as that much shorter.
DEVIATIONS = 4.5
#: Rows with sketches or bands in one scratch file.
WIDE_ROWS = 20_000


def least_share(n: np.ndarray, percent: int) -> np.ndarray:
    """How much of the sketches must agree for a pair whose smaller set has n shingles."""
    t = percent / 100
    return t - DEVIATIONS * np.sqrt(t * (1 - t) / np.clip(n / 2, 1, BINS))


_BIN = np.arange(BINS, dtype=U)
_TRIES = np.array([mix(_BIN * U(0x9E3779B97F4A7C15) + U(t * 0xC2B2AE3D27D4EB4F % 2**64)) % U(BINS) for t in range(1, 65)]).astype(np.int64)
_BAND_SALT = mix(_BIN[:ROWS] + U(17))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of all distinct shingles, ordered by both.

    With fewer words than ``width``, the whole sequence is the one shingle; no word, no shingle.
    """
    b = Block(texts, lower=True)
    starts, ends = b.words()
    doc, counts = b.doc_of(starts)
    h = b.hashes(starts, ends)
    grams, first = ngrams(h, doc, width)
    owner = doc[first]
    few = np.flatnonzero((counts > 0) & (counts < width))
    if len(few):
        begin = np.cumsum(counts) - counts
        whole = np.zeros(len(few), U)
        for k in range(width - 1):
            has = counts[few] > k
            whole[has] += h[begin[few[has]] + k] * U(2 * k + 3)
        grams = np.concatenate((grams, mix(whole + counts[few].astype(U) + U(0xABCDEF))))
        owner = np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], grams[new]


def minima(owner: np.ndarray, grams: np.ndarray, n: int) -> np.ndarray:
    """The densified one-permutation minima, n x BINS; zeros for a text without shingles."""
    bins = ((grams >> U(40)) * U(BINS) >> U(24)).astype(np.int64)
    first = np.ones(len(grams), bool)
    first[1:] = (bins[1:] != bins[:-1]) | (owner[1:] != owner[:-1])
    out, full = np.zeros((n, BINS), U), np.zeros((n, BINS), bool)
    out[owner[first], bins[first]] = mix(grams[first])
    full[owner[first], bins[first]] = True
    some = full.any(axis=1)
    r, c = np.nonzero(~full & some[:, None])
    for tries in _TRIES:
        if not len(r):
            return out
        at = tries[c]
        ok = full[r, at]
        out[r[ok], c[ok]] = mix(out[r[ok], at[ok]] + U(1))
        r, c = r[~ok], c[~ok]
    for step in range(1, BINS):  # for the few bins that no draw has filled: the next full one
        at = (c + step) % BINS
        ok = full[r, at]
        out[r[ok], c[ok]] = mix(out[r[ok], at[ok]] + U(1))
        r, c = r[~ok], c[~ok]
        if not len(r):
            break
    return out


def features(texts: list[str | None], width: int) -> list:
    n = len(texts)
    owner, grams = shingle_sets(texts, width)
    counts = np.bincount(owner, minlength=n)
    digests = []
    for salt in (U(0x51ED270B), U(0x9F3779B9)):
        total = np.concatenate((np.zeros(1, U), np.cumsum(mix(grams + salt), dtype=U)))
        end = np.cumsum(counts)
        digests.append((total[end] - total[end - counts]).view(np.int64))
    low = minima(owner, grams, n)
    keys = (low.reshape(n, BANDS, ROWS) * _BAND_SALT).sum(axis=2, dtype=U)
    keys = mix(keys + np.arange(BANDS, dtype=U) * U(0x632BE59BD9B4E019)).view(np.int64)
    sketch = (low >> U(56)).astype(np.uint8)
    return [counts.astype(np.int64), digests[0], digests[1], pa.FixedSizeListArray.from_arrays(keys.ravel(), BANDS).cast(pa.list_(pa.int64())), [x.tobytes() for x in sketch]]


FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())]


def sets_of(texts: list[str | None], width: int) -> list:
    owner, grams = shingle_sets(texts, width)
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [[grams[i:j].tobytes() for i, j in zip(cut, cut[1:])]]


def map_columns(df: DataFrame, fn, schema: T.StructType) -> DataFrame:
    """``fn`` maps an Arrow batch to a list of arrays, in batches of bounded bytes."""

    def run(batches):
        for batch in batches:
            step = max(1, int(batch.num_rows * 4e6 / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                yield pa.RecordBatch.from_arrays(fn(batch.slice(i, step)), names=schema.names)
        given_back()

    return df.mapInArrow(run, schema)


PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose sketches don't speak against it, with the share that agrees."""
    sizes = nodes.select(F.col("rep"), F.col("n_shingles"), F.col("sketch"))
    joined = pairs.join(sizes.toDF("a", "na", "sa"), "a").join(sizes.toDF("b", "nb", "sb"), "b")
    joined = joined.where((F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent))
    schema = T.StructType([*PAIR.fields, T.StructField("share", T.DoubleType())])

    def score(batch):
        x = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sa", "sb")]
        share = (x[0] == x[1]).mean(axis=1)
        n = np.minimum(*(batch.column(c).to_numpy() for c in ("na", "nb")))
        keep = pa.array(share >= least_share(n, percent))
        return [batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share).filter(keep)]

    return map_columns(joined.select("a", "b", "na", "nb", "sa", "sb"), score, schema)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * |intersection| >= percent * |union| on full sets."""

    def exact(batch):
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
            x, y = np.frombuffer(x, U), np.frombuffer(y, U)
            both = np.intersect1d(x, y, assume_unique=True).size
            keep.append(100 * both >= percent * (x.size + y.size - both))
        keep = pa.array(keep, pa.bool_())
        return [batch.column("a").filter(keep), batch.column("b").filter(keep)]

    joined = pairs.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    return map_columns(joined.select("a", "b", "x", "y"), exact, PAIR)


def components(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """node -> least node of its component, for nodes that have an edge (large and small stars by turns)."""
    n, before = edges.count(), None
    edges = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0", n)
    for turn in range(1, 1000):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(least, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.table(small, f"{label}-{turn}", 2 * n)
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{label}-{turn - 1}")
        edges, n = small, now[0]
        if now == before:
            return edges.select(F.col("u").alias("rep"), F.col("v").alias("component"))
        before = now
    raise RuntimeError("components didn't settle")


def grown(comps: DataFrame, links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """Components with further links: the old ones go in as stars."""
    return components(links.select("a", "b").union(comps.select(F.col("rep").alias("a"), F.col("component").alias("b"))), scratch, label)


def opened(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """(id__, component) of the documents in buckets (key, rep) that hold more than one component."""
    rows = buckets.join(comps, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return rows.join(several, "key", "left_semi").select(F.col("rep").alias("id__"), "component").distinct()


def slots(grams: np.ndarray) -> np.ndarray:
    return (mix(grams) & U(SLOTS - 1)).astype(np.int64)


def frequencies(sets: DataFrame) -> np.ndarray:
    """How frequent the shingles of each hash slot are in all the sets: a byte, six steps for each doubling."""

    def count(batches):
        kept()
        total = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                np.add.at(total, slots(np.frombuffer(s, U)), 1)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 100_000):
            part = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], names=["slot", "n"])
        given_back()

    def level(table: pa.Table) -> pa.Table:
        own = np.zeros(STRIP, np.uint8)
        own[table.column("slot").to_numpy() % STRIP] = np.minimum(6 * np.log2(table.column("n").to_numpy()), 255).astype(np.uint8)
        return pa.table([table.column("strip")[:1], pa.array([own.tobytes()])], names=["strip", "levels"])

    found = sets.select("set").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where("n > 1")
    strips = found.select(F.floor(F.col("slot") / STRIP).alias("strip"), "slot", "n").groupBy("strip").applyInArrow(level, "strip long, levels binary")
    out = np.zeros(SLOTS, np.uint8)
    for strip, levels in strips.collect():  # the driver gets bytes, not counts: SLOTS in all
        out[strip * STRIP : (strip + 1) * STRIP] = np.frombuffer(levels, np.uint8)
    return out


FIRST = T.StructType([*(T.StructField(n, T.LongType()) for n in ("gram", "rep", "component", "n", "place")), T.StructField("short", T.BooleanType())])


def first_shingles(sets: DataFrame, order: np.ndarray, percent: int) -> DataFrame:
    """The first shingles of each set (id__, component, set), rare ones first, with their place.

    Of a pair with the similarity, the larger set has one of the smaller's first
    n - ceil(2t / (1 + t) n) + 1 (``short``) among its own first n - ceil(t n) + 1.
    """
    shared = sets.sparkSession.sparkContext.broadcast(order)

    def run(batch):
        own = [np.frombuffer(s, U) for s in batch.column("set").to_pylist()]
        n = np.array([len(x) for x in own], np.int64)
        grams, owner = np.concatenate(own), np.repeat(np.arange(len(own)), n)
        at = np.lexsort((grams, shared.value[slots(grams)], owner))  # owners are in order already
        place = np.arange(len(grams)) - np.repeat(np.cumsum(n) - n, n)
        most, short = n + (-percent * n // 100) + 1, n + (-2 * percent * n // (100 + percent)) + 1
        keep = place < most[owner]
        who, place = owner[keep], place[keep]
        ids, comps = (batch.column(c).to_numpy()[who] for c in ("id__", "component"))
        return [pa.array(x) for x in (grams[at][keep].view(np.int64), ids, comps, n[who], place, place < short[who])]

    return map_columns(sets.select("id__", "component", "set"), run, FIRST)


def residual(buckets: DataFrame, comps: DataFrame, sets: DataFrame, more: Callable[[DataFrame], DataFrame], scratch: Scratch, percent: int) -> DataFrame | None:
    """Links (a, b) between components, enough to join all that are linked, among documents of open buckets.

    ``sets`` has full sets, and ``more`` finds those of further ids. None if all buckets are closed.
    """
    docs = scratch.table(opened(buckets, comps), "open")
    if not (n := docs.count()):
        return None
    sets = sets.union(scratch.table(more(docs.join(sets, "id__", "left_anti").select("id__")), "sets-more", n, WIDE_ROWS // 4))
    sets = scratch.table(docs.join(sets, "id__"), "sets-open", n, WIDE_ROWS // 4)
    rows = scratch.table(first_shingles(sets, frequencies(sets), percent), "first")
    lists = rows.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if("short").alias("shorts"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")).where("lo <> hi and shorts > 0").select("gram", "size", "total")
    rows = scratch.table(rows.join(lists, "gram"), "lists", rows.count())
    return by_twos(rows.where(F.col("size") <= LIST), sets, percent).union(in_blocks(rows.where(F.col("size") > LIST), sets, percent))


def by_twos(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents that share a shingle of a short list, if sizes and places in the order allow them."""
    x, y = (rows.select("gram", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "component", "n", "place", "short"))) for k in "ab")
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("rep_a") < F.col("rep_b")))
    fits = F.col("short_a") & smaller & (F.col("component_a") != F.col("component_b")) & (F.col("n_a") * 100 >= F.col("n_b") * percent)
    # at the first shingle they share, what comes after it must suffice
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    pairs = x.join(y, "gram").where(fits & (rest * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent))
    return confirm(pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct(), sets.select("id__", "set"), percent)


def joining(sets: list[np.ndarray], comp: np.ndarray, percent: int, block: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of sets with the similarity that join different components; no more than one for each joint.

    With ``block``, only pairs of different blocks. Shingles are counted by an inverted list.
    """
    size = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    label = np.unique(comp, return_inverse=True)[1]
    largest = np.bincount(label).argmax()
    out = []
    for i in np.flatnonzero(label != largest):  # each pair has an end outside the largest component
        lo, hi = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        good = (100 * both >= percent * (size[i] + size - both)) & (label != label[i])
        if block is not None:
            good &= block != block[i]
        while len(found := np.flatnonzero(good)):
            j = found[0]
            out.append((i, j))
            label[label == label[j]] = label[i]
            good &= label != label[i]
    return out


def in_blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the documents of a long list: where they have too many shingles for one task, they are
    dealt in blocks, of which each meets itself and each other."""
    blocks = F.ceil(F.col("total") / BLOCK).cast("int")
    dealt = rows.select("gram", "rep", "component", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("gram", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "component")
    # a task of one component has nothing to join
    several = met.groupBy("gram", "lo", "hi").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("gram", "lo", "hi")
    met = met.join(several, ["gram", "lo", "hi"]).join(sets.select(F.col("id__").alias("rep"), "set"), "rep")

    def exact(table: pa.Table) -> pa.Table:
        rep, comp, block = (table.column(c).to_numpy() for c in ("rep", "component", "block"))
        two = table.column("lo")[0] != table.column("hi")[0]
        links = joining([np.frombuffer(s, U) for s in table.column("set").to_pylist()], comp, percent, block if two else None)
        a, b = (np.array([rep[p[k]] for p in links], np.int64) for k in (0, 1))
        return pa.table([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=PAIR.names)

    return met.groupBy("gram", "lo", "hi").applyInArrow(exact, PAIR)


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A text's set is its
    distinct ``width``-word shingles; shorter texts have their whole sequence as the one shingle;
    texts without a word (empty, null) have none and are linked with nothing. Texts are linked when
    100 * |intersection| >= ``percent`` * |union|; a component's id is its smallest document id.
    Repeated rows belong together; rows that share an id count as one document; a row with a null id
    belongs to the documents with the same set, and if all rows of that set have null ids, it is its
    own component, with a null id. An empty table gives an empty result.
    """
    rows = judged(docs, id_col, text_col, width, percent)
    return rows.select(F.col("id__").alias(id_col), "n_shingles", "component_id", "kept")


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart that may be dropped: the id, or without one the text's digest."""
    return F.coalesce(F.col(id_col).cast("long").cast("string"), F.sha2(F.col(text_col).cast("binary"), 256))


def judged(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Rows (id__, key__, n_shingles, component_id, kept); key__ is the row_key."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    # names of our own, so that no id column clashes with a field
    base = docs.select(F.col(id_col).cast("long").alias("id__"), F.col(text_col).alias("text__"))
    keyed = base.withColumn("key__", F.when(F.col("id__").isNull(), row_key("id__", "text__")))  # the others' key is their id
    feat = map_text(keyed, "text__", lambda t: features(t, width), FIELDS).drop("text__")
    feat = scratch.table(feat, "features")
    n = feat.count()

    # equal sets are one node, named by its smallest id; rows without an id don't name it
    named = F.min(F.when(F.col("id__").isNotNull(), F.struct("id__", "bands", "sketch"))).alias("x")
    groups = feat.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(named)
    groups = scratch.table(groups.select("set_a", "set_b", "n_shingles", F.col("x.id__").alias("rep"), "x.bands", "x.sketch"), "nodes", n, WIDE_ROWS)
    nodes = groups.where("rep is not null")
    keys = nodes.select("rep", F.posexplode("bands").alias("band", "key"))
    # a star's hub: the least id under a permutation of its band
    salted = keys.select("key", F.col("rep").bitwiseXOR(F.xxhash64("band")).alias("x"))
    hubs = salted.groupBy("key").agg(F.min("x").alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = scratch.table(keys.join(hubs, "key").select("key", "rep", F.col("x").bitwiseXOR(F.xxhash64("band")).alias("hub")), "buckets", BANDS * n)
    stars = buckets.where("rep <> hub").select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    stars = scratch.table(plausible(stars, nodes, percent), "stars", joined=True)
    ends = scratch.table(stars.select(F.col("a").alias("id__")).union(stars.select("b")).distinct(), "ends", n)
    sets = scratch.table(sets_for(base, ends, width), "sets", ends.count(), WIDE_ROWS // 4)

    # first each document's most similar hub; then what that leaves in different components
    best = stars.groupBy("b").agg(F.max(F.struct("share", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    comps = components(scratch.table(confirm(best, sets, percent), "links-0", joined=True), scratch, "cc0")
    found = scratch.table(confirm(apart(stars.select("a", "b"), comps), sets, percent), "links-1", joined=True)
    if not found.isEmpty():
        comps = grown(comps, found, scratch, "cc1")
    rest = residual(buckets.select("key", "rep"), comps, sets, lambda ids: sets_for(base, ids, width), scratch, percent)
    if rest is not None and not (found := scratch.table(rest, "links-2")).isEmpty():
        comps = grown(comps, found, scratch, "cc2")
    for done in ("buckets", "stars", "ends", "sets", "links-0", "links-1", "links-2", "open", "sets-more", "sets-open", "first", "lists"):
        scratch.drop(done)

    whole = groups.join(comps, "rep", "left").select("set_a", "set_b", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("component"))
    on = (feat.set_a == whole.set_a) & (feat.set_b == whole.set_b) & (feat.n_shingles == whole.n)
    out = feat.join(whole, on, "left").select(feat.id__, F.coalesce(feat.id__.cast("string"), feat.key__).alias("key__"), feat.n_shingles, F.coalesce(F.col("component"), feat.id__).alias("component_id"))
    return out.withColumn("kept", F.col("id__").eqNullSafe(F.col("component_id")))


def sets_for(base: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The full sets (sorted 64-bit hashes) of the given node ids, each once."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = base.join(ids, "id__", "left_semi")
    out = map_text(rows, "text__", lambda t: sets_of(t, width), [T.StructField("set", T.BinaryType())]).drop("text__")
    return out.where(F.length("set") > 0)


def apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    a, b = comps.toDF("a", "ca"), comps.toDF("b", "cb")
    both = pairs.join(a, "a", "left").join(b, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with the least id."""
    dropped = judged(docs, id_col, text_col, width, percent).where("not kept").select("key__").distinct()
    return docs.join(dropped, row_key(id_col, text_col) == dropped.key__, "left_anti").select(*docs.columns)


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
