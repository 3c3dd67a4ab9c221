"""Collocations by level-wise (Apriori) passes over the texts (operator 12).

Pass k counts the phrases of k words, and reads all texts for that. A phrase of k words is emitted only where
both phrases of k - 1 words in it are frequent. What is frequent goes to all executors as a bit table of hashes
of a fixed greatest size: it has no false negatives, so that a full one costs time, not results, as all counts
are of the words themselves and rare phrases fall out after the sum. A block of texts is counted at once, its
words numbered by a dictionary; what leaves a task is (group, phrase, count), summed before and after the shuffle.

The level tables then give the scores: each cut of a candidate looks up its two parts, and each longer phrase
tells its parts of two words and more how often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.llm.common import Scratch, blocks
from threadloom.llm.vectext import LOWER, PLACES, U, mix, powers

#: Characters of texts that are counted together.
BLOCK_CHARS = 2_000_000
#: The bit table has 2**28 bits (32 MB) at most: that is the bound of what is broadcast.
MAX_BITS = 28
#: Bits of the table that travel as one row.
PAGE_BITS = 1 << 16
#: Of each group so many parts are ranked by themselves before the whole is.
PARTS = 64

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
SEPARATOR = BREAK.copy()
SEPARATOR[[0x20, 0x09]] = True


def hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: equal strings have equal hashes, in whatever array."""
    offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    p, inverse = powers(len(data) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * p[: len(data)], dtype=U)))
    return mix((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]] + np.diff(offsets).astype(U))


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    return (h >> U(64 - bits)).astype(np.int64), (h & U((1 << bits) - 1)).astype(np.int64)


def held(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Whether the table may hold each hash."""
    a, b = bit_places(h, bits)
    return ((table[a >> 3] >> (a & 7).astype(np.uint8)) & (table[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)


class Counted:
    """The words of a block of texts: numbers of words (in a dictionary), of groups and of pieces."""

    def __init__(self, texts: list[str | None], groups: list[str]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        buf = LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
        space = SEPARATOR[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.concatenate((np.zeros(1, np.int32), np.cumsum(ends - starts, dtype=np.int32)))
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[~space]))).dictionary_encode()
        self.words = words.dictionary
        self.word = words.indices.to_numpy().astype(np.int64)
        self.piece = np.cumsum(BREAK[buf], dtype=np.int32)[starts]
        names = pa.array(groups, pa.string()).dictionary_encode()
        self.groups = names.dictionary
        bounds = np.cumsum([len(x) + 1 for x in raw])
        self.group = names.indices.to_numpy().astype(np.int64)[np.searchsorted(bounds, starts, "right")]

    def phrases(self, k: int, table: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of the first words of all phrases of k words whose parts may be frequent, and a number for each phrase and group."""
        size = max(1, len(self.words))
        at = np.arange(len(self.word))
        number = self.group * size + self.word
        if k == 1:
            return at, number
        h = mix(hashes(self.groups))[self.group]
        word = hashes(self.words)[self.word]
        for i in range(k - 1):  # the hash of the k - 1 words from each place on
            h = h[: len(h) - (i > 0)] + word[i:] * PLACES[i] if len(h) > (i > 0) else h[:0]
        whole = self.piece[: len(h)] == self.piece[k - 2 :]
        ok = whole.copy()
        ok[whole] = held(table, bits, mix(h[whole]))
        last = len(self.word) - k + 1
        if last <= 0:
            return at[:0], number[:0]
        at = np.flatnonzero(ok[:last] & ok[1 : last + 1] & (self.piece[:last] == self.piece[k - 1 :]))
        number = number[at]
        for i in range(1, k):
            if i > 1:  # small numbers again, so that they stay within 64 bits
                number = np.unique(number, return_inverse=True)[1]
            number = number * size + self.word[at + i]
        return at, number

    def spelt(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from these places on, words joined by one space."""
        offsets = np.frombuffer(self.words.buffers()[1], np.int32, len(self.words) + 1).astype(np.int64)
        data = np.frombuffer(self.words.buffers()[2] or b"", np.uint8)
        words = self.word[at[:, None] + np.arange(k)].ravel()
        n = offsets[words + 1] - offsets[words] + 1  # with a space behind each
        ends = np.cumsum(n)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
        place = np.arange(len(out)) - np.repeat(ends - n, n)
        inside = place < np.repeat(n - 1, n)
        out[inside] = data[(np.repeat(offsets[words], n) + place)[inside]]
        # the space behind the last word goes
        stop = ends[k - 1 :: k]
        stays = np.ones(len(out), bool)
        stays[stop - 1] = False
        bounds = np.concatenate((np.zeros(1, np.int64), stop - np.arange(1, len(stop) + 1))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(out[stays])))

    def counts(self, k: int, table: np.ndarray | None, bits: int) -> pa.RecordBatch:
        """(grp, phrase, f); for single words also (grp, null, all words)."""
        at, number = self.phrases(k, table, bits)
        _, first, f = np.unique(number, return_index=True, return_counts=True)
        at = at[first]
        names, phrases, f = self.group[at], self.spelt(at, k), f.astype(np.int64)
        if k == 1:
            n = np.bincount(self.group, minlength=len(self.groups)) if len(self.group) else np.zeros(len(self.groups), np.int64)
            names, f = np.concatenate((names, np.arange(len(n)))), np.concatenate((f, n.astype(np.int64)))
            phrases = pa.concat_arrays([phrases, pa.nulls(len(n), pa.string())])
        return pa.RecordBatch.from_arrays([self.groups.take(pa.array(names)), phrases, pa.array(f)], names=["grp", "phrase", "f"])


def level(texts: DataFrame, k: int, table=None, bits: int = 0) -> DataFrame:
    """(grp, phrase, f): how often each phrase of k words occurs in each group (and all words, for k = 1: phrase null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(table.value, np.uint8) if table is not None else None
        for batch in batches:
            groups, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in blocks(values, BLOCK_CHARS):
                yield Counted(values[i:j], groups[i:j]).counts(k, own, bits)

    counts = texts.mapInArrow(run, "grp string, phrase string, f long")
    return counts.groupBy("grp", "phrase").agg(F.sum("f").alias("f"))


def bit_table(frequent: DataFrame, count: int, max_bits: int) -> tuple[bytes, int]:
    """Bits of the hashes of all frequent phrases, and the number of bits as a power of two.

    Tasks make pages of the table, equal pages are joined by or; what comes to the driver is the table, which
    ``max_bits`` bounds, at about 16 bits a phrase below that.
    """
    bits = min(max_bits, max(16, (16 * count - 1).bit_length()))
    page = min(PAGE_BITS, 1 << bits)

    def places(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            words = [np.array(x.split(" "), object) for x in table.column("phrase").to_pylist()]
            if not words:
                continue
            groups = table.column("grp").combine_chunks()
            h = mix(hashes(groups.cast(pa.string())))
            k = len(words[0])
            for i in range(k):
                h = h + hashes(pa.array([w[i] for w in words], pa.string())) * PLACES[i]
            at = np.unique(np.concatenate(bit_places(mix(h), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(at // page), pa.array(at % page)], names=["page", "bit"])

    def pages(table: pa.Table) -> pa.Table:
        out = np.zeros(page, np.uint8)
        out[table.column("bit").to_numpy()] = 1
        return pa.table({"page": [table.column("page")[0].as_py()], "bits": [np.packbits(out, bitorder="little").tobytes()]}, schema=pa.schema([("page", pa.int64()), ("bits", pa.binary())]))

    made = frequent.select("grp", "phrase").mapInArrow(places, "page long, bit long").distinct().groupBy("page").applyInArrow(pages, "page long, bits binary")
    out = bytearray(1 << bits >> 3)
    for row in made.toLocalIterator():
        out[row.page * page >> 3 : (row.page + 1) * page >> 3] = row.bits
    return bytes(out), bits


def levels(docs: DataFrame, text_col: str, group_col: str, longest: int, least: int, scratch: Scratch, max_bits: int) -> list[DataFrame]:
    """Tables (grp, phrase, f) of the phrases of 1 to ``longest`` words that occur ``least`` times or more in a group."""
    texts = docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit("und")).alias("grp"), F.col(text_col).alias("text"))
    spark, out, table, bits = docs.sparkSession, [], None, 0
    for k in range(1, longest + 1):
        counted = level(texts, k, table, bits).where(F.col("phrase").isNull() | (F.col("f") >= least))
        out.append(scratch.table(counted, f"level-{k}"))
        if table is not None:
            table.unpersist()
        if k < longest:
            frequent = out[-1].where("phrase is not null")
            made, bits = bit_table(frequent, frequent.count(), max_bits)
            table = spark.sparkContext.broadcast(made)
    return out


def score() -> Column:
    """floor(2000000 a / (l + r)); in decimals, as the product may pass 64 bits."""
    return F.expr("(cast(a as decimal(28,0)) * 2000000) div (cast(l as decimal(28,0)) + cast(r as decimal(28,0)))")


def part(words: Column, start, length) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 4, least: int = 30, first: int = 2000, max_bits: int = MAX_BITS) -> DataFrame:
    """(group, rank, phrase, a, l, r, n, score): the ``first`` collocations of each group.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces, these at spaces and tabs into words. All
    numbers are of a group (null: ``und``, together with a group of that name): n words, a occurrences of a phrase of two
    to ``longest`` words (``least`` or more), l and r those of the parts of its lowest-scoring cut, where a cut scores
    floor(2000000 a / (l + r)) and ties go to the shorter first part. A phrase that lies inside a longer one with at
    least four fifths of its occurrences is dropped. Null and empty texts have no words; repeated rows count each time;
    an empty table gives an empty result; columns beside the two don't matter. Texts are read whole, once a level.

    The result depends on tables in the scratch folder.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    tables = levels(docs, text_col, group_col, longest, least, scratch, max_bits)
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    split = [t.where("phrase is not null").withColumn("w", F.split("phrase", " ")) for t in tables]
    every = split[0].unionByName(split[1])
    for t in split[2:]:
        every = every.unionByName(t)
    phrases = every.where(F.size("w") > 1).select("grp", "phrase", F.col("f").alias("a"), "w")
    # what a longer phrase says to its parts
    ranges = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: part(F.col("w"), i, k))))
    inside = phrases.where(F.size("w") > 2).select("grp", F.explode(F.array_distinct(ranges)).alias("phrase"), "a").groupBy("grp", "phrase").agg(F.max("a").alias("longer"))
    left = phrases.join(inside, ["grp", "phrase"], "left").where(F.col("longer").isNull() | (whole("longer") * 5 < whole("a") * 4)).drop("longer")
    left = scratch.table(left, "left")
    cuts = left.select("grp", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("grp", "phrase", "a", "k", part(F.col("w"), F.lit(1), F.col("k")).alias("head"), part(F.col("w"), F.col("k") + 1, F.size("w")).alias("rest"))
    counts = lambda name, f: every.select("grp", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(counts("head", "l"), ["grp", "head"]).join(counts("rest", "r"), ["grp", "rest"])
    lowest = cuts.withColumn("score", score()).groupBy("grp", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = lowest.select("grp", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    near = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("near", near).where(F.col("near") <= first)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    n = tables[0].where("phrase is null").select("grp", F.col("f").alias("n"))
    return rows.join(n, "grp").select(F.col("grp").alias(group_col), "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM i),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
b AS (SELECT lang, a, w, k, unnest(range(2, k)) AS m FROM s),
c AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS j FROM b),
x AS (SELECT lang, array_to_string(w[j:j + m - 1], ' ') AS phrase, max(a) AS longer FROM c GROUP BY ALL),
o AS (SELECT s.* FROM s LEFT JOIN x USING (lang, phrase) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT),
u AS (SELECT lang, phrase, k, a, w, unnest(range(1, k)) AS c FROM o),
v AS (
  SELECT u.lang, u.phrase, u.a, u.c, l.f AS l, r.f AS r, ((2000000 * u.a::HUGEINT) // (l.f + r.f))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.w[1:u.c], ' ')
  JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.w[u.c + 1:], ' ')),
z AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN n USING (lang)
WHERE rank <= 2000"""
