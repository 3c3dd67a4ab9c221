"""Mixing sources to target weights by hash-threshold histograms (operator 4, native).

Every document has a fixed hash. A source takes each document ``copies`` or ``copies + 1`` times: one
more below the source's hash threshold. The threshold comes from nested histograms: sums of words by
source and hash bucket, a running sum over the buckets, then the same inside the boundary bucket only,
until the buckets are finer than documents. No step sorts documents, and all results depend on ids
and texts only, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from threadloom.llm.common import Scratch

#: Bits of the hash that each of the nested histograms resolves: 4,096 buckets a source and level.
LEVEL_BITS, LEVELS = 12, 4
HASH_BITS = LEVEL_BITS * LEVELS
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def place(id_col: str) -> Column:
    """The document's place in its source: 48 bits of the md5 of its id."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row for each source.

    Sources in code point order, null last, weigh ``weights`` by turns and share ``share`` times all
    sizes. A target stops at ``most`` times its source's size, and the excess is shared anew by weight.
    Sorted by size over weight, the sources that stop are a prefix, so that running sums give the
    final level in one pass. The table has a row a source, which one window orders.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % n + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    rows = rows.withColumn("stopped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("left"))
    # the first source whose cap is not below its share fixes the level of all from there on
    free = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))
    rows = rows.withColumn("final", F.min(free).over(everything).getField("level"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("w")))
    return rows.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """A narrow table (id, source, size, h) of all documents, and for each source its target,
    ``copies`` and the threshold below which a document is taken once more."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size"), place(id_col).alias("h"))
    narrow = scratch.table(narrow, "narrow")
    top = narrow.groupBy("source", F.shiftright("h", HASH_BITS - LEVEL_BITS).alias("bucket")).agg(F.sum("size").alias("size"))
    top = scratch.table(top, "level-1")
    goals = targets(top.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    goals = goals.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    goals = scratch.table(goals, "goals")
    edge = goals.select("source", "need", F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        if level > 1:
            shift = HASH_BITS - LEVEL_BITS * level
            inside = same_source(narrow, edge.select("source", "prefix")).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
            top = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
        steps = same_source(top.withColumn("upto", running), edge.select("source", "need"))
        # the bucket in which the running sum passes what is needed, and what is needed inside it
        over = F.when(F.col("upto") > F.col("need"), F.struct("bucket", "upto", "size"))
        found = steps.groupBy("source").agg(F.min(over).alias("x"), F.first("need").alias("need"), F.max("bucket").alias("last"))
        # a source with nothing inside its boundary bucket keeps the threshold it has
        held = edge.select(F.col("source").alias("__source"), F.col("prefix").alias("old"))
        found = held.join(found, found["source"].eqNullSafe(held["__source"]), "left")
        bucket = F.coalesce(F.col("x.bucket"), F.col("last") + 1, F.shiftleft("old", LEVEL_BITS))
        need = F.when(F.col("x").isNull(), F.lit(0.0)).otherwise(F.col("need") - (F.col("x.upto") - F.col("x.size")))
        size = F.coalesce(F.col("x.size"), F.lit(0))
        edge = scratch.table(found.select(F.col("__source").alias("source"), need.alias("need"), bucket.alias("prefix"), size.alias("size")), f"edge-{level}")
    # the boundary document itself is taken if that comes nearer to the target
    limit = F.col("prefix") + F.when((F.col("size") > 0) & (F.col("need") * 2 >= F.col("size")), F.lit(1)).otherwise(F.lit(0))
    cut = edge.select("source", limit.alias("below"))
    return narrow, same_source(goals, cut).select("source", "source_size", "target", "copies", "below")


def same_source(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on source, where null equals null."""
    b = b.withColumnRenamed("source", "__source")
    return a.join(b, a["source"].eqNullSafe(b["__source"])).drop("__source")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, copies, taken.

    Size is the number of words; null and empty texts have 0, and take 0. A null source is a source.
    Repeated rows are taken alike, as the choice depends on the id. An empty table gives an empty
    result. Extra columns don't matter.
    """
    narrow, cut = mix_plan(docs, id_col, text_col, source_col, weights, share, most)
    copies = F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    rows = same_source(narrow, cut).withColumn("copies", copies)
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, with all their columns."""
    _, cut = mix_plan(docs, id_col, text_col, source_col, **options)
    cut = cut.select(F.col("source").alias("__src"), F.col("copies").alias("__copies"), F.col("below").alias("__below"))
    times = F.col("__copies") + F.when(place(id_col) < F.col("__below"), 1).otherwise(0)
    rows = docs.join(cut, docs[source_col].cast("string").eqNullSafe(cut["__src"]))
    return rows.withColumn("__times", F.explode(F.array_repeat(F.lit(1), times))).select(*docs.columns)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of op4: the level by trying all numbers of stopped sources, the threshold by sorting."""
    return f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h
  FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 2.0 * source_size AS cap,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k,
         (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
           / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, k) FILTER (WHERE cap >= level * w) AS level FROM o),
g AS (
  SELECT o.source, source_size, least(cap, f.level * w)::DOUBLE AS target,
         CASE WHEN source_size > 0 THEN floor(least(cap, f.level * w) / source_size)::BIGINT ELSE 0 END AS copies
  FROM o, f),
r AS (
  SELECT d.*, g.source_size, g.target, g.copies, g.target - g.copies * g.source_size AS need,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (copies + CASE WHEN upto <= need OR (upto - tied <= need AND 2 * (need - (upto - tied)) >= tied) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""
