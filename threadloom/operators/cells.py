"""A vector index as tables: every vector is stored with its nearest centre; a search reads the cells that can matter.

The centres are k-means over a bounded sample, all rows are indexed. A cell keeps the angle to its farthest
member. By the triangle inequality of angles no member can be nearer to a query than that allows, so a search
without ``probes`` is exact: cells that can't hold one of the best are not read.

Vectors that come later are placed without a new fit (``append``): each goes to its nearest centre, whose reach widens;
a cell that has become too large is split, its members are written anew under the numbers of new cells, and the old
number leaves the list of centres, so that nobody reads the old copies (the next ``build`` drops them). Appended vectors
and the centres of the day are versioned tables below ``added``: a batch is there whole or not at all, and once.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.vectors import dot
from threadloom.operators.recall import vector_top
from threadloom.sources.snapshots import Snapshots

#: Most cells of an index; their centres are broadcast.
MOST_CELLS = 4096
#: A split looks at about so many members of its cell for each new cell, and makes at most so many new cells.
SPLIT_SAMPLE, MOST_PARTS = 500, 16
CENTRES = "cell int, centre array<double>, reach double, n bigint"


def build(rows: DataFrame, id_col: str, path: str, cells: int = 64, sample: int = 100_000, seed: int = 7) -> None:
    """Writes ``rows`` (with a column ``embedding``) by cell, and the centres with their reach.

    Null, empty and zero vectors have no direction and stay out. An empty table makes an empty index.
    """
    if not 2 <= cells <= MOST_CELLS:
        raise ValueError(f"cells must be 2 to {MOST_CELLS}")
    spark = rows.sparkSession
    unit = _directed(rows).withColumn("__v", array_to_vector("__u"))
    n = unit.count()
    _forget(spark, path, rows)
    if not n:
        spark.createDataFrame([], "cell int, centre array<double>, reach double").write.mode("overwrite").parquet(f"{path}/centres")
        rows.limit(0).withColumn("cell", F.lit(0)).write.mode("overwrite").parquet(f"{path}/vectors")
        return
    part = unit.sample(min(1.0, sample / n), seed) if n > sample else unit
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="__v", predictionCol="cell").fit(part.select("__v"))
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    length = [math.sqrt(sum(x * x for x in c)) or 1.0 for c in centres]
    table = spark.createDataFrame([(i, [x / k for x in c]) for i, (c, k) in enumerate(zip(centres, length))], "cell int, centre array<double>")
    placed = model.transform(unit).drop("__v")
    # a cell may hold a third of all rows: large ones are written by several tasks
    placed.drop("__u").hint("rebalance", F.col("cell")).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    near = placed.join(F.broadcast(table), "cell").groupBy("cell", "centre").agg(F.min(dot(F.col("__u"), F.col("centre"))).alias("least"))
    near.select("cell", "centre", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("least")))).alias("reach")).coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def _directed(rows: DataFrame) -> DataFrame:
    """The rows that have a direction, with it as ``__u``."""
    e = F.col("embedding")
    return rows.where(dot(e, e) > 0).withColumn("__u", F.transform(e, lambda x: x.cast("double") / F.sqrt(dot(e, e))))


def _added(spark: SparkSession, path: str) -> Snapshots:
    return Snapshots(spark, f"{path}/added")


def _forget(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """A new build begins without appended vectors, and batches count anew."""
    if _added(spark, path).versions():
        with _added(spark, path).begin() as change:
            change.replace("vectors", rows.limit(0).withColumn("cell", F.lit(0)))
            change.tables["centres"] = None
            change.mark("cells", -1)


def _centres(spark: SparkSession, path: str) -> list:
    """(cell, centre, reach, n) of all cells, at most MOST_CELLS rows; n is null before the first append."""
    store = _added(spark, path)
    if store.manifest()["tables"].get("centres"):
        return store.read("centres").collect()
    return spark.read.parquet(f"{path}/centres").select("cell", "centre", "reach", F.lit(None).cast("bigint").alias("n")).collect()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    built, store = spark.read.parquet(f"{path}/vectors"), _added(spark, path)
    return built.unionByName(store.read("vectors")) if store.versions() else built


def _nearest(spark: SparkSession, groups: dict[int, tuple[list[int], list]]):
    """A function (group, direction) -> the nearest of the group's cells; all centres together are at most MOST_CELLS."""
    sent = spark.sparkContext.broadcast({g: (np.array(cells), np.array(centres)) for g, (cells, centres) in groups.items()})

    @F.pandas_udf("int")
    def nearest(group: pd.Series, direction: pd.Series) -> pd.Series:
        own, out = group.to_numpy(), np.zeros(len(group), np.int32)
        for g in np.unique(own):
            cells, centres = sent.value[int(g)]
            at = np.flatnonzero(own == g)
            out[at] = cells[(np.stack(direction.iloc[at].to_numpy()) @ centres.T).argmax(axis=1)]
        return pd.Series(out)

    return nearest


def _reaches(rows: DataFrame, centres: dict[int, list]) -> dict[int, tuple[float, int]]:
    """(reach, number) of each cell that has some of these rows."""
    table = rows.sparkSession.createDataFrame(list(centres.items()), "cell int, centre array<double>")
    near = _directed(rows).join(F.broadcast(table), "cell").groupBy("cell").agg(F.min(dot(F.col("__u"), F.col("centre"))).alias("least"), F.count(F.lit(1)).alias("n"))
    return {r.cell: (math.acos(max(-1.0, min(1.0, r.least))), r.n) for r in near.collect()}  # a row a cell


def append(rows: DataFrame, path: str, batch: int, most_rows: int | None = None, cells: int = 64) -> bool:
    """Adds vectors to an index; false if this batch, or a later one, is there already.

    ``rows`` have the columns of the index. A cell of more than ``most_rows`` (four times the mean, and 1,000, by default) is
    split once an append; one of equal vectors can't be. An empty index is built from the first rows that come, with ``cells``.
    """
    spark, store = rows.sparkSession, _added(rows.sparkSession, path)
    change = store.begin()
    if change.is_applied("cells", batch):
        return False
    old = _centres(spark, path)
    if not old:
        build(rows, "", path, cells)
        with store.begin() as change:
            change.replace("vectors", rows.limit(0).withColumn("cell", F.lit(0)))
            change.tables["centres"] = None
            change.mark("cells", batch)
        return True
    if old[0].n is None:
        counts = {r["cell"]: r["count"] for r in spark.read.parquet(f"{path}/vectors").groupBy("cell").count().collect()}  # a row a cell
    else:
        counts = {c.cell: c.n for c in old}
    centre, reach = {c.cell: list(c.centre) for c in old}, {c.cell: c.reach for c in old}
    with change:
        place = _nearest(spark, {0: (list(centre), list(centre.values()))})
        _put(change, _directed(rows).withColumn("cell", place(F.lit(0), F.col("__u"))).drop("__u"))
        for cell, (far, n) in _reaches(change.last("vectors"), centre).items():
            reach[cell], counts[cell] = max(reach[cell], far), counts[cell] + n
        most = most_rows or max(1000, 4 * sum(counts.values()) // len(counts))
        parts = _parts(counts, most)
        if parts:
            here = spark.read.parquet(f"{path}/vectors").unionByName(store._scan(change.tables["vectors"])).where(F.col("cell").isin(list(parts)))
            fitted, groups, after = _split(_directed(here), counts, parts), {}, max(centre) + 1
            for cell in sorted(fitted):
                groups[cell] = (list(range(after, after + len(fitted[cell]))), fitted[cell])
                after += len(fitted[cell])
            if groups:
                moved = _nearest(spark, groups)
                _put(change, _directed(here.where(F.col("cell").isin(list(groups)))).withColumn("cell", moved(F.col("cell"), F.col("__u"))).drop("__u"))
                born = {c: x for ids, xs in groups.values() for c, x in zip(ids, xs)}
                for cell in groups:
                    del centre[cell], reach[cell], counts[cell]
                for cell, (far, n) in _reaches(change.last("vectors"), born).items():
                    centre[cell], reach[cell], counts[cell] = born[cell], far, n
        change.replace("centres", spark.createDataFrame([(c, centre[c], reach[c], counts[c]) for c in sorted(centre)], CENTRES).coalesce(1))
        change.mark("cells", batch)
    return True


def _put(change, placed: DataFrame) -> None:
    """Sorted by cell, so that a search for some cells skips the other pages; a large cell is written by several tasks."""
    change.append("vectors", placed.hint("rebalance", F.col("cell")).sortWithinPartitions("cell"))


def _parts(counts: dict[int, int], most: int) -> dict[int, int]:
    """Into how many parts each overfull cell is split, the largest first while there is room for cells."""
    room, out = MOST_CELLS - len(counts), {}
    for cell in sorted((c for c in counts if counts[c] > most), key=lambda c: (-counts[c], c)):
        parts = min(-(-counts[cell] // most), MOST_PARTS, room + 1)
        if parts > 1:
            out[cell], room = parts, room - parts + 1
    return out


def _split(members: DataFrame, counts: dict[int, int], parts: dict[int, int]) -> dict[int, list]:
    """New centres of each cell by k-means over a sample of its members, all cells at once; cells of one direction are left out."""
    share = {c: min(1.0, SPLIT_SAMPLE * parts[c] / counts[c]) for c in parts}

    def fit(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.stack(rows["__u"].to_numpy()), axis=0)  # also makes the order of rows irrelevant
        chosen = [x[0]]
        while len(chosen) < min(parts[key[0]], len(x)):  # each next centre as far as can be from those there are
            chosen.append(x[(x @ np.array(chosen).T).max(axis=1).argmin()])
        centres = np.array(chosen)
        for _ in range(10):
            own = (x @ centres.T).argmax(axis=1)
            sums = np.array([x[own == i].sum(axis=0) if (own == i).any() else centres[i] for i in range(len(centres))])
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1.0), centres)
        return pd.DataFrame({"cell": key[0], "centre": list(centres)})

    found: dict[int, list] = {}
    sample = members.sampleBy("cell", share, 7).select("cell", "__u")
    for r in sample.groupBy("cell").applyInPandas(fit, "cell int, centre array<double>").collect():  # at most MOST_CELLS rows
        found.setdefault(r.cell, []).append(list(r.centre))
    return {c: x for c, x in found.items() if len(x) > 1}


def search(spark: SparkSession, path: str, query: list[float], k: int, id_col: str, probes: int | None = None) -> DataFrame:
    """The k most similar rows with ``score``, ties by id. With ``probes`` only so many cells are read, and some may be missed."""
    stored = _stored(spark, path)
    best = lambda cells: vector_top(stored.where(F.col("cell").isin(cells)), query, k, id_col).drop("cell")
    size = math.sqrt(sum(x * x for x in query))
    centres = _centres(spark, path)
    if not size or not centres:
        return best([])
    angle = {c.cell: math.acos(max(-1.0, min(1.0, sum(x * y for x, y in zip(query, c.centre)) / size))) for c in centres}
    order = sorted(angle, key=lambda c: (angle[c], c))
    first = order[: probes or max(1, len(order) // 16)]
    if probes:
        return best(first)
    found = best(first).select("score").collect()  # k rows
    limit = found[-1].score if len(found) == k else -1.0
    bound = {c.cell: math.cos(max(0.0, angle[c.cell] - c.reach)) for c in centres}
    return best(sorted({c for c in order if bound[c] >= limit - 1e-9} | set(first)))
