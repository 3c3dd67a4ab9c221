"""Chunks of conversations of any length, in parallel.

Where a chunk ends follows from where it begins: running sums of tokens and a search tell the next beginning. So a
conversation is cut into blocks of about so many chunks; each block tells, for the few rows at which a chunk may enter
it, where the chain of chunks leaves it and after how many. A walk over the blocks then finds the real entries, and
each block numbers its own rows. The running sums are made part by part, and put together from the parts' totals.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadloom.sources.scratch import saved

#: A block has the tokens of so many chunks; the walk over blocks sees about one row in so many.
BLOCK_CHUNKS = 64


def placed(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Rows with ``pos``, ``before`` (tokens of the rows before), and the tokens of their neighbours ``prev`` and ``next``."""
    order = ["seq", "id"]
    narrow = rows.select("conversation_id", "id", "seq", F.coalesce("token_count", F.lit(0)).cast("long").alias("t"))
    # written, so that the parts are the same whenever they are read
    parts = keep(narrow.repartitionByRange("conversation_id", *order).sortWithinPartitions("conversation_id", *order).withColumn("part", F.spark_partition_id()), "chunk-rows")
    key = F.struct(*order)
    sums = parts.groupBy("conversation_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("s"), F.min_by("t", key).alias("first"), F.max_by("t", key).alias("last"))
    by_part = Window.partitionBy("conversation_id").orderBy("part")  # a row a part
    so_far = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("conversation_id", "part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(so_far), F.lit(0)).alias("s0"), F.lag("last").over(by_part).alias("p0"), F.lead("first").over(by_part).alias("f1"))
    w = Window.partitionBy("conversation_id", "part").orderBy(*order)
    own = parts.select("*", (F.row_number().over(w) - 1).alias("k"), (F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("t")).alias("b"), F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("f"))
    return own.join(offsets, ["conversation_id", "part"]).select("conversation_id", "id", "seq", "t", (F.col("k") + F.col("n0")).alias("pos"), (F.col("b") + F.col("s0")).alias("before"), F.coalesce("p", "p0").alias("prev"), F.coalesce("f", "f1").alias("next"))


def beginnings(pos, before, t, following, limit: int, min_fanout: int) -> np.ndarray:
    """For each row, where the chunk after one that begins there begins; -1 if the rows run out first.

    ``following`` holds the tokens of the next row, or NaN at the end of the conversation.
    """
    stop = np.searchsorted(before + t, before + limit, "right")
    found = stop < len(pos)
    at = np.minimum(stop, len(pos) - 1)
    joins = (t[at] > limit) & (pos[at] - pos < min_fanout)
    out = np.where(found, pos[at] + joins, -1)
    # a row over the limit ends its chunk with any other row, which joins if it is over the limit as well
    alone = np.where(np.isnan(following), -1, pos + 1 + ((following > limit) & (min_fanout > 1)))
    return np.where(t > limit, alone, out)


def chunks(rows: DataFrame, limit: int, min_fanout: int, keep: Callable[[DataFrame, str], DataFrame] = saved, block_chunks: int = BLOCK_CHUNKS) -> DataFrame:
    """(conversation_id, id, seq, chunk) of ``rows`` (conversation_id, id, seq, token_count), as ``folds.cut_chunks`` numbers them; rows that no chunk takes are left out.

    Null tokens count as none. Rows of one block meet in one task: those of ``block_chunks`` times ``limit`` tokens,
    however many blocks a conversation has.
    """
    span = limit * block_chunks
    own = placed(rows, keep).withColumn("block", F.floor(F.col("before") / span))
    own = keep(own, "chunk-blocks")
    # the first rows of a block are seen by the block before as well: its last chunks may end there
    ahead = own.where((F.col("block") > 0) & (F.col("before") - F.col("block") * span <= limit)).withColumn("block", F.col("block") - 1)
    seen = own.withColumn("own", F.lit(True)).unionByName(ahead.withColumn("own", F.lit(False)))

    def arrays(table: pa.Table):
        table = table.sort_by("pos")
        pos, before, t = (table.column(c).to_numpy() for c in ("pos", "before", "t"))
        following = table.column("next").cast(pa.float64()).to_numpy(zero_copy_only=False)
        mine = np.flatnonzero(table.column("own").to_numpy(zero_copy_only=False))
        return table, pos, t, mine, beginnings(pos, before, t, following, limit, min_fanout)

    def passage(table: pa.Table) -> pa.Table:
        """Of each possible entry: where the chain leaves the block, after how many chunks, and whether it ends open."""
        table, pos, t, mine, after = arrays(table)
        first, n = int(pos[mine[0]]) if len(mine) else 0, len(mine)
        leave, count, open_ = after[mine].tolist(), [1] * n, [False] * n
        for i in range(n - 1, -1, -1):
            to = leave[i]
            if to < 0:
                open_[i] = bool(t[mine[i]] <= limit)
            elif to - first < n:
                leave[i], count[i], open_[i] = leave[to - first], count[to - first] + 1, open_[to - first]
        block = table.column("block")[0].as_py() if len(table) else 0
        prev = table.column("prev").fill_null(-1).to_numpy()[mine]
        at = np.flatnonzero((table.column("before").to_numpy()[mine] - block * span <= limit) | (prev > limit))
        pick = lambda x: [x[i] for i in at]
        return pa.table({"conversation_id": [table.column("conversation_id")[0].as_py()] * len(at), "block": [block] * len(at), "entry": pos[mine][at].tolist(), "leave": pick(leave), "count": pick(count), "open": pick(open_)}, schema=pa.schema([("conversation_id", pa.int64()), ("block", pa.int64()), ("entry", pa.int64()), ("leave", pa.int64()), ("count", pa.int64()), ("open", pa.bool_())]))

    def walk(table: pa.Table) -> pa.Table:
        """The real entry of each block (null: the chunk from before fills it) and the number of the first chunk that begins there."""
        known = {r["entry"]: r for r in table.to_pylist()}
        begun, at, chunk, open_ = {}, 0, 0, False
        while at in known:
            r = known[at]
            begun[r["block"]] = (at, chunk)
            chunk, at, open_ = chunk + r["count"], r["leave"], r["open"]
        blocks, out, upto = sorted({r["block"] for r in known.values()}), [], 0
        for b, later in zip(blocks, [*blocks[1:], None]):
            entry, upto = begun.get(b, (None, None))[0], begun[b][1] if b in begun else upto
            out.append((b, entry, upto))
            if b in begun:
                upto += known[entry]["count"]
        who = [table.column("conversation_id")[0].as_py()] * len(out)
        return pa.table({"conversation_id": who, "block": [x[0] for x in out], "entry": [x[1] for x in out], "first": [x[2] for x in out], "open_chunk": [chunk - 1 if open_ else -1] * len(out)}, schema=pa.schema([(c, pa.int64()) for c in ("conversation_id", "block", "entry", "first", "open_chunk")]))

    def number(table: pa.Table) -> pa.Table:
        table, pos, t, mine, after = arrays(table)
        first = table.column("first")[0].as_py()
        chunk = np.full(len(mine), first - 1, np.int64)
        entry = table.column("entry")[0].as_py()
        base, n = int(pos[mine[0]]) if len(mine) else 0, len(mine)
        at = n if entry is None else entry - base
        while 0 <= at < n:
            to = int(after[mine[at]])
            end = n if to < 0 else min(n, to - base)
            chunk[at:end] = first
            first, at = first + 1, end if to >= 0 else n
        out = table.take(pa.array(mine))
        return out.select(["conversation_id", "id", "seq", "open_chunk"]).append_column("chunk", pa.array(chunk))

    entries = seen.groupBy("conversation_id", "block").applyInArrow(passage, "conversation_id long, block long, entry long, leave long, count long, open boolean")
    starts = keep(entries.groupBy("conversation_id").applyInArrow(walk, "conversation_id long, block long, entry long, first long, open_chunk long"), "chunk-entries")
    made = seen.join(starts, ["conversation_id", "block"]).groupBy("conversation_id", "block").applyInArrow(number, "conversation_id long, id long, seq long, open_chunk long, chunk long")
    made = keep(made, "chunk-numbers")
    # a last chunk that the rows ran out of needs the least number of rows
    last = F.col("chunk") == F.col("open_chunk")
    short = made.where(last).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < min_fanout).select("conversation_id", F.lit(True).alias("short"))
    return made.join(short, "conversation_id", "left").where(~last | F.col("short").isNull()).select("conversation_id", "id", "seq", "chunk")
