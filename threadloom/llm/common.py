"""What the operators of this subpackage share: scratch tables, Arrow passes, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A pass over texts handles this many characters at once, so that numpy's temporaries stay bounded.
BLOCK_CHARS = 500_000
#: ... and this many texts: sketches and the like are made for all of them at once.
BLOCK_TEXTS = 4096
#: While scratch tables are written, Arrow batches hold at most this many rows, as texts may be long.
BATCH_ROWS = 1000
#: A scratch table of known size is written in one file for each so many rows, whatever the partitions.
FILE_ROWS = 200_000


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]):
    """The session's settings with these, restored at the end."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """A folder of written tables below ``spark.checkpoint.dir``, which driver and executors share.

    Lineage is cut by writing and rereading Parquet here. A machine-local folder is used only where
    the session names none, as in tests.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            import tempfile

            base = "file://" + tempfile.gettempdir() + "/checkpoints"
        self.spark, self.path = spark, f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS, joined: bool = False) -> DataFrame:
        """``df`` written and reread. ``rows`` is how many it has at most, where known: a table that is small
        for its partitions gets few files, and a large one as many as it has partitions. That narrows the last
        stage too; what is ``joined`` from larger tables keeps its tasks, and its rows are dealt anew afterwards."""
        if joined:
            df = df.hint("rebalance")
        elif rows is not None:
            df = df.coalesce(max(1, -(-rows // file_rows)))
        with settings(self.spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS)}):
            df.write.option("compression", "zstd").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def drop(self, name: str) -> None:
        """Removes a table that no later plan reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.at(name))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_kept: tuple = (None, None)


def given_back() -> None:
    """Freed memory goes back to the system: worker processes stay for later stages, beside those of other cores."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def kept(key: str | None = None, make: Callable = lambda: None):
    """A large thing that a worker process keeps from task to task: one at a time, so that a stage doesn't carry what an earlier one made."""
    global _kept
    if _kept[0] != key:
        _kept = (None, None)
        given_back()
        _kept = (key, make())
    return _kept[1]


def blocks(texts: list[str | None], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` characters, and of BLOCK_TEXTS rows at most; a longer text makes a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if (size and size + n > limit) or i - start >= BLOCK_TEXTS:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def map_text(docs: DataFrame, text_col: str, fn: Callable[[list], list], fields: list[T.StructField]) -> DataFrame:
    """``docs`` with new columns that ``fn`` makes from blocks of texts, in Arrow batches.

    ``fn`` gets a list of texts (None for null) and returns a list of arrays, one for each field.
    All columns of ``docs`` pass through; one that has the name of a new field is replaced.
    """
    names = [f.name for f in fields]
    passed = docs.drop(*[n for n in names if n != text_col])
    out = [c for c in passed.columns if c not in names]
    at = passed.columns.index(text_col)
    schema = T.StructType([*[passed.schema[c] for c in out], *fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kept()
        arrow = to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in blocks(texts):
                made = fn(texts[i:j])
                part = batch.slice(i, j - i)
                columns = [part.column(part.schema.get_field_index(c)) for c in out]
                columns += [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, arrow.field(n).type) for n, x in zip(names, made)]
                yield pa.RecordBatch.from_arrays(columns, names=[*out, *names])
        given_back()

    return passed.mapInArrow(run, schema)


def filter_text(docs: DataFrame, text_col: str, fn: Callable[[list], list]) -> DataFrame:
    """The rows of ``docs``, with all columns, for whose texts ``fn`` returns true."""
    at = docs.columns.index(text_col)

    def run(batches):
        kept()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, j in blocks(texts):
                yield batch.slice(i, j - i).filter(pa.array(fn(texts[i:j]), pa.bool_()))
        given_back()

    return docs.mapInArrow(run, docs.schema)


def crc_mod(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n
