"""Tables that one query writes and reads again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a machine-local one only where the session names none, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        base = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: While a table is written, Arrow batches hold at most this many rows, as texts may be long.
BATCH_ROWS = 500


@contextmanager
def short_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read again, so that what comes after doesn't compute it anew."""
    path = place(df.sparkSession, label)
    with short_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
