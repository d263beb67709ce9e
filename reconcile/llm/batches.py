"""How many rows Spark hands to Python at a time."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from reconcile.session import write_through

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Texts per batch: of 10,000, Spark's default, a batch of longer texts takes hundreds of MB.
TEXTS = 1_000


def set_small_batches(spark: SparkSession, rows: int = TEXTS) -> None:
    """From now on jobs of the session pass at most so many rows at once to Python."""
    before = int(spark.conf.get(_ROWS))
    spark.conf.set(_ROWS, str(min(rows, before) if before > 0 else rows))


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Within the block, jobs of the session pass at most so many rows at once to Python."""
    before = spark.conf.get(_ROWS)
    set_small_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(_ROWS, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` of texts, written to scratch in small batches and read back."""
    with small_batches(df.sparkSession):
        return write_through(df, label)
