"""Session helper and the scratch area shared by all executors."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Bytes that one shuffle partition should hold, so that it fits well into a task's memory.
PARTITION_BYTES = 256 * 1024 * 1024

# A shuffle has as many blocks as map tasks times partitions. Beyond this many of either,
# larger tasks that spill are cheaper than ever smaller blocks: from about 6.4 TB a side on a
# partition holds more than PARTITION_BYTES, at 100 TB 4 GB. Executors with less memory or
# slower disks do better with more tasks; ``build_session`` takes the number.
MOST_TASKS = 50_000


def build_session(
    app: str = "reconcile",
    master: str | None = None,
    data_bytes: int | None = None,
    most_tasks: int = MOST_TASKS,
    **conf: str,
) -> SparkSession:
    """Session with the settings the jobs rely on; settings given in ``conf`` win.

    ``data_bytes`` is the size of the larger side of what is compared. It sizes the
    shuffle: adaptive execution joins partitions that turn out small but splits none
    of an aggregation, so there have to be enough of them from the start. ``most_tasks`` bounds
    their number.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.scheduler.mode": "FAIR",
    }
    if data_bytes:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions(data_bytes, most_tasks))
        settings["spark.sql.files.maxPartitionBytes"] = str(split_bytes(data_bytes, most_tasks))
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_partitions(data_bytes: int, most_tasks: int = MOST_TASKS) -> int:
    """Partitions for a comparison that shuffles both sides of ``data_bytes`` each."""
    return min(most_tasks, max(200, -(-2 * data_bytes // PARTITION_BYTES)))


def split_bytes(data_bytes: int, most_tasks: int = MOST_TASKS) -> int:
    """Bytes that one scan task reads, from Spark's default up to 1 GiB."""
    return min(2**30, max(2**27, 2 * data_bytes // most_tasks))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``.

    A cluster must name that folder, since every executor has to reach it. Only a
    local session, as in tests, may fall back to a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the executors")
        root = tempfile.mkdtemp(prefix="reconcile-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = os.path.join(_own_folder(spark, root), f"{label}-{uuid.uuid4().hex}")
    for paths in getattr(_open, "scopes", []):
        paths.append(path)
    return path


_open = threading.local()


@contextmanager
def temporary_scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread writes to scratch within the block is deleted when the block ends.

    Frames that were made there must not be read afterwards.
    """
    paths: list[str] = []
    _open.scopes = [*getattr(_open, "scopes", []), paths]
    try:
        yield
    finally:
        _open.scopes = _open.scopes[:-1]
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _own_folder(spark: SparkSession, root: str) -> str:
    return os.path.join(root, f"reconcile-{spark.sparkContext.applicationId}")


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to scratch. Frames read from there end with it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        _delete(spark, _own_folder(spark, root))


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to scratch and read it back.

    Later jobs then start from files that outlive any executor, and they see the same
    rows in the same partitions however often they run.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
