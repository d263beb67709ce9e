"""Send this package to the executors, for sessions whose workers cannot import it."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import reconcile
from reconcile.llm.batches import set_small_batches


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the session's Python files, once per Spark context.

    The archive is a file of the driver's, from which Spark serves it to the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_reconcile_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(reconcile.__file__))
    folder = tempfile.mkdtemp(prefix="reconcile-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "reconcile.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(at, name)
                archive.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    context._reconcile_shipped = True


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A function of a session whose tasks import this package, and get texts in small batches.

    The result may run long after the function is through, so the size of batches is set for the
    session. It is only ever made smaller.
    """

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship(spark)
        set_small_batches(spark)
        return query(spark, *args)

    return run
