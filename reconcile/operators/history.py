"""Row history with start, end and active flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.functions import quoted
from reconcile.operators.diff import aligned

START, END, ACTIVE = "START_TIME", "END_TIME", "ACTIVE"

# Fixed value: end of rows that are still open.
OPEN_END = "9999-12-31 00:00:00"

# Copies of one row that are written out together; the blocks of a row are spread over tasks.
COPIES_PER_BLOCK = 100_000


def history_start(snapshot: DataFrame, at: Column) -> DataFrame:
    """A new history: every row open from ``at``."""
    return snapshot.withColumns({START: at, END: _open_end(), ACTIVE: F.lit("Y")})


def history_apply(history: DataFrame, snapshot: DataFrame, at: Column) -> DataFrame:
    """Bring a history up to a new snapshot taken at ``at``.

    A changed row is closed in its old form and opened in its new one; deleted rows are
    closed and new rows opened. Rows are matched by their whole content, so no key is
    needed and repeated keys do no harm. Copies of one row open and close together: when
    their number changes, the old copies are closed and the new ones opened.
    """
    columns = [quoted(c) for c in history.columns if c not in (START, END, ACTIVE)]
    # A row without a flag is not open.
    is_open = F.col(ACTIVE).eqNullSafe("Y")
    # Closed rows never change, so they skip the shuffle.
    closed = history.filter(~is_open)
    still_open = history.filter(is_open)
    left, right = aligned(still_open, snapshot, exclude=(START, END, ACTIVE))
    stamp = history.schema[START].dataType.simpleString()
    old = still_open.selectExpr(*left, "1 AS _old", "0 AS _new", START)
    new = snapshot.selectExpr(*right, "0 AS _old", "1 AS _new", f"CAST(NULL AS {stamp}) AS {START}")
    versions = old.unionAll(new).groupBy(*columns).agg(
        F.sum("_old").alias("_old"), F.sum("_new").alias("_new"),
        F.min(START).alias(START), F.max(START).alias("_latest"),
    )
    start = F.when(F.col(START) == F.col("_latest"), F.col(START)).otherwise(
        F.raise_error(F.lit("open copies of one row must have one start time"))
    )
    kept = F.struct(F.col("_old").alias("copies"), start.alias(START), _open_end().alias(END), F.lit("Y").alias(ACTIVE))
    ended = F.struct(F.col("_old").alias("copies"), start.alias(START), at.alias(END), F.lit("N").alias(ACTIVE))
    opened = F.struct(F.col("_new").alias("copies"), at.alias(START), _open_end().alias(END), F.lit("Y").alias(ACTIVE))
    entries = (
        F.when(F.col("_old") == F.col("_new"), F.array(kept))
        .when(F.col("_new") == 0, F.array(ended))
        .when(F.col("_old") == 0, F.array(opened))
        .otherwise(F.array(ended, opened))
    )
    current = versions.select(*columns, F.inline(entries))
    return closed.unionByName(with_copies(current, "copies"))


def history_rebuild(snapshots: DataFrame, at: str, taken: DataFrame | None = None) -> DataFrame:
    """The history of many snapshots at once, as if they had been applied one after another.

    ``snapshots`` has the rows of all snapshots, with the time of each in the column ``at``. A
    snapshot without rows leaves none there: ``taken``, a frame of one column, has the times of
    all snapshots where some may be empty. Rows without a time are not of any snapshot.

    Copies of one row are counted per snapshot first, so a row that exists in very many copies is
    one row of counts. The counts of a row's content are gaps and islands: as long as it is in one
    snapshot after another, in as many copies, it is one version. What one task sees together is one
    row's counts, at most one a snapshot.
    """
    columns = [c for c in snapshots.columns if c.upper() != at.upper()]
    names = [quoted(c) for c in columns]
    stamp = F.col(quoted(at)).cast("timestamp_ntz").alias("_at")
    rows = snapshots.select(*names, stamp).dropna(subset=["_at"])
    counts = rows.groupBy(*names, "_at").agg(F.count(F.lit(1)).alias("_copies"))
    # One row a snapshot.
    times = (taken.select(F.col(quoted(taken.columns[0])).cast("timestamp_ntz").alias("_at")) if taken is not None else rows.select("_at"))
    order = Window.orderBy("_at")
    times = times.dropna().distinct().select("_at", F.lag("_at").over(order).alias("_last"), F.lead("_at").over(order).alias("_next"))
    counts = counts.join(times, "_at")

    of_row = Window.partitionBy(*names).orderBy("_at")
    goes_on = F.lag("_at").over(of_row).eqNullSafe(F.col("_last")) & (F.lag("_copies").over(of_row) == F.col("_copies"))
    begins = F.when(F.col("_last").isNotNull() & goes_on, 0).otherwise(1)
    islands = counts.withColumn("_begins", begins).withColumn("_island", F.sum("_begins").over(of_row))
    versions = islands.groupBy(*names, "_island").agg(
        F.first("_copies").alias("_copies"), F.min("_at").alias(START), F.max_by(F.struct("_next"), "_at")["_next"].alias("_until")
    )
    ended = F.col("_until").isNotNull()
    versions = versions.select(
        *names, START, F.coalesce("_until", _open_end()).alias(END), F.when(ended, "N").otherwise("Y").alias(ACTIVE), "_copies"
    )
    return with_copies(versions, "_copies")


def with_copies(df: DataFrame, copies: str) -> DataFrame:
    """Each row as often as ``copies`` says, however often that is.

    A row becomes one or more blocks of copies, which are dealt out before they are written
    out, so that a row of very many copies is the work of many tasks.
    """
    n = F.col(quoted(copies))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = F.sequence(F.lit(1).cast("bigint"), n, F.lit(COPIES_PER_BLOCK).cast("bigint"))
    blocks = df.select("*", F.explode(starts).alias("_from"))
    dealt = blocks.repartition(tasks, *map(quoted, df.columns), "_from")
    last = F.least(n, F.col("_from") + COPIES_PER_BLOCK - 1)
    return dealt.select("*", F.explode(F.sequence(F.col("_from"), last)).alias("_copy")).drop("_from", "_copy", copies)


def store_history(history: DataFrame, root: str) -> str:
    """Write the next version of a history beside the last one under ``root``; its folder.

    The version before stays readable while and after the new one is written, also by the job
    that writes it, and a write that fails leaves it the newest.
    """
    spark = history.sparkSession
    path = f"{root}/version={_newest(spark, root) + 1:08d}"
    history.write.parquet(path)
    return path


def read_history(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest version that was written in whole, or None if there is none."""
    newest = _newest(spark, root)
    return spark.read.parquet(f"{root}/version={newest:08d}") if newest else None


def _newest(spark: SparkSession, root: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return max((int(f.getPath().getParent().getName().partition("=")[2]) for f in found), default=0)


def _open_end() -> Column:
    return F.lit(OPEN_END).cast("timestamp_ntz")
