"""Move a table: audit, convert, load, and keep what does not fit."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reconcile.functions import quoted
from reconcile.operators.audit import IN_PROGRESS, audit_event
from reconcile.operators.convert import convert
from reconcile.operators.frames import condition_of
from reconcile.operators.typemap import column_types
from reconcile.plans.reports import append_report
from reconcile.session import temporary_scratch, write_through
from reconcile.sources.records import parse_records, read_lines, reject_records
from reconcile.sources.staged import (
    LOAD_FAILED,
    ROW,
    check_rows,
    good_rows,
    load_counters,
    reject_rows,
    with_status,
)


COUNTERS = ("rows_parsed", "rows_loaded", "errors_seen", "first_error_line", "_first")


@dataclass(frozen=True)
class Target:
    """Where a table goes: a path, a table of the session catalog, or another system.

    Another system is named by its Spark format and ``options``, such as ``jdbc`` with
    ``url`` and ``dbtable``.

    A catalog table may be bucketed by a key. Two sides that are bucketed alike are later
    compared without a shuffle. All rows of a key are one task's there, so a load checks how
    often its most frequent key comes, and refuses one of more than ``most_per_key`` rows.
    """

    database: str
    schema: str
    table: str
    path: str | None = None
    fmt: str = "parquet"
    options: Mapping[str, str] = field(default_factory=dict)
    bucket_by: tuple[str, ...] = ()
    buckets: int = 0
    most_per_key: int = 1_000_000

    @property
    def name(self) -> str:
        return f"{self.container}.{quoted(self.table)}"

    @property
    def container(self) -> str:
        """The database of the session catalog that the table is in."""
        return quoted(f"{self.database}_{self.schema}")


def load(rows: DataFrame, target: Target, mode: str = "overwrite") -> None:
    """Create the target from the rows' schema and write them; upper-case column names."""
    named = rows.toDF(*[c.upper() for c in rows.columns])
    writer = named.write.format(target.fmt).options(**target.options).mode(mode)
    if target.path or target.options:
        writer.save(target.path)
        return
    rows.sparkSession.sql(f"CREATE DATABASE IF NOT EXISTS {target.container}")
    if target.bucket_by:
        # One task per bucket, or every task would write a file for every bucket.
        keys = [c.upper() for c in target.bucket_by]
        most = named.groupBy(*map(quoted, keys)).count().agg(F.max("count")).first()[0] or 0
        if most > target.most_per_key:
            raise ValueError(f"{most} rows of {target.name} have one key, too many for a bucket: load it without")
        writer = named.repartition(target.buckets, *map(quoted, keys)).write.format(target.fmt).mode(mode)
        writer = writer.bucketBy(target.buckets, *keys)
    writer.saveAsTable(target.name)


def load_with_rejects(
    raw: DataFrame, types: Mapping[str, str], target: Target, reports: str, run_id: str
) -> str:
    """Load the rows that convert, report the others, and return the load status.

    The counters are observed while the rows are written, so the source is read once; it
    is read again only if there are rejects to report. The observed rows come straight
    from the scan in the writing stage, whose tasks count once each. Rows for a bucketed
    table are shuffled, where a task that is run again would count again, so they are
    counted in a job of their own.
    """
    return _load_checked(check_rows(raw, types), types, target, reports, run_id, lambda bad: reject_rows(bad, types))


def load_files(
    spark: SparkSession, path: str, types: Mapping[str, str], target: Target, reports: str, run_id: str,
    *, header: bool = True, multi_line: bool = False,
) -> str:
    """Load delimited files from elsewhere as ``load_with_rejects`` does; rejects have their places.

    The files hold the columns of ``types`` in that order. ``multi_line`` is for files with line
    breaks inside quotes; either way a file is the work of as many tasks as its size asks for.
    """
    lines = read_lines(spark, path)
    parsed = parse_records(lines, list(types), header=header, multi_line=multi_line)
    return _load_checked(
        check_rows(parsed, types), types, target, reports, run_id, lambda bad: reject_records(bad, lines, types)
    )


def _load_checked(
    checked: DataFrame, types: Mapping[str, str], target: Target, reports: str, run_id: str,
    rejects: Callable[[DataFrame], DataFrame],
) -> str:
    if target.bucket_by:
        load(good_rows(checked, types), target)
        seen = checked.agg(*load_counters()).first().asDict()
    else:
        observed = Observation("load")
        load(good_rows(checked.observe(observed, *load_counters()), types), target)
        seen = observed.get
    totals = checked.sparkSession.createDataFrame(
        [(target.table, *[seen[k] for k in COUNTERS])],
        "file string, rows_parsed bigint, rows_loaded bigint, errors_seen bigint, first_error_line bigint, _first int",
    )
    result = with_status(totals, types)
    append_report(result, reports, "row_validation", run_id)
    status = result.first()["status"]
    if seen["errors_seen"]:
        append_report(rejects(checked), reports, "rejects", run_id)
    return status


def migrate_table(
    spark: SparkSession,
    read: Callable[[], DataFrame],
    types: Mapping[str, str],
    target: Target,
    reports: str,
    run_id: str,
    source_types: Mapping[str, str] | None = None,
    staged: bool = False,
) -> str:
    """Move one table under audit. A failure ends as an audit event, not as an exception.

    ``read`` gives the source rows; they get a row id here unless they were staged.
    ``source_types`` are the declared types by column, by which rows are converted first.
    With ``staged`` the rows are written to scratch first. Do so for a source that gives
    its rows in another order each time, such as a database, so that the rejects, which
    need a second read, are those that were counted; it then is read only once.
    """
    table = (target.database, target.schema, target.table)
    _audit(spark, run_id, table, IN_PROGRESS, reports)
    try:
        with temporary_scratch(spark):
            raw = convert(read(), source_types or {})
            if ROW not in raw.columns:
                raw = raw.select(F.monotonically_increasing_id().alias(ROW), "*")
            if staged:
                raw = write_through(raw, "staged")
            status = load_with_rejects(raw, types, target, reports, run_id)
    except Exception as error:  # noqa: BLE001  whatever goes wrong is the table's last event
        status = f"Table not created due to {condition_of(error)}"
    _audit(spark, run_id, table, status, reports)
    return status


@dataclass(frozen=True)
class Job:
    """One table to move: how to read it, the types to load, where it goes, the declared types."""

    read: Callable[[], DataFrame]
    types: Mapping[str, str]
    target: Target
    source_types: Mapping[str, str] = field(default_factory=dict)
    staged: bool = False


def job_of(catalog: DataFrame, read: Callable[[], DataFrame], target: Target, staged: bool = False) -> Job:
    """The job that moves a table as the catalog declares it."""
    columns = column_types(catalog, target.database, target.schema, target.table)
    return Job(read, {c: t for c, _, t, _ in columns}, target, {c: s for c, s, _, _ in columns}, staged)


def migrate_scope(
    spark: SparkSession, jobs: Iterable[Job], reports: str, run_id: str, threads: int = 8
) -> dict[str, str]:
    """Move many tables, a few at a time; the status of each by table name."""

    def one(job: Job) -> tuple[str, str]:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", job.target.table)
        return job.target.table, migrate_table(
            spark, job.read, job.types, job.target, reports, run_id, job.source_types, job.staged
        )

    with ThreadPoolExecutor(max_workers=threads) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(one), list(jobs)))


def read_back(spark: SparkSession, target: Target, status: str) -> DataFrame | None:
    """The loaded table, or None if nothing was loaded."""
    if status == LOAD_FAILED or status.startswith("Table not created"):
        return None
    if target.path or target.options:
        return spark.read.format(target.fmt).options(**target.options).load(target.path)
    return spark.table(target.name)


def _audit(spark: SparkSession, run_id: str, table: tuple[str, str, str], status: str, reports: str) -> None:
    # The clock keeps events in order also when a run is repeated under its old id.
    append_report(audit_event(spark, run_id, time.time_ns(), table, status), reports, "audit", run_id)
