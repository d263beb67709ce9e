"""Compare many table pairs and report on each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reconcile.operators.catalog import TABLE
from reconcile.operators.diff import (
    AMBIGUOUS,
    CHANGED,
    EXTRA,
    MISSING,
    cells_of,
    diff_keys,
    SOURCE_COPIES,
    TARGET_COPIES,
    differing_totals,
    key_text,
    normalize,
    signed_rows,
    with_ordinals,
)
from reconcile.operators.frames import union_all
from reconcile.operators.schema import compare_schema, schema_mismatches, schema_verdicts
from reconcile.operators.xml import with_valid_columns
from reconcile.plans.reports import append_report
from reconcile.session import temporary_scratch, write_through
from reconcile.sources.tables import counting_session

# Status words of the data report.
MATCHED, NOT_MATCHED = "Matched", "Not-Matched"
NO_TABLE, NO_DATA = "Table does not exist in snowflake", "Table has no data"
NO_SOURCE_DATA = "Error while fetching data from SQL server, validation failed"
NO_TARGET_DATA = "Error while fetching data from snowflake, validation failed"
NO_KEYS = "Error while fetching Primary keys, validation on first few column order"
NO_DETAIL = "Failed to enter in Error Summary table"
NO_SCHEMA = "Error while comparing Datatypes"
FAILED = "Data Comparison failed due to some error"


ROW_NUMBER = "row_number"


@dataclass(frozen=True)
class Pair:
    """A source table, its target (None if there is none), the key, and target types by column.

    ``order_by`` is a total order; with it rows are compared by position instead of by key.
    ``ties`` is false where no rows tie in it, which saves a write of each side. Of the columns in
    ``xml_columns`` those count as equal in which all documents of both sides are well-formed.
    """

    name: str
    source: DataFrame
    target: DataFrame | None
    keys: Sequence[str] = ()
    types: dict[str, str] | None = None
    exclude: Sequence[str] = ()
    order_by: Sequence[str] = ()
    ties: bool = True
    xml_columns: Sequence[str] = ()

    def sides(self) -> tuple[DataFrame, DataFrame]:
        """Both sides as they are compared."""
        source, target = normalize(self.source, self.types), normalize(self.target, self.types)
        if self.xml_columns:
            source, target = with_valid_columns(source, target, self.xml_columns)
        if self.order_by:
            return tuple(with_ordinals(side, self.order_by, ROW_NUMBER, self.ties) for side in (source, target))
        return source, target


def open_table(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The table, or None where it does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            return None
        raise


def row_counts(pairs: Iterable[Pair]) -> DataFrame:
    """Record counts of every pair in one job, with existence and empty status.

    Each pair is a row, also where pairs have one name.
    """

    def side(number: int, pair: Pair, rows: DataFrame, counted: str, other: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias(counted)).select(
            F.lit(number).alias("_pair"),
            F.lit(pair.name).alias("table_name"),
            counted,
            F.lit(None).cast("bigint").alias(other),
        )

    sides = []
    for i, pair in enumerate(pairs):
        sides.append(side(i, pair, pair.source, "source_record_count", "target_record_count"))
        if pair.target is not None:
            sides.append(side(i, pair, pair.target, "target_record_count", "source_record_count"))
    counts = union_all(sides).groupBy("_pair", "table_name").agg(
        F.sum("source_record_count").alias("source_record_count"),
        F.sum("target_record_count").alias("target_record_count"),
    )
    return _counted(counts)


def file_counts(spark: SparkSession, scope: Iterable[tuple[str, str, str]]) -> DataFrame:
    """The ``row_counts`` of Parquet tables given as name, source path and target path.

    The counts are those in the files' footers; no row is read.
    """
    session = counting_session(spark)
    pairs = [
        Pair(name, session.read.parquet(source), open_table(partial(session.read.parquet, target))) for name, source, target in scope
    ]
    return row_counts(pairs)


def _counted(counts: DataFrame) -> DataFrame:
    """Record counts with what they say; a count of NULL is that of a table that is not there."""
    source, target = F.col("source_record_count"), F.col("target_record_count")
    status = (
        F.when(target.isNull(), NO_TABLE)
        .when((target == 0) & (source > 0), NO_DATA)
        .when(source == target, MATCHED)
        .otherwise(NOT_MATCHED)
    )
    return counts.select(
        "table_name", "source_record_count", F.coalesce(target, F.lit(0)).alias("target_record_count"),
        status.alias("result_status"),
    )


def data_report(pair: Pair) -> DataFrame:
    """One row: the verdict on all rows of a pair, with both record counts.

    Counts and verdict come from one pass over both tables.
    """
    if pair.target is None:
        return row_counts([pair]).select(
            "table_name", "result_status", "source_record_count", "target_record_count",
            F.col("source_record_count").alias("missing_rows"), F.lit(0).cast("bigint").alias("extra_rows"),
        )
    totals = differing_totals(*pair.sides(), pair.exclude)
    equal = (F.col("missing_rows") == 0) & (F.col("extra_rows") == 0)
    status = (
        F.when((F.col("target_record_count") == 0) & (F.col("source_record_count") > 0), NO_DATA)
        .when(equal, MATCHED)
        .otherwise(NOT_MATCHED)
    )
    return totals.select(
        F.lit(pair.name).alias("table_name"), status.alias("result_status"),
        "source_record_count", "target_record_count", "missing_rows", "extra_rows",
    )


def reconcile(pairs: Iterable[Pair]) -> DataFrame:
    """The data report of all pairs as one frame. For long scopes use ``run_scope``."""
    return union_all([data_report(p) for p in pairs])


def differences(pair: Pair, surplus: DataFrame) -> DataFrame:
    """Every difference of a pair in the long form of the detail report.

    A differing cell has its column and both values. A key, or without keys a row, that is
    left over on one side or has no single partner has the numbers of rows left over.
    """
    # Columns go by their places here, as the data's own names may be those of the result.
    names = {f"c{i}": c for i, c in enumerate(surplus.columns[:-2])}
    wanted = {k.upper() for k in pair.keys}
    keys = [c for c, own in names.items() if own.upper() in wanted] or list(names)
    surplus = surplus.toDF(*names, *surplus.columns[-2:])
    name = F.lit(pair.name).alias("table_name")
    rows = diff_keys(surplus, keys, MISSING, EXTRA, AMBIGUOUS).select(
        name,
        F.lit(None).cast("string").alias("column_name"),
        key_text(keys).alias("row_key"),
        F.col("status"),
        F.col("missing_rows").cast("string").alias("source_value"),
        F.col("extra_rows").cast("string").alias("target_value"),
    )
    if len(keys) == len(surplus.columns) - 2:
        return rows
    cells = cells_of(surplus, keys, names).select(
        name, "column_name", key_text(keys).alias("row_key"), F.lit(CHANGED).alias("status"), "source_value", "target_value"
    )
    return rows.unionByName(cells)


@dataclass(frozen=True)
class Table:
    """One table of a scope: how to read both sides, and what the schema should be.

    ``expected`` are mapped catalog rows and ``actual`` the target's column rows of this table.
    """

    name: str
    read_source: Callable[[], DataFrame]
    read_target: Callable[[], DataFrame]
    keys: Sequence[str] = ()
    types: dict[str, str] | None = None
    exclude: Sequence[str] = ()
    order_by: Sequence[str] = ()
    ties: bool = True
    xml_columns: Sequence[str] = ()
    expected: DataFrame | None = None
    actual: DataFrame | None = None


def tables_of(
    scope: DataFrame,
    read_source: Callable[[str, str, str], DataFrame],
    read_target: Callable[[str, str, str], DataFrame],
    keys: DataFrame | None = None,
) -> list[Table]:
    """The tables of a scope list, with their keys as ``key_lists`` or ``key_columns`` gives them.

    The readers take database, schema and table. A scope has one row per table, as each is
    a job of its own, so it is collected. Keys as one text are taken apart at its commas; where
    that gives another number of columns than the key has, the arrays are needed.
    """
    rows = scope.select(*TABLE)
    listed = keys is not None and "key_list" in keys.columns
    if keys is not None:
        rows = rows.join(keys.select(*TABLE, *(["key_list"] if listed else ["key_size", "key_columns"])), list(TABLE), "left")
    tables = []
    for row in rows.orderBy(*TABLE).collect():
        name = tuple(row[:3])
        key: Sequence[str] = ()
        if listed:
            key = row["key_list"] or ()
        elif keys is not None and row["key_columns"]:
            key = [row["key_columns"]] if row["key_size"] == 1 else row["key_columns"].split(",")
            if len(key) != row["key_size"]:
                raise ValueError(f"the key of {'.'.join(name)} has a comma in a column's name: give the key as an array")
        tables.append(Table(".".join(name), partial(read_source, *name), partial(read_target, *name), key))
    return tables


def validate_table(spark: SparkSession, table: Table, reports: str, run_id: str) -> None:
    """Compare schema, counts and cells of one table and append what was found to the reports."""
    with temporary_scratch(spark):
        _validate_table(spark, table, reports, run_id)


def _validate_table(spark: SparkSession, table: Table, reports: str, run_id: str) -> None:

    def report(status: str, rows: DataFrame | None = None) -> None:
        if rows is None:
            rows = spark.createDataFrame([(table.name, status)], "table_name string, result_status string")
        append_report(rows, reports, "data_report", run_id)

    try:
        source = table.read_source()
    except Exception:  # noqa: BLE001  whatever a reader meets is a finding about its table
        return report(NO_SOURCE_DATA)
    try:
        target = open_table(table.read_target)
    except Exception:  # noqa: BLE001
        return report(NO_TARGET_DATA)
    keys = table.keys
    if not {k.upper() for k in keys} <= {c.upper() for c in source.columns}:
        # Without a usable key the rows are compared by their whole content.
        report(NO_KEYS)
        keys = ()
    if table.order_by:
        keys = (ROW_NUMBER,)
    pair = Pair(table.name, source, target, keys, table.types, table.exclude, table.order_by, table.ties, table.xml_columns)
    try:
        _validate_schema(spark, table, reports, run_id)
        if target is None:
            return report(NO_TABLE, row_counts([pair]))
        # The one job over all rows: it counts both sides while it writes the rows that differ,
        # from which verdict and details are read.
        seen = Observation()
        counted = signed_rows(*pair.sides(), pair.exclude).observe(
            seen, F.sum(SOURCE_COPIES).alias("source"), F.sum(TARGET_COPIES).alias("target")
        )
        surplus = write_through(counted.filter(F.col(SOURCE_COPIES) != F.col(TARGET_COPIES)), "surplus")
        report(MATCHED, _verdict(pair, surplus, seen.get))
    except Exception:  # noqa: BLE001
        return report(FAILED)
    try:
        append_report(differences(pair, surplus), reports, "data_detail", run_id)
    except Exception:  # noqa: BLE001
        report(NO_DETAIL)


def _verdict(pair: Pair, surplus: DataFrame, seen: dict[str, int]) -> DataFrame:
    """The data report of a pair whose differing rows and counts are known."""
    row = [(pair.name, seen["source"] or 0, seen["target"] or 0)]
    schema = "table_name string, source_record_count bigint, target_record_count bigint"
    counts = _counted(surplus.sparkSession.createDataFrame(row, schema))
    status = F.when(F.col("result_status") == NO_DATA, NO_DATA).otherwise(MATCHED if surplus.isEmpty() else NOT_MATCHED)
    return counts.withColumn("result_status", status)


def _validate_schema(spark: SparkSession, table: Table, reports: str, run_id: str) -> None:
    if table.expected is None or table.actual is None:
        return
    try:
        comparison = compare_schema(table.expected, table.actual)
        append_report(schema_mismatches(comparison), reports, "schema_mismatch", run_id)
        verdicts = schema_verdicts(comparison).withColumnRenamed("Table_name", "table_name")
    except Exception:  # noqa: BLE001
        verdicts = spark.createDataFrame([(table.name, NO_SCHEMA)], "table_name string, result_status string")
    append_report(verdicts, reports, "schema_report", run_id)


def run_scope(spark: SparkSession, tables: Iterable[Table], reports: str, run_id: str, threads: int = 8) -> None:
    """Validate many tables, a few at a time. One that fails is reported and the rest go on."""

    def one(table: Table) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", table.name)
        validate_table(spark, table, reports, run_id)

    with ThreadPoolExecutor(max_workers=threads) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), list(tables)))
