"""Run SQL test cases on the source and on the target and compare the results."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from reconcile.functions import round_decimal
from reconcile.operators.frames import condition_of
from reconcile.operators.diff import SOURCE_COPIES, TARGET_COPIES, signed_rows, with_ordinals
from reconcile.plans.reports import append_report

PASS, FAIL, ERROR = "PASS", "FAIL", "ERROR"

RESULT_SCHEMA = (
    "case_no int, source_table_name string, target_table_name string, test_case string, "
    "source_table_result string, target_table_result string, status string, "
    "execution_start_time timestamp, execution_end_time timestamp"
)


@dataclass(frozen=True)
class TestCase:
    __test__ = False

    table: str
    sql: str
    ordered: bool = False


def read_cases(spark: SparkSession, path: str, tables: Iterable[str] = ()) -> list[TestCase]:
    """Cases of a CSV file with table, sql and, if wanted, ordered; of some tables or of all.

    The file is one that a person wrote, so its rows fit the driver.
    """
    rows = spark.read.options(header="true", multiLine="true", quote='"', escape='"').csv(path)
    flag = F.coalesce(F.col("ordered").try_cast("boolean"), F.lit(False)) if "ordered" in rows.columns else F.lit(False)
    wanted = list(tables)
    if wanted:
        rows = rows.filter(F.col("table").isin(*wanted))
    return [TestCase(r[0], r[1], r[2]) for r in rows.select("table", "sql", flag).collect()]


def session_with(
    spark: SparkSession, tables: Mapping[str, str | Callable[[SparkSession], DataFrame]]
) -> SparkSession:
    """A session that knows one side's tables by their plain names.

    A table is given as a Parquet path, or as a function that reads it in that session.
    """
    session = spark.newSession()
    for name, table in tables.items():
        frame = session.read.parquet(table) if isinstance(table, str) else table(session)
        frame.createOrReplaceTempView(name)
    return session


def run_test_cases(
    spark: SparkSession,
    cases: Iterable[TestCase],
    source: SparkSession,
    target: SparkSession,
    threads: int = 4,
    compare: Callable[[int, TestCase], tuple[str, str | None, str | None]] | None = None,
) -> DataFrame:
    """One report row per case. A case that cannot run is reported with status ERROR.

    Results are compared where they are, as distributed tables. A report row has the number
    of rows of either result; the rows themselves are in ``result_rows``. ``compare`` runs a case
    in another way and gives its status and what is said of either side.
    """
    compare = compare or (lambda number, case: _compare(case, source, target))

    def one(numbered: tuple[int, TestCase]) -> tuple:
        number, case = numbered
        started = dt.datetime.now(dt.timezone.utc)
        try:
            status, left, right = compare(number, case)
        except Exception as error:  # noqa: BLE001  whatever a case meets is its result
            status, left, right = ERROR, None, condition_of(error)
        ended = dt.datetime.now(dt.timezone.utc)
        return (number, case.table, case.table.upper(), case.sql, left, right, status, started, ended)

    numbered = list(enumerate(cases, start=1))
    with ThreadPoolExecutor(max_workers=threads) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(one), numbered))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def case_results(case: TestCase, source: SparkSession, target: SparkSession) -> DataFrame | None:
    """Every distinct result row with its copies on either side; None if the shapes differ."""
    sql = case.sql.replace("\r", "")
    if sql.strip().upper() == "ROW_COUNT":
        sql = f"SELECT count(*) FROM {case.table}"
    left, right = _positional(source.sql(sql)), _positional(target.sql(sql))
    if len(left.columns) != len(right.columns):
        return None
    if case.ordered:
        left, right = (with_ordinals(side, name="_at").select("_at", *side.columns) for side in (left, right))
    return signed_rows(left, right)


def _positional(result: DataFrame) -> DataFrame:
    renamed = result.toDF(*[f"c{i}" for i in range(len(result.columns))])
    return renamed.selectExpr(*[f"{round_decimal(f.name, f.dataType)} AS {f.name}" for f in renamed.schema.fields])


def _counts(source: str, target: str) -> list[Column]:
    return [
        F.coalesce(F.sum(source), F.lit(0)).alias("source"),
        F.coalesce(F.sum(target), F.lit(0)).alias("target"),
        F.count_if(F.col(source) != F.col(target)).alias("differing"),
    ]


def _verdict(source: int | None, target: int | None, differing: int | None) -> tuple[str, str | None, str | None]:
    if differing is None:
        return FAIL, "columns differ in number", "columns differ in number"
    return (FAIL if differing else PASS), f"{source} rows", f"{target} rows"


def _compare(case: TestCase, source: SparkSession, target: SparkSession) -> tuple[str, str | None, str | None]:
    rows = case_results(case, source, target)
    if rows is None:
        return _verdict(None, None, None)
    return _verdict(*rows.agg(*_counts(SOURCE_COPIES, TARGET_COPIES)).first())


def result_rows(number: int, case: TestCase, source: SparkSession, target: SparkSession) -> DataFrame | None:
    """All rows of both results of a case: ``case_no, row_values, source_copies, target_copies``.

    ``row_values`` is a JSON array of the row's values as text; results compared in order have
    the row's number first. None if the results differ in their number of columns.
    """
    rows = case_results(case, source, target)
    if rows is None:
        return None
    values = [f"CAST({c} AS string)" for c in rows.columns if c not in (SOURCE_COPIES, TARGET_COPIES)]
    return rows.selectExpr(
        f"{int(number)} AS case_no", f"to_json(array({', '.join(values)})) AS row_values",
        f"{SOURCE_COPIES} AS source_copies", f"{TARGET_COPIES} AS target_copies",
    )


def run_case_file(
    spark: SparkSession, path: str, source: SparkSession, target: SparkSession, reports: str, run_id: str,
    tables: Iterable[str] = (),
) -> None:
    """Run the cases of a file and append their verdicts and all result rows to the reports.

    Each case runs once: its rows are counted while they are written, and the verdict is that of
    the rows in the report. Raises an error, once all cases are through and reported, if the rows of
    a case with a verdict of PASS or FAIL could not be written; such a case was run again for it.
    """
    missing: dict[int, Exception] = {}

    def compare(number: int, case: TestCase) -> tuple[str, str | None, str | None]:
        try:
            rows = result_rows(number, case, source, target)
            if rows is None:
                return _verdict(None, None, None)
            seen = Observation()
            counts = _counts("source_copies", "target_copies")
            append_report(rows.observe(seen, *counts), reports, "test_result_rows", run_id)
            found = seen.get
            return _verdict(found["source"], found["target"], found["differing"])
        except Exception as error:  # noqa: BLE001  a case that cannot run at all fails here again
            verdict = _compare(case, source, target)
            missing[number] = error
            return verdict

    append_report(run_test_cases(spark, read_cases(spark, path, tables), source, target, compare=compare), reports, "test_results", run_id)
    if missing:
        names = ", ".join(map(str, sorted(missing)))
        raise RuntimeError(f"result rows are missing in the report, of cases {names}") from missing[min(missing)]
