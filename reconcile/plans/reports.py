"""Schemas of the report tables, and appending to them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The columns of the report tables.
SCHEMAS = {
    "analysis": (
        "run_id string, Database string, Schema string, `Table` string, DDL_Migration_Analysis string, "
        "`Remark-Unsupported Datatypes` string, `Remark-Unsupported Default Values` string, "
        "created_on timestamp, created_by string"
    ),
    "schema_report": (
        "run_id string, source_dbms string, target_dbms string, table_name string, result_status string, "
        "created_on timestamp, created_by string"
    ),
    "schema_mismatch": (
        "run_id string, Table_name string, column_name string, SQL_Datatype string, Snowflake_Datatype string, "
        "Final_Data_types string, COLUMN_COMPAR string, COLUMN_AND_LEN_COMPAR string, ORDINAL_COMPAR string, "
        "created_on timestamp, created_by string"
    ),
    "test_results": (
        "run_id string, case_no int, source_table_name string, target_table_name string, test_case string, "
        "source_table_result string, target_table_result string, status string, execution_start_time timestamp, "
        "execution_end_time timestamp"
    ),
    "test_result_rows": (
        "run_id string, case_no int, row_values string, source_copies bigint, target_copies bigint, "
        "created_on timestamp, created_by string"
    ),
    "data_report": (
        "run_id string, source_dbms string, target_dbms string, table_name string, result_status string, "
        "source_record_count bigint, target_record_count bigint, created_on timestamp, created_by string"
    ),
    "data_detail": (
        "run_id string, source_dbms string, target_dbms string, table_name string, column_name string, "
        "row_key string, status string, source_value string, target_value string, created_on timestamp, created_by string"
    ),
    "rejects": (
        "run_id string, error string, file string, category string, column_name string, row_number bigint, "
        "rejected_record string, row_start_line bigint, byte_offset bigint, character bigint, created_on timestamp, created_by string"
    ),
    "row_validation": (
        "run_id string, source_dbms string, target_dbms string, file string, status string, rows_parsed bigint, "
        "rows_loaded bigint, error_limit bigint, errors_seen bigint, first_error string, first_error_line bigint, "
        "first_error_character bigint, first_error_column_name string, created_on timestamp, created_by string"
    ),
    "audit": (
        "run_id string, event_seq bigint, source_dbms string, target_dbms string, database_name string, "
        "schema_name string, table_name string, status string, event_time timestamp, created_by string"
    ),
}


def append_report(
    rows: DataFrame,
    root: str,
    report: str,
    run_id: str,
    systems: tuple[str, str] = ("SQL_SERVER", "SNOWFLAKE"),
) -> None:
    """Append rows to a report table under ``root``, stamped with run, systems, time and user.

    Columns of the report that ``rows`` lacks are stamped or left NULL. Each append has a
    folder of its own, so that appends of many tables at once do not meet.
    """
    stamps = {
        "run_id": F.lit(run_id),
        "source_dbms": F.lit(systems[0]),
        "target_dbms": F.lit(systems[1]),
        "created_on": F.current_timestamp(),
        "created_by": F.current_user(),
    }
    have = set(rows.columns)
    columns = []
    for field in T.StructType.fromDDL(SCHEMAS[report]).fields:
        col = F.col(f"`{field.name}`") if field.name in have else stamps.get(field.name, F.lit(None))
        columns.append(col.cast(field.dataType).alias(field.name))
    rows.select(*columns).write.parquet(f"{root}/{report}/{uuid.uuid4().hex}")


def read_report(spark: SparkSession, root: str, report: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[report]).option("recursiveFileLookup", "true").parquet(f"{root}/{report}")
