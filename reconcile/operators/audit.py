"""Append-only audit events, and the current state they add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IN_PROGRESS = "IN PROGRESS"
AUDIT_KEY = ("run_id", "database_name", "schema_name", "table_name")
AUDIT_SCHEMA = (
    "run_id string, event_seq bigint, source_dbms string, target_dbms string, database_name string, "
    "schema_name string, table_name string, status string"
)


def audit_event(
    spark: SparkSession,
    run_id: str,
    event_seq: int,
    table: tuple[str, str, str],
    status: str,
    systems: tuple[str, str] = ("SQL_SERVER", "SNOWFLAKE"),
) -> DataFrame:
    """One event row, stamped with time and user."""
    row = spark.createDataFrame([(run_id, event_seq, *systems, *table, status)], AUDIT_SCHEMA)
    return row.withColumn("event_time", F.current_timestamp()).withColumn("created_by", F.current_user())


def audit_latest(events: DataFrame) -> DataFrame:
    """Current status per run and table, with the times of its first and last event.

    Events are combined in each task before the shuffle, so a long run is no burden.
    """
    last = F.max_by(F.struct("source_dbms", "target_dbms", "status", F.col("created_by").alias("updated_by")), "event_seq")
    state = events.groupBy(*AUDIT_KEY).agg(
        F.min("event_time").alias("start_time"),
        F.max("event_time").alias("_last_time"),
        F.min_by("created_by", "event_seq").alias("created_by"),
        last.alias("_last"),
    )
    running = F.col("_last.status") == IN_PROGRESS
    return state.select(
        *AUDIT_KEY,
        "_last.source_dbms",
        "_last.target_dbms",
        "_last.status",
        "start_time",
        F.when(~running, F.col("_last_time")).alias("end_time"),
        "created_by",
        "_last.updated_by",
    )
