"""Compare the expected columns of tables with the columns the target has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.operators.catalog import TABLE

VALID, NOT_VALID = "valid", "Not-valid"


def compare_schema(expected: DataFrame, actual: DataFrame, type_column: str = "rendered_type") -> DataFrame:
    """One row per column of either side, matched by name in any case.

    ``expected`` has the table columns, ordinal, column, data_type and the expected type:
    ``rendered_type``, or ``spark_type`` for a target that Spark describes. ``actual``
    has the table columns, ordinal, column and type. A column that moved is
    reported by ``ORDINAL_COMPAR`` and does not shift the columns after it. Names that a side
    has more than once, in different cases, are reported as one that does not match.
    """
    name = F.upper("column").alias("_name")
    # Targets often spell all names in upper case, so tables too are matched in any case.
    table = F.upper(F.concat_ws(".", *TABLE)).alias("_table")
    left = expected.select(
        table, F.concat_ws(".", *TABLE).alias("_as"), name, F.struct("ordinal", "data_type", F.col(type_column).alias("type")).alias("_expected")
    )
    right = actual.select(table, F.concat_ws(".", *TABLE).alias("_as_there"), name, F.struct("ordinal", "type").alias("_actual"))
    # Grouping instead of joining: names that are alike but for case are not paired up.
    both = left.unionByName(right, allowMissingColumns=True).groupBy("_table", "_name").agg(
        F.min("_expected").alias("_expected"),
        F.min("_actual").alias("_actual"),
        F.count("_expected").alias("_left"),
        F.count("_actual").alias("_right"),
        F.min("_as").alias("_as"),
        F.min("_as_there").alias("_as_there"),
    )
    # One spelling for all columns of a table: the expected one, where there is any.
    named = both.groupBy("_table").agg(F.coalesce(F.min("_as"), F.min("_as_there")).alias("_shown"))
    both = both.join(named, "_table")

    def flag(condition):
        return F.when(condition, "True").otherwise("False")

    return both.select(
        F.col("_shown").alias("Table_name"),
        F.col("_name").alias("column_name"),
        F.col("_expected.data_type").alias("SQL_Datatype"),
        F.col("_actual.type").alias("Snowflake_Datatype"),
        F.col("_expected.type").alias("Final_Data_types"),
        flag((F.col("_left") == 1) & (F.col("_right") == 1)).alias("COLUMN_COMPAR"),
        flag(F.col("_expected.type") == F.col("_actual.type")).alias("COLUMN_AND_LEN_COMPAR"),
        flag(F.col("_expected.ordinal") == F.col("_actual.ordinal")).alias("ORDINAL_COMPAR"),
    )


def schema_mismatches(comparison: DataFrame) -> DataFrame:
    return comparison.filter((F.col("COLUMN_COMPAR") == "False") | (F.col("COLUMN_AND_LEN_COMPAR") == "False"))


def schema_verdicts(comparison: DataFrame) -> DataFrame:
    """One status per table: valid when every column is there with its type."""
    good = (F.col("COLUMN_COMPAR") == "True") & (F.col("COLUMN_AND_LEN_COMPAR") == "True")
    return comparison.groupBy("Table_name").agg(
        F.when(F.bool_and(good), VALID).otherwise(NOT_VALID).alias("result_status"),
        F.count(F.lit(1)).alias("columns_compared"),
        F.count_if(~good).alias("columns_differing"),
    )
