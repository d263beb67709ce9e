"""Column and key catalogs, and what the data says about them."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcile.functions import literal, null_tokens, quoted
from reconcile.operators.frames import union_all

TABLE = ("database", "schema", "table")


def catalog_rows(information_schema: DataFrame) -> DataFrame:
    """Catalog rows from an ``INFORMATION_SCHEMA.COLUMNS`` scan.

    Length is the first of character length, numeric precision and time precision.
    """
    return information_schema.select(
        F.col("TABLE_CATALOG").alias("database"),
        F.col("TABLE_SCHEMA").alias("schema"),
        F.col("TABLE_NAME").alias("table"),
        F.col("ORDINAL_POSITION").cast("int").alias("ordinal"),
        F.col("COLUMN_NAME").alias("column"),
        F.col("DATA_TYPE").alias("data_type"),
        F.coalesce("CHARACTER_MAXIMUM_LENGTH", "NUMERIC_PRECISION", "DATETIME_PRECISION").cast("int").alias("length"),
        F.when(F.upper("IS_NULLABLE") == "NO", "NOT NULL").otherwise("NULL").alias("is_nullable"),
        F.col("COLUMN_DEFAULT").alias("default"),
        F.col("NUMERIC_SCALE").cast("int").alias("scale"),
    )


def usage_rows(key_usage: DataFrame) -> DataFrame:
    """Key columns from a scan of the constraint views, for ``key_columns``."""
    return key_usage.select(
        F.col("CONSTRAINT_NAME").alias("constraint_name"),
        F.col("TABLE_CATALOG").alias("database"),
        F.col("TABLE_SCHEMA").alias("schema"),
        F.col("TABLE_NAME").alias("table"),
        F.col("COLUMN_NAME").alias("column"),
        F.col("ORDINAL_POSITION").cast("int").alias("ordinal"),
    )


def constraint_rows(constraints: DataFrame) -> DataFrame:
    """Constraints from a scan of the constraint view, for ``key_columns``."""
    return constraints.select(
        F.col("CONSTRAINT_NAME").alias("constraint_name"),
        F.col("TABLE_CATALOG").alias("database"),
        F.col("TABLE_SCHEMA").alias("schema"),
        F.col("TABLE_NAME").alias("table"),
        F.col("CONSTRAINT_TYPE").alias("constraint_type"),
    )


def describe(df: DataFrame, database: str, schema: str, table: str) -> DataFrame:
    """The columns of a frame as rows (database, schema, table, ordinal, column, type)."""
    rows = [
        (database, schema, table, i, f.name, f.dataType.simpleString())
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "database string, schema string, table string, ordinal int, column string, type string"
    )


# Columns that are aggregated together; beyond some dozens, code generation gives up. A columnar
# source reads each column once all the same. One that is not, such as CSV or a database, is read
# once for every so many columns: stage a wide one first.
COLUMNS_PER_PASS = 50


def profile_columns(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Rows, nulls, longest text, smallest and largest value of every column.

    A wide table is profiled some columns at a time; each pass reads only its columns.
    With the catalog rows of the table, what they declare is added to each column.
    """
    fields = list(enumerate(df.schema.fields, start=1))
    passes = [fields[i : i + COLUMNS_PER_PASS] for i in range(0, len(fields), COLUMNS_PER_PASS)]
    profile = union_all([_profile(df, columns) for columns in passes])
    if catalog is None:
        return profile
    declared = catalog.select(
        F.upper("column").alias("_name"),
        F.col("data_type").alias("declared_type"),
        F.col("length").alias("declared_length"),
        "is_nullable",
    )
    return profile.join(declared, F.upper("column_name") == F.col("_name"), "left").drop("_name")


def _profile(df: DataFrame, columns: list[tuple[int, T.StructField]]) -> DataFrame:
    measures, structs = ["count(1) AS _rows"], []
    for i, field in columns:
        value = quoted(field.name)
        if isinstance(field.dataType, T.StringType):
            value = null_tokens(value)
        measures += [
            f"count({value}) AS _n{i}",
            f"max(length(CAST({value} AS string))) AS _l{i}",
            f"min({value}) AS _a{i}",
            f"max({value}) AS _z{i}",
        ]
        structs.append(
            f"named_struct('ordinal', {i}, 'column_name', {literal(field.name)}, "
            f"'data_type', {literal(field.dataType.simpleString())}, 'row_count', _rows, 'null_count', _rows - _n{i}, "
            f"'max_length', _l{i}, 'min_value', CAST(_a{i} AS string), 'max_value', CAST(_z{i} AS string))"
        )
    return df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(structs)}))")


def key_lists(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """Primary-key columns per table, one row each, as an array ``key_list`` in the key's order.

    ``constraints`` has constraint_name, database, schema, table and constraint_type,
    ``usage`` has constraint_name, database, schema, table, column and ordinal. A key is known
    by its type. Where a table has none of that type, its first constraint by a name that
    starts with ``pk`` in any case is taken. The array gathers the columns of one key, whose
    number the source system limits.
    """
    by_type = F.col("constraint_type") == "PRIMARY KEY"
    keys = constraints.filter(by_type | (F.col("constraint_name").ilike("pk%") & (F.col("constraint_type") != "FOREIGN KEY")))
    # One constraint a table: false comes before true, and names in order.
    chosen = keys.groupBy(*TABLE).agg(F.min(F.struct(~by_type, "constraint_name")).alias("_key"))
    chosen = chosen.select(*TABLE, F.col("_key.constraint_name").alias("constraint_name"))
    keys = usage.join(chosen, [*TABLE, "constraint_name"])
    columns = F.array_sort(F.collect_list(F.struct("ordinal", F.upper("column").alias("name"))))
    return keys.groupBy(*TABLE).agg(F.transform(columns, lambda c: c["name"]).alias("key_list"))


def key_columns(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """The keys of ``key_lists`` with their size, and as one text for a report.

    The text cannot be taken apart again where a column's name has a comma: use the arrays.
    """
    return key_lists(constraints, usage).select(
        *TABLE, F.size("key_list").cast("bigint").alias("key_size"), F.array_join("key_list", ",").alias("key_columns")
    )


def session_catalog(spark: SparkSession, databases: Sequence[str] = ()) -> DataFrame:
    """Catalog rows of the session's own tables: those of ``describe``, and what their catalog declares.

    Adds ``nullable, default, comment, provider`` and the bucket columns in their order, NULL where
    a table has no buckets. All databases of the current catalog are scanned, or those named.
    Tables that go while they are scanned are left out; temporary views belong to no database.
    """
    rows = []
    for database in databases or [d.name for d in spark.catalog.listDatabases()]:
        for table in spark.catalog.listTables(database):
            if table.isTemporary:
                continue
            name = ".".join(map(quoted, (*(table.namespace or [database]), table.name)))
            try:
                found = json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {name} AS JSON").first()[0])
            except AnalysisException as error:
                if error.getCondition() == "TABLE_OR_VIEW_NOT_FOUND":
                    continue
                raise
            fields = {f.name: f for f in spark.table(name).schema.fields}
            for i, column in enumerate(found["columns"], start=1):
                kind = fields[column["name"]].dataType.simpleString()
                rows.append(
                    (
                        found.get("catalog_name"), database, table.name, i, column["name"], kind, column.get("nullable", True),
                        column.get("default"), column.get("comment"), found.get("provider"), found.get("bucket_columns") or None,
                    )
                )
    return spark.createDataFrame(
        rows,
        "catalog string, schema string, table string, ordinal int, column string, type string, nullable boolean, "
        "default string, comment string, provider string, bucket_columns array<string>",
    )


def key_profile(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row that says whether ``keys`` are unique and not null in the data."""
    has_null = F.expr(" OR ".join(f"{quoted(k)} IS NULL" for k in keys))
    per_key = df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).alias("_copies"))
    copies = F.col("_copies")
    totals = per_key.agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(copies > 1).alias("repeated_keys"),
        F.coalesce(F.max(copies), F.lit(0)).alias("max_rows_per_key"),
        F.coalesce(F.sum(F.when(has_null, copies)), F.lit(0)).alias("null_key_rows"),
    )
    usable = (F.col("repeated_keys") == 0) & (F.col("null_key_rows") == 0)
    return totals.select(F.lit(name).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"), "*",
                         usable.alias("is_key"))
