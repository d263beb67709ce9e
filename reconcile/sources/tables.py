"""Read whole tables from files, the session catalog or a database."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcile.functions import quoted


def extract(
    source: DataFrame,
    columns: Sequence[str] = (),
    where: Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Columns and rows of a source; both reach the scan. ``limit`` cuts only if asked for."""
    if where is not None:
        source = source.filter(where)
    if columns:
        source = source.select(*map(quoted, columns))
    return source if limit is None else source.limit(limit)


def read_path(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    return spark.read.format(fmt).options(**options).load(path)


def counting_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark`` in which a count of a Parquet table is read from its footers.

    What is read there goes through the reader that takes aggregates over; a count opens no column.
    Files with deleted or filtered rows are counted as any reader does.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return session


def jdbc_options(
    url: str,
    table: str,
    *,
    partition_column: str | None = None,
    lower_bound: int | str | None = None,
    upper_bound: int | str | None = None,
    num_partitions: int | None = None,
    fetch_size: int = 50_000,
    extra: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options for a JDBC read that many executors share.

    The bounds only split the reads: rows beyond them still arrive, in the first or the
    last partition. All four partition settings go together.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **(extra or {})}
    split = {
        "partitionColumn": partition_column,
        "lowerBound": lower_bound,
        "upperBound": upper_bound,
        "numPartitions": num_partitions,
    }
    given = [k for k, v in split.items() if v is not None]
    if given and len(given) < len(split):
        raise ValueError(f"a partitioned read needs {', '.join(k for k in split if k not in given)} too")
    options.update({k: str(split[k]) for k in given})
    return options


def key_range_predicates(column: str, bounds: Sequence[int]) -> list[str]:
    """WHERE clauses for a JDBC read over uneven key ranges, one per task.

    ``bounds`` are ascending cut points, as from quantiles of the key, so that each task
    reads about the same number of rows where equal ranges would not. Every row, with a
    NULL key too, is in exactly one range.
    """
    if not bounds:
        return ["1 = 1"]
    middle = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(bounds, bounds[1:])]
    return [f"{column} < {bounds[0]} OR {column} IS NULL", *middle, f"{column} >= {bounds[-1]}"]


def key_bounds(df: DataFrame, column: str, ranges: int, accuracy: int = 10_000) -> list[int]:
    """Ascending cut points of a key, for ``key_range_predicates``, with about as many rows between them.

    They are quantiles of a sketch that each task fills and that are then merged, so the rows are
    read once and a few thousand numbers go to the driver. A rank is off by at most one in
    ``accuracy`` of the rows. A key value that fills more than a range of its own takes that many
    cut points, which come out as one.
    """
    if ranges < 2:
        return []
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    found = df.agg(F.percentile_approx(quoted(column), shares, accuracy)).first()[0] or []
    # A row of the bound itself stands in the range above it, so the bound is the next key.
    return sorted({int(b) + 1 for b in found})


def read_jdbc(
    spark: SparkSession, options: Mapping[str, str], predicates: Sequence[str] = ()
) -> DataFrame:
    if predicates:
        properties = {k: v for k, v in options.items() if k not in ("url", "dbtable")}
        return spark.read.jdbc(options["url"], options["dbtable"], predicates=list(predicates), properties=properties)
    return spark.read.format("jdbc").options(**options).load()


# Metadata queries of an information schema, for the JDBC ``query`` option.
COLUMNS_QUERY = (
    "SELECT TABLE_CATALOG, TABLE_SCHEMA, TABLE_NAME, ORDINAL_POSITION, COLUMN_NAME, DATA_TYPE, "
    "CHARACTER_MAXIMUM_LENGTH, NUMERIC_PRECISION, DATETIME_PRECISION, IS_NULLABLE, COLUMN_DEFAULT, NUMERIC_SCALE "
    "FROM INFORMATION_SCHEMA.COLUMNS"
)
CONSTRAINTS_QUERY = "SELECT CONSTRAINT_NAME, TABLE_CATALOG, TABLE_SCHEMA, TABLE_NAME, CONSTRAINT_TYPE FROM INFORMATION_SCHEMA.TABLE_CONSTRAINTS"
KEY_USAGE_QUERY = (
    "SELECT CONSTRAINT_NAME, TABLE_CATALOG, TABLE_SCHEMA, TABLE_NAME, COLUMN_NAME, ORDINAL_POSITION "
    "FROM INFORMATION_SCHEMA.KEY_COLUMN_USAGE"
)


def metadata_options(url: str, query: str, extra: Mapping[str, str] | None = None) -> dict[str, str]:
    """Options for one of the metadata queries above; all tables come in a single read."""
    return {"url": url, "query": query, **(extra or {})}
