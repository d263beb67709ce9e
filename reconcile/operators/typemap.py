"""Source types, their target types, and whether data fits its declared type."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcile.functions import literal, null_tokens, quoted
from reconcile.functions.values import DATE_TEXT
from reconcile.operators.frames import in_any_case

# Source type, target type, Spark type the column is loaded as.
TYPE_MAP = [
    ("bigint", "NUMBER", "bigint"),
    ("bit", "BOOLEAN", "int"),
    ("decimal", "NUMBER", "decimal"),
    ("int", "NUMBER", "int"),
    ("money", "FLOAT", "decimal(19,4)"),
    ("numeric", "NUMBER", "decimal"),
    ("smallint", "NUMBER", "smallint"),
    ("smallmoney", "FLOAT", "decimal(10,4)"),
    ("tinyint", "NUMBER", "smallint"),
    ("float", "FLOAT", "double"),
    ("real", "NUMERIC", "float"),
    ("date", "DATE", "date"),
    ("datetime2", "TIMESTAMP_NTZ", "timestamp_ntz"),
    ("datetime", "TIMESTAMP_NTZ", "timestamp_ntz"),
    ("datetimeoffset", "TIMESTAMP_LTZ", "timestamp"),
    ("smalldatetime", "DATETIME", "timestamp_ntz"),
    ("time", "TIME", "string"),
    ("char", "VARCHAR", "string"),
    ("text", "VARCHAR", "string"),
    ("varchar", "VARCHAR", "string"),
    ("nchar", "VARCHAR", "string"),
    ("ntext", "VARCHAR", "string"),
    ("nvarchar", "VARCHAR", "string"),
    ("uniqueidentifier", "VARCHAR(16777216)", "string"),
    ("xml", "VARIANT", "string"),
    ("hierarchyid", "VARCHAR", "string"),
    ("binary", "BINARY", "binary"),
    ("varbinary", "VARCHAR", "binary"),
    ("geography", "VARCHAR", "string"),
]

# Widest text and binary of the target.
UNBOUNDED_VARCHAR = "VARCHAR(16777216)"
UNBOUNDED_BINARY = "BINARY(8388608)"


def type_map(spark: SparkSession, dialect: str = "SQL_SERVER") -> DataFrame:
    """The type map as rows (dialect, source_type, target_type, spark_type)."""
    rows = ", ".join(f"('{dialect}', '{s}', '{t}', '{k}')" for s, t, k in TYPE_MAP)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(dialect, source_type, target_type, spark_type)")


def map_types(catalog: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Catalog rows with target type, its full text, and the Spark type to load.

    A type the map does not list passes through unchanged.
    """
    if mapping is None:
        # The built-in map is a constant of a few dozen rows.
        mapping = F.broadcast(type_map(catalog.sparkSession))
    lookup = mapping.select(
        F.col("source_type").alias("_source_type"),
        F.col("target_type").alias("_target_type"),
        F.col("spark_type").alias("_spark_type"),
    )
    mapped = catalog.join(lookup, F.lower("data_type") == F.col("_source_type"), "left")
    target = F.coalesce(F.col("_target_type"), F.col("data_type"))
    return mapped.select(
        *[F.col(f"`{c}`") for c in catalog.columns],
        target.alias("target_type"),
        rendered_type(target, F.col("length"), F.col("scale")).alias("rendered_type"),
        spark_type(F.coalesce(F.col("_spark_type"), F.lit("string")), F.col("length"), F.col("scale")).alias(
            "spark_type"
        ),
    )


def rendered_type(target: Column, length: Column, scale: Column) -> Column:
    """The full type text, such as ``NUMBER(10,2)``. Lengths below 1 mean unbounded."""
    n = length.cast("int").cast("string")
    s = scale.cast("int").cast("string")
    sized = F.concat(target, F.lit("("), n, F.lit(")"))
    return (
        F.when(target.isin("FLOAT", "DATE", "VARIANT", UNBOUNDED_VARCHAR), target)
        .when(target == "BOOLEAN", F.lit("NUMBER(1,0)"))
        .when(target == "BINARY", F.lit(UNBOUNDED_BINARY))
        .when(target == "NUMBER", F.concat(target, F.lit("("), n, F.lit(","), F.coalesce(s, F.lit("0")), F.lit(")")))
        .when((target == "VARCHAR") & (length.isNull() | (length <= 0)), F.lit(UNBOUNDED_VARCHAR))
        .when(length.isNull() | (length < 0), target)
        .otherwise(sized)
    )


def spark_type(name: Column, length: Column, scale: Column) -> Column:
    digits = F.concat(
        F.lit("decimal("), length.cast("int").cast("string"), F.lit(","),
        F.coalesce(scale.cast("int").cast("string"), F.lit("0")), F.lit(")"),
    )
    return F.when(name == "decimal", digits).otherwise(name)


def column_types(catalog: DataFrame, database: str, schema: str, table: str) -> list[tuple[str, str, str, str]]:
    """The columns of one table in order: name, declared type, type to load, type to check.

    XML is loaded as text that must be well-formed. The type to check is narrower than the
    type to load where the source's type is: sized text, and the unsigned ``tinyint``.
    Collects the columns of a single table, whose number the source system limits.
    """
    one = catalog.filter(
        (F.col("database") == database) & (F.col("schema") == schema) & (F.col("table") == table)
    )
    kind, loaded = F.lower("data_type"), F.col("spark_type")
    to_load = F.when(kind == "xml", "xml").otherwise(loaded)
    sized = (F.col("target_type") == "VARCHAR") & (loaded == "string") & (F.col("length") > 0)
    to_check = (
        F.when(sized, F.concat(F.lit("varchar("), F.col("length").cast("string"), F.lit(")")))
        .when(kind == "tinyint", UNSIGNED_TINYINT)
        .otherwise(loaded)
    )
    rows = map_types(one).orderBy("ordinal").select("column", kind, to_load, to_check).collect()
    return [tuple(r) for r in rows]


UNSIGNED_TINYINT = "unsigned tinyint"

# Smallest and largest value of the whole-number types.
WHOLE_RANGES = {
    UNSIGNED_TINYINT: (0, 255),
    "tinyint": (-128, 127),
    "smallint": (-32768, 32767),
    "int": (-2147483648, 2147483647),
    "bigint": (-9223372036854775808, 9223372036854775807),
}


def fits(value: str, dtype: T.DataType, declared: str) -> str:
    """Whether a non-null value fits a declared type such as ``varchar(8)`` or ``decimal(7,2)``.

    A value fits only if the type holds all of it: no digit is rounded off, no fraction cut off
    and no time of day lost. Numbers are tested against the range of the type; a cast that
    fails costs far more.
    """
    name = " ".join(declared.lower().split()).replace(", ", ",")
    is_float = isinstance(dtype, (T.FloatType, T.DoubleType))
    sized = re.fullmatch(r"n?(?:var)?char\((-?\d+)\)", name)
    if sized:
        limit = int(sized.group(1))
        return "true" if limit <= 0 else f"length(CAST({value} AS string)) <= {limit}"
    digits = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
    if digits and isinstance(dtype, T.NumericType):
        precision, scale = int(digits.group(1)), int(digits.group(2))
        bound = f"abs({value}) < {_number(10 ** (precision - scale), is_float)}"
        return f"({bound} AND round({value}, {scale}) = {value})"
    if name in WHOLE_RANGES and isinstance(dtype, T.NumericType):
        low, high = WHOLE_RANGES[name]
        whole = "true" if isinstance(dtype, T.IntegralType) else f"{value} = floor({value})"
        if is_float:
            # The first whole number beyond the range is a double, the last one within may be none.
            return f"({value} >= {_number(low, True)} AND {value} < {_number(high + 1, True)} AND {whole})"
        return f"({value} BETWEEN {_number(low, False)} AND {_number(high, False)} AND {whole})"
    if isinstance(dtype, T.StringType) and (name in WHOLE_RANGES or digits):
        return _text_fits(value, "smallint" if name == UNSIGNED_TINYINT else name, name == UNSIGNED_TINYINT)
    if name == "date" and isinstance(dtype, T.StringType):
        return f"({value} RLIKE r'{DATE_TEXT}' AND try_cast({value} AS date) IS NOT NULL)"
    if name == "date" and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"{value} = date_trunc('day', {value})"
    return f"try_cast({value} AS {name}) IS NOT NULL"


def _text_fits(value: str, name: str, unsigned: bool) -> str:
    """Whether number text has no digit that the type would lose.

    Plain numbers are told by their digits, as the finest decimal may hold fewer of them; those
    with an exponent by their value.
    """
    cast = f"try_cast({value} AS {name})"
    digits = re.fullmatch(r"decimal\((\d+),(\d+)\)", name)
    scale = int(digits.group(2)) if digits else 0
    plain = rf"{value} RLIKE r'^\s*[+-]?\d*(\.\d{{0,{scale}}}0*)?\s*$'"
    finer = f"decimal(38,{max(scale, 18)})"
    exponent = f"({value} RLIKE '[eE]' AND CAST({cast} AS {finer}) = try_cast({value} AS {finer}))"
    in_range = f" AND {cast} BETWEEN 0 AND 255" if unsigned else ""
    return f"coalesce({cast} IS NOT NULL AND ({plain} OR {exponent}){in_range}, false)"


def _number(number: int, is_float: bool) -> str:
    """A whole number as SQL; no decimal reaches more than 38 digits."""
    return f"{float(number)!r}D" if is_float else f"{min(number, 10**38 - 1)}BD"


def fit_check(df: DataFrame, declared: Mapping[str, str]) -> DataFrame:
    """Per declared column: values checked and values that do not fit, in one pass.

    Null tokens are no values. Names in ``declared`` are columns of ``df``, in any case.
    """
    dtypes = in_any_case({f.name: f.dataType for f in df.schema.fields}, declared)
    measures, structs = [], []
    for i, (name, text) in enumerate(declared.items()):
        value = quoted(name)
        if isinstance(dtypes[name], T.StringType):
            value = null_tokens(value)
        misfit = f"{value} IS NOT NULL AND NOT ({fits(value, dtypes[name], text)})"
        measures += [f"count({value}) AS _n{i}", f"count_if({misfit}) AS _m{i}"]
        structs.append(
            f"named_struct('column_name', {literal(name)}, 'declared_type', {literal(text)}, "
            f"'checked', _n{i}, 'misfits', _m{i})"
        )
    return df.selectExpr(*measures).selectExpr(f"inline(array({', '.join(structs)}))")
