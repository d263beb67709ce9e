"""Stage rows as files, and read staged files back as checked rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcile.functions import LOAD_NULL_TOKENS, literal, null_tokens, quoted, well_formed_xml, xml_variant
from reconcile.operators.frames import in_any_case
from reconcile.operators.typemap import fits

ROW = "_row"
FILE = "_file"
BLOCK = "_block"
CORRUPT = "_corrupt_record"
FIRST_BAD = "_first_bad"

# Load status, and the two kinds of rejects.
LOADED, PARTIALLY_LOADED, LOAD_FAILED = "LOADED", "PARTIALLY_LOADED", "LOAD_FAILED"
CONVERSION, PARSING = "conversion", "parsing"

XML, VARIANT = "xml", "variant"

SHAPE_ERROR = "number of columns in file does not match the table"

# Comma, newline, one header line, quotes doubled inside quotes, no trimming, UTF-8.
CSV_OPTIONS = {
    "header": "true",
    "sep": ",",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


# How staged CSV writes what would break a line, in the order in which it is written; read back
# in the opposite order. No backslash is left that does not begin one of these.
_ESCAPES = (("\\", "\\s"), ("\n", "\\n"), ("\r", "\\r"))


def _escaped(value: str) -> str:
    for plain, written in _ESCAPES:
        value = f"replace({value}, {_characters(plain)}, {_characters(written)})"
    return value


def _unescaped(value: str) -> str:
    for plain, written in reversed(_ESCAPES):
        value = f"replace({value}, {_characters(written)}, {_characters(plain)})"
    return value


def _characters(text: str) -> str:
    """A text as SQL that is the same under every setting for escapes in literals."""
    return "concat(" + ", ".join(f"char({ord(c)})" for c in text) + ")"


def stage(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write rows for a later load, each with an id that rejects can refer to.

    In CSV a line is a row, whatever the values: line breaks and backslashes are written as
    ``\\n``, ``\\r`` and ``\\s``, so that a file of any size can be read by many tasks.
    """
    rows = df.select(F.monotonically_increasing_id().alias(ROW), *map(quoted, df.columns))
    if fmt == "csv":
        text = rows.selectExpr(*[f"{_escaped(f'CAST({quoted(c)} AS string)')} AS {quoted(c)}" for c in rows.columns])
        text.write.options(**CSV_OPTIONS).csv(path)
    else:
        rows.write.format(fmt).save(path)


def read_staged_csv(
    spark: SparkSession, path: str, columns: Sequence[str], *, numbered: bool = True, multi_line: bool = False
) -> DataFrame:
    """Staged text columns in file order, the source file, and the raw record of misshapen rows.

    A file is read by as many tasks as its size asks for. ``multi_line`` is for foreign files
    with line breaks inside quotes: it keeps them together, and makes a file one task. A foreign
    file's backslash is a character like any other; Spark reads no escapes outside quotes.
    ``numbered`` is false for files from elsewhere. Their rows get an id and the start of
    the block they were read from, from which reports work out the row number in the file.
    """
    names = [ROW, *columns] if numbered else list(columns)
    schema = ", ".join(f"{quoted(c)} string" for c in [*names, CORRUPT])
    rows = (
        spark.read.schema(schema)
        .options(**CSV_OPTIONS)
        # All columns must be parsed, or a row of the wrong length could pass.
        .option("columnPruning", "false")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("multiLine", str(multi_line).lower())
        .csv(path)
    )
    file = F.col("_metadata.file_path").alias(FILE)
    if numbered:
        values = [F.expr(_unescaped(quoted(c))).alias(c) for c in columns]
        return rows.select(file, F.col(ROW).try_cast("bigint").alias(ROW), *values, CORRUPT)
    block = F.col("_metadata.file_block_start").alias(BLOCK)
    return rows.select(file, block, F.monotonically_increasing_id().alias(ROW), *map(quoted, columns), CORRUPT)


def with_file_rows(checked: DataFrame) -> DataFrame:
    """The rows that were rejected, with their 1-based number in the file as row id.

    A block is read in order by one task, so its row ids count on from its first one.
    Only rejected rows are joined to the blocks.
    """
    blocks = _with_rows_before(
        checked.groupBy(FILE, BLOCK).agg(F.count(F.lit(1)).alias("_rows"), F.min(ROW).alias("_first_id"))
    )
    rows = checked.filter(F.col(FIRST_BAD).isNotNull()).join(blocks, [FILE, BLOCK])
    return rows.withColumn(ROW, _line(F.col(ROW))).drop("_rows", "_first_id", "_before", BLOCK)


def _with_rows_before(blocks: DataFrame) -> DataFrame:
    """Blocks with the number of rows before them; a window over the blocks of one file."""
    before = Window.partitionBy(FILE).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))


def _line(row_id: Column) -> Column:
    return F.col("_before") + row_id - F.col("_first_id") + 1


def check_rows(
    raw: DataFrame,
    types: Mapping[str, str],
    *,
    tokens: Sequence[str] = LOAD_NULL_TOKENS,
) -> DataFrame:
    """Raw rows with the position of the first column that does not convert.

    ``types`` maps columns to Spark types, to ``xml`` for text that must be a well-formed document,
    or to ``variant`` for such a document that is loaded as a value with fields.
    Position 0 means a misshapen row, NULL a good one. The raw columns stay, for the
    rejects; ``good_rows`` gives the typed ones.
    """
    dtypes = _dtypes(raw, types)
    tests = [f"CASE WHEN {CORRUPT} IS NOT NULL THEN 0 END"] if CORRUPT in raw.columns else []
    for i, (column, spark_type) in enumerate(types.items(), start=1):
        tests.append(f"CASE WHEN {_is_bad(column, dtypes[column], spark_type, tokens)} THEN {i} END")
    return raw.withColumn(FIRST_BAD, F.expr(f"coalesce({', '.join(tests)})"))


def _dtypes(df: DataFrame, columns: Iterable[str]) -> dict[str, T.DataType]:
    return in_any_case({f.name: f.dataType for f in df.schema.fields}, columns)


def _value(column: str, dtype: T.DataType, tokens: Sequence[str]) -> str:
    return null_tokens(quoted(column), tokens) if isinstance(dtype, T.StringType) else quoted(column)


def _is_bad(column: str, dtype: T.DataType, spark_type: str, tokens: Sequence[str]) -> str:
    value = _value(column, dtype, tokens)
    if dtype.simpleString() == spark_type:
        return "false"
    if spark_type in (XML, VARIANT):
        return f"NOT {well_formed_xml(value)}"
    return f"({value} IS NOT NULL AND NOT ({fits(value, dtype, spark_type)}))"


def _typed(column: str, dtype: T.DataType, spark_type: str, tokens: Sequence[str]) -> str:
    value = _value(column, dtype, tokens)
    if spark_type == VARIANT and dtype.simpleString() != VARIANT:
        return xml_variant(value)
    return value if spark_type in (XML, dtype.simpleString()) else f"try_cast({value} AS {spark_type})"


def good_rows(checked: DataFrame, types: Mapping[str, str], *, tokens: Sequence[str] = LOAD_NULL_TOKENS) -> DataFrame:
    """The rows that convert, in their types."""
    dtypes = _dtypes(checked, types)
    typed = [f"{_typed(c, dtypes[c], t, tokens)} AS {quoted(c)}" for c, t in types.items()]
    return checked.filter(F.col(FIRST_BAD).isNull()).selectExpr(*typed)


def reject_rows(
    checked: DataFrame, types: Mapping[str, str], *, tokens: Sequence[str] = LOAD_NULL_TOKENS, also: Sequence[str] = ()
) -> DataFrame:
    """One row per cell that does not convert, and one per misshapen row; ``also`` columns are carried on."""
    record = "to_csv(struct(" + ", ".join(f"CAST({quoted(c)} AS string) AS {quoted(c)}" for c in types) + "))"
    dtypes = _dtypes(checked, types)
    cells = [
        f"named_struct('column_name', {literal(c)}, 'category', {literal(CONVERSION)}, "
        f"'error', {literal(conversion_error(c, t))}, 'bad', {_is_bad(c, dtypes[c], t, tokens)})"
        for c, t in types.items()
    ]
    errors = f"filter(array({', '.join(cells)}), cell -> cell.bad)"
    if CORRUPT in checked.columns:
        shape = (
            f"array(named_struct('column_name', CAST(NULL AS string), 'category', {literal(PARSING)}, "
            f"'error', {literal(SHAPE_ERROR)}, 'bad', true))"
        )
        errors = f"CASE WHEN {CORRUPT} IS NOT NULL THEN {shape} ELSE {errors} END"
        record = f"coalesce({CORRUPT}, {record})"
    rows = checked.filter(F.col(FIRST_BAD).isNotNull())
    file = FILE if FILE in checked.columns else "CAST(NULL AS string)"
    return rows.selectExpr(
        f"{file} AS file", f"{ROW} AS row_number", f"{record} AS rejected_record", *map(quoted, also), f"inline({errors})"
    ).drop("bad")


def conversion_error(column: str, spark_type: str) -> str:
    return f"value of {column} is no {spark_type}"


def load_counters() -> list[Column]:
    """Aggregates over checked rows, for ``with_status``."""
    bad = F.col(FIRST_BAD).isNotNull()
    return [
        F.count(F.lit(1)).alias("rows_parsed"),
        F.count_if(~bad).alias("rows_loaded"),
        F.count_if(bad).alias("errors_seen"),
        F.min(F.when(bad, F.col(ROW))).alias("first_error_line"),
        F.min_by(F.col(FIRST_BAD), F.when(bad, F.col(ROW))).alias("_first"),
    ]


def load_result(checked: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Counters and the first error per file, with status words of a load.

    Only fixed-width values are aggregated; the error text is put in afterwards.
    """
    file = F.col(FILE) if FILE in checked.columns else F.lit(None).cast("string")
    if BLOCK not in checked.columns:
        return with_status(checked.groupBy(file.alias("file")).agg(*load_counters()), types)
    blocks = checked.groupBy(FILE, BLOCK).agg(*load_counters(), F.count(F.lit(1)).alias("_rows"), F.min(ROW).alias("_first_id"))
    line = _line(F.col("first_error_line"))
    per_file = _with_rows_before(blocks).groupBy(F.col(FILE).alias("file")).agg(
        *[F.sum(c).alias(c) for c in ("rows_parsed", "rows_loaded", "errors_seen")],
        F.min(line).alias("first_error_line"),
        F.min_by("_first", line).alias("_first"),
    )
    return with_status(per_file, types)


def with_status(totals: DataFrame, types: Mapping[str, str]) -> DataFrame:
    columns = list(types)
    names = F.expr(f"array(CAST(NULL AS string), {', '.join(map(literal, columns))})")
    texts = [SHAPE_ERROR, *[conversion_error(c, types[c]) for c in columns]]
    errors_by_column = F.expr(f"array({', '.join(map(literal, texts))})")
    parsed, loaded, errors = F.col("rows_parsed"), F.col("rows_loaded"), F.col("errors_seen")
    status = F.when(errors == 0, LOADED).when(loaded == 0, LOAD_FAILED).otherwise(PARTIALLY_LOADED)
    return totals.select(
        "file",
        status.alias("status"),
        "rows_parsed",
        "rows_loaded",
        parsed.alias("error_limit"),
        "errors_seen",
        F.get(errors_by_column, F.col("_first")).alias("first_error"),
        "first_error_line",
        F.lit(None).cast("bigint").alias("first_error_character"),
        F.get(names, F.col("_first")).alias("first_error_column_name"),
    )
