"""Delimited files from elsewhere: escapes, quotes, line breaks inside quotes, and positions.

A file is read line by line by as many tasks as its size asks for. One regular expression takes
a record apart into its fields, in one pass and with each character in one field. A backslash
outside quotes takes the meaning of the character behind it away, or makes it a line break or tab;
inside quotes it is a character like any other, and a quote is written twice.

Where quotes may hold line breaks, a line's meaning depends on all lines before it: it begins
outside or inside quotes. Each line is a map from how it begins to how it ends. The maps of 4,096
lines are put together to one, those of the chunks of a file are followed up, and then every line
knows how it begins, without reading the file in one task. Where in the file a record stands is
summed up from lines and bytes of the chunks before it in the same way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.functions import LOAD_NULL_TOKENS
from reconcile.sources.staged import BLOCK, CORRUPT, FILE, FIRST_BAD, ROW, reject_rows

LINE, RECORD, CHUNK = "_line", "_record", "_chunk"

# Lines whose states and offsets one task follows up in one group: 2 ** 12.
_CHUNK_BITS = 12

# A quoted value that never ends would make the rest of a file one record. Beyond this size only
# the record's first line is kept, and rejected.
MOST_RECORD_BYTES = 16 << 20

# What a backslash outside quotes makes of the character behind it, if not itself.
_MEANINGS = (("n", 10), ("r", 13), ("t", 9), ("b", 8), ("f", 12))

_ENCLOSED = '"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
_PLAIN = r'(?!")[^,\\]*+(?:\\.[^,\\]*+)*+(?:\\$)?'
_FIELD = f"(?:{_ENCLOSED}|{_PLAIN})"

# Every field with the comma before it, of a record that begins with a comma.
_FIELDS = rf"(?s)\G,{_FIELD}"

# Such a record, or its beginning, that ends inside quotes.
_OPEN = rf'(?s)^(?:,{_FIELD})*+,"[^"]*+(?:""[^"]*+)*+$'

# What a line does to the state outside or inside quotes.
_KEEPS, _SWAPS, _LEAVES, _ENTERS = 0, 1, 2, 3


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files, with the file, the block a task read them from, and an id in order.

    A carriage return before the line break stays; ``parse_records`` drops it.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(ROW),
        F.col("value").alias(LINE),
    )


def parse_records(lines: DataFrame, columns: Sequence[str], *, header: bool = True, multi_line: bool = False) -> DataFrame:
    """Text columns of every record, and the raw record of those that are misshapen.

    ``lines`` are those of ``read_lines``. The result is for ``check_rows``. A record is misshapen
    if it has more or fewer fields than ``columns``, or text beside a quoted field. A blank line is
    a record of one empty field. With ``header`` the first line of each file is left out. With
    ``multi_line`` quoted values may hold line breaks; without, a record is a line, and a quote
    that is open at its end makes it misshapen. An empty file has no records.
    """
    if multi_line:
        lines = _joined(lines, header)
    else:
        if header:
            lines = _without(lines, _headers(_chunks(lines)))
        lines = lines.withColumn(RECORD, F.regexp_replace(LINE, r"\r$", "")).drop(LINE)
    fields = F.regexp_extract_all(F.concat(F.lit(","), RECORD), F.lit(_FIELDS), F.lit(0))
    rows = lines.withColumn("_fields", fields)
    whole = F.length(F.array_join("_fields", "")) == F.length(RECORD) + 1
    right = whole & (F.size("_fields") == len(columns))
    values = [F.when(right, _value(F.col("_fields")[i])).alias(c) for i, c in enumerate(columns)]
    return rows.select(FILE, BLOCK, ROW, *values, F.when(~right, F.col(RECORD)).alias(CORRUPT), RECORD)


def _value(field: Column) -> Column:
    """The value of a field that still has the comma before it."""
    text = F.substr(field, F.lit(2))
    inner = F.replace(F.substr(text, F.lit(2), F.length(text) - 2), F.lit('""'), F.lit('"'))
    # Pairs of backslashes are taken out first, as escapes are read from the left.
    plain = F.array_join(F.transform(F.split(text, r"\\\\"), _unescaped), "\\")
    plain = F.when(F.contains(text, F.lit("\\")), plain).otherwise(text)
    return F.when(F.startswith(text, F.lit('"')), inner).otherwise(plain)


def _unescaped(part: Column) -> Column:
    for letter, code in _MEANINGS:
        part = F.replace(part, F.lit(f"\\{letter}"), F.lit(chr(code)))
    return F.regexp_replace(part, r"(?s)\\(.)", "$1")


def _chunks(lines: DataFrame) -> DataFrame:
    """Runs of up to 4,096 lines of a block: their number, bytes and first id."""
    chunked = lines.withColumn(CHUNK, F.shiftright(ROW, _CHUNK_BITS))
    return chunked.groupBy(FILE, BLOCK, CHUNK).agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length(LINE) + 1).alias("bytes"),
        F.min(ROW).alias("first_id"),
        F.max(ROW).alias("last_id"),
    )


def _headers(chunks: DataFrame) -> DataFrame:
    """The first line of each file."""
    return chunks.groupBy(FILE).agg(F.min_by(F.struct(BLOCK, F.col("first_id").alias(ROW)), F.struct(BLOCK, "first_id")).alias("h")).select(FILE, "h.*")


def _without(lines: DataFrame, gone: DataFrame) -> DataFrame:
    return lines.join(gone, [FILE, BLOCK, ROW], "left_anti")


def _kind(line: Column) -> Column:
    """What a line does to the state; a line without quotes does nothing."""
    outside = F.rlike(F.concat(F.lit(","), line), F.lit(_OPEN))
    inside = F.rlike(F.concat(F.lit(',"'), line), F.lit(_OPEN))
    kind = F.when(outside & inside, _ENTERS).when(outside, _SWAPS).when(inside, _KEEPS).otherwise(_LEAVES)
    return F.when(F.contains(line, F.lit('"')), kind).otherwise(_KEEPS)


def _after(state: str, kind: str) -> str:
    return f"CASE WHEN {kind} >= {_LEAVES} THEN {kind} - {_LEAVES} ELSE {state} ^ {kind} END"


def _before(rows: DataFrame, group: list[str], order: list[str], start: Column) -> DataFrame:
    """Add ``state``, how each row begins, for rows with a ``kind`` that follow one another.

    It is what the last row that leaves or enters quotes says, but for the swaps since then.
    """
    past = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum(F.when(F.col("kind") == _SWAPS, 1).otherwise(0)).over(past), F.lit(0))
    rows = rows.withColumn("swaps", swaps)
    fixed = F.when(F.col("kind") >= _LEAVES, F.struct((F.col("kind") - _LEAVES).alias("state"), "swaps"))
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(past))
    since = F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0))
    state = F.coalesce(F.col("fixed.state"), start).bitwiseXOR((since % 2).cast("int"))
    return rows.withColumn("state", state).drop("swaps", "fixed")


def _joined(lines: DataFrame, header: bool) -> DataFrame:
    """The records of ``lines``: most are a line, others are put together from several."""
    marked = lines.withColumns({CHUNK: F.shiftright(ROW, _CHUNK_BITS), "kind": _kind(F.col(LINE))})
    turn = F.when(F.col("kind") != _KEEPS, F.struct(ROW, "kind"))
    chunks = marked.groupBy(FILE, BLOCK, CHUNK).agg(F.array_sort(F.collect_list(turn)).alias("turns"), F.max(ROW).alias("last_id"), F.min(ROW).alias("first_id"))
    kind = f"aggregate(turns, {_KEEPS}, (k, t) -> CASE WHEN t.kind >= {_LEAVES} THEN t.kind ELSE k ^ t.kind END)"
    chunks = chunks.withColumn("kind", F.expr(kind))
    chunks = _before(chunks, [FILE], [BLOCK, CHUNK], F.lit(0)).withColumnRenamed("state", "chunk_state")

    # Lines of other chunks are records of their own.
    turning = chunks.filter("size(turns) > 0 OR chunk_state > 0").select(FILE, BLOCK, CHUNK, "chunk_state")
    single = marked.join(turning, [FILE, BLOCK, CHUNK], "left_anti")
    inside = _before(marked.join(turning, [FILE, BLOCK, CHUNK]), [FILE, BLOCK, CHUNK], [ROW], F.col("chunk_state"))
    inside = inside.withColumn("after", F.expr(_after("state", "kind")))
    single = single.select(FILE, BLOCK, ROW, LINE).unionByName(inside.filter("state = 0 AND after = 0").select(FILE, BLOCK, ROW, LINE))

    parts = inside.filter("state = 1 OR after = 1")
    # A record's first line may stand in a chunk long before: the last line that began outside.
    own = F.when(F.col("state") == 0, F.struct(BLOCK, ROW))
    heads = parts.groupBy(FILE, BLOCK, CHUNK).agg(F.max(own).alias("head"))
    past = Window.partitionBy(FILE).orderBy(BLOCK, CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("carried", F.last("head", ignorenulls=True).over(past)).drop("head")
    so_far = Window.partitionBy(FILE, BLOCK, CHUNK).orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.join(heads, [FILE, BLOCK, CHUNK]).withColumn("head", F.coalesce(F.last(own, ignorenulls=True).over(so_far), F.col("carried")))

    sizes = parts.groupBy(FILE, "head").agg(F.sum(F.octet_length(LINE) + 1).alias("size"))
    parts = parts.join(sizes, [FILE, "head"]).filter((F.col("size") <= MOST_RECORD_BYTES) | (F.col("head") == F.struct(BLOCK, ROW)))
    records = parts.groupBy(FILE, "head").agg(F.array_sort(F.collect_list(F.struct(BLOCK, ROW, LINE))).alias("lines"))
    records = records.select(FILE, "head.*", F.array_join(F.transform("lines", lambda x: x[LINE]), "\n").alias(LINE))
    records = single.unionByName(records)
    if header:
        records = _without(records, _headers(chunks))
    return records.withColumn(RECORD, F.regexp_replace(LINE, r"\r$", "")).drop(LINE)


def with_positions(checked: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows that were rejected, with where they stand in their file.

    Adds ``row_start_line`` (from 1), ``byte_offset`` (of the record's first byte, from 0) and makes
    the row id the number of the record in the file, the header not counted. ``lines`` are those
    that were parsed. Only the chunks of rejected rows are numbered line by line.
    """
    placed = checked.withColumn(CHUNK, F.shiftright(ROW, _CHUNK_BITS))
    chunk = [FILE, BLOCK, CHUNK]
    begun = placed.groupBy(*chunk).agg(F.count(F.lit(1)).alias("records"))
    chunks = _chunks(lines).join(begun, chunk, "left")
    past = Window.partitionBy(FILE).orderBy(BLOCK, CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sums = {f"{c}_before": F.coalesce(F.sum(c).over(past), F.lit(0)) for c in ("lines", "bytes", "records")}
    bad = placed.filter(F.col(FIRST_BAD).isNotNull())
    wanted = bad.select(*chunk).distinct().join(chunks.select(*chunk, *[v.alias(k) for k, v in sums.items()]), chunk)

    order = Window.partitionBy(*chunk).orderBy(ROW)
    above = order.rowsBetween(Window.unboundedPreceding, -1)
    near = lines.withColumn(CHUNK, F.shiftright(ROW, _CHUNK_BITS)).join(wanted, chunk).select(
        FILE, BLOCK, ROW,
        (F.col("lines_before") + F.row_number().over(order)).alias("row_start_line"),
        (F.col("bytes_before") + F.coalesce(F.sum(F.octet_length(LINE) + 1).over(above), F.lit(0))).alias("byte_offset"),
    )
    numbers = placed.select(*chunk, ROW).join(wanted, chunk)
    numbers = numbers.select(FILE, BLOCK, ROW, (F.col("records_before") + F.row_number().over(order)).alias("_number"))
    rows = bad.drop(CHUNK).join(near, [FILE, BLOCK, ROW]).join(numbers, [FILE, BLOCK, ROW])
    return rows.withColumn(ROW, F.col("_number")).drop(BLOCK, "_number")


def reject_records(
    checked: DataFrame, lines: DataFrame, types: Mapping[str, str], *, tokens: Sequence[str] = LOAD_NULL_TOKENS
) -> DataFrame:
    """One row per cell that does not convert, and one per misshapen record, with its place.

    Columns are those of ``reject_rows``, and ``row_start_line, byte_offset, character``: the place
    (from 1) in the record where the field begins that is wrong, missing or one too many.
    """
    names = list(types)
    placed = with_positions(checked, lines)
    rejects = reject_rows(placed, types, tokens=tokens, also=("row_start_line", "byte_offset", RECORD))
    fields = F.regexp_extract_all(F.concat(F.lit(","), RECORD), F.lit(_FIELDS), F.lit(0))
    rejects = rejects.withColumn("_fields", fields)
    begins = "aggregate(slice(_fields, 1, {0}), 1, (at, field) -> at + length(field))"
    column = F.array_position(F.lit(names), F.col("column_name"))
    rejects = rejects.withColumn("_column", column.cast("int"))
    read = F.length(F.array_join("_fields", ""))
    shape = (
        F.when(read <= F.length(RECORD), read + 1)
        .when(F.size("_fields") > len(names), F.expr(begins.format(len(names))))
        .otherwise(F.length(RECORD) + 1)
    )
    character = F.when(F.col("_column") > 0, F.expr(begins.format("greatest(_column - 1, 0)"))).otherwise(shape)
    return rejects.select(
        "file", "row_number", F.col(RECORD).alias("rejected_record"), "row_start_line", "byte_offset",
        character.cast("bigint").alias("character"), "column_name", "category", "error",
    )
