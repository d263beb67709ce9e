"""Compare two tables cell by cell, by key, by content or by position.

Every comparison starts with ``signed_rows``: both tables are unioned and counted by
their whole content, so equal rows cancel in one shuffle with map-side combining. Copies
of one row, and rows that share one key, never meet in one task uncombined. Only the
rows that are left over, as a rule very few, are shuffled again to be paired by key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from reconcile.functions import (
    date_only,
    decimal_value,
    flag_to_int,
    literal,
    null_tokens,
    number_text,
    quoted,
    time_to_second,
    well_formed_xml,
)
from reconcile.session import MOST_TASKS, write_through

# Added to rows while they are compared.
SOURCE_COPIES = "_source_copies"
TARGET_COPIES = "_target_copies"

CHANGED = "changed"
MISSING = "missing_in_target"
EXTRA = "extra_in_target"
AMBIGUOUS = "ambiguous"


def normalize(df: DataFrame, types: Mapping[str, str] | None = None, xml_by_validity: bool = False) -> DataFrame:
    """Bring the values of one side to the form in which sides are compared.

    ``types`` gives target types by column name, in any case: ``DATE``, ``TIME(n)``,
    ``NUMBER(p,s)``, ``BOOLEAN`` or ``VARIANT``. Null tokens are removed from all text. Text
    that is no value of its type stays as it is, so that it differs from NULL and other text.
    XML documents are compared by their text; with ``xml_by_validity`` all well-formed ones of
    a ``VARIANT`` column count as equal, for a target that does not keep their text.
    """
    wanted = {name.upper(): text.upper().strip() for name, text in (types or {}).items()}
    kinds = {f.name: wanted.get(f.name.upper(), "") for f in df.schema.fields}
    if not xml_by_validity:
        kinds = {name: "" if kind == "VARIANT" else kind for name, kind in kinds.items()}
    return df.selectExpr(*[_normalized(f, kinds[f.name]) for f in df.schema.fields])


def _normalized(field: T.StructField, target_type: str) -> str:
    value = quoted(field.name)
    if isinstance(field.dataType, T.StringType):
        value = null_tokens(value)
    return f"{_in_type(value, field.dataType, target_type)} AS {quoted(field.name)}"


def _in_type(value: str, dtype: T.DataType, target_type: str) -> str:
    if target_type == "DATE":
        return date_only(value, dtype)
    if target_type == "TIME" or target_type.startswith("TIME("):
        return time_to_second(value)
    if target_type in ("BOOLEAN", "NUMBER(1,0)"):
        return flag_to_int(value, dtype)
    if target_type.startswith("NUMBER("):
        scale = target_type.rstrip(")").partition(",")[2]
        if int(scale or 0) > 0:
            return decimal_value(value, dtype, int(scale))
    if target_type == "VARIANT":
        # Well-formed documents count as equal; a lost document still differs.
        return f"CASE WHEN {value} IS NOT NULL AND {well_formed_xml(value)} THEN 'VALID' ELSE {value} END"
    return value


def aligned(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Select lists that give both sides the source's columns, in one type each.

    Columns are matched by name in any case. A column that only one side has is an error
    unless it is excluded: tables of different columns are not equal.
    """
    skip = {name.upper() for name in exclude}
    by_name = {f.name.upper(): f for f in target.schema.fields}
    left, right = [], []
    for field in source.schema.fields:
        if field.name.upper() in skip:
            continue
        other = by_name.get(field.name.upper())
        if other is None:
            raise ValueError(f"target has no column {field.name}")
        common = _common_type(field.dataType, other.dataType)
        left.append(_as(field, common, field.name))
        right.append(_as(other, common, field.name))
    known = skip | {f.name.upper() for f in source.schema.fields}
    more = [f.name for f in target.schema.fields if f.name.upper() not in known]
    if more:
        raise ValueError(f"source has no column {', '.join(more)}")
    return left, right


def _as(field: T.StructField, dtype: T.DataType | None, name: str) -> str:
    value = quoted(field.name)
    if dtype is None:
        value = number_text(value, field.dataType)
    elif field.dataType != dtype:
        value = f"CAST({value} AS {dtype.simpleString()})"
    return f"{value} AS {quoted(name)}"


def _common_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """A type that holds the values of both; None for numbers that only text holds exactly."""
    if a == b:
        return a
    if isinstance(a, T.BooleanType) and isinstance(b, T.NumericType):
        return b
    if isinstance(b, T.BooleanType) and isinstance(a, T.NumericType):
        return a
    if isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        if any(isinstance(t, (T.FloatType, T.DoubleType)) for t in (a, b)):
            # A double holds every int and float, but not every bigint or decimal.
            return None if any(isinstance(t, (T.LongType, T.DecimalType)) for t in (a, b)) else T.DoubleType()
        (whole_a, scale_a), (whole_b, scale_b) = _digits(a), _digits(b)
        scale = max(scale_a, scale_b)
        digits = max(whole_a, whole_b) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else None
    if {type(a), type(b)} == {T.DateType, T.TimestampNTZType}:
        return T.TimestampNTZType()
    if {type(a), type(b)} <= {T.DateType, T.TimestampNTZType, T.TimestampType}:
        return T.TimestampType()
    return T.StringType()


def _digits(dtype: T.DataType) -> tuple[int, int]:
    """Digits before and after the point; whole numbers have up to 19."""
    if isinstance(dtype, T.DecimalType):
        return dtype.precision - dtype.scale, dtype.scale
    return 19, 0


def signed_rows(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Every distinct row of both sides with its number of copies on each."""
    left, right = aligned(source, target, exclude)
    if {SOURCE_COPIES, TARGET_COPIES} & {c.lower() for c in source.columns}:
        raise ValueError(f"rename columns {SOURCE_COPIES} and {TARGET_COPIES}, which the comparison uses itself")
    ours = source.selectExpr(*left, f"1 AS {SOURCE_COPIES}", f"0 AS {TARGET_COPIES}")
    theirs = target.selectExpr(*right, f"0 AS {SOURCE_COPIES}", f"1 AS {TARGET_COPIES}")
    return ours.unionAll(theirs).groupBy(*map(quoted, ours.columns[:-2])).agg(
        F.sum(SOURCE_COPIES).alias(SOURCE_COPIES), F.sum(TARGET_COPIES).alias(TARGET_COPIES)
    )


def surplus_rows(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The rows whose copies differ in number. Feed it to the functions below."""
    return signed_rows(source, target, exclude).filter(F.col(SOURCE_COPIES) != F.col(TARGET_COPIES))


def diff_multiset(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Rows with their surplus: positive where the source has more copies.

    Complete for every table, with a key, without one, or with a key that repeats.
    """
    rows = surplus_rows(source, target, exclude)
    return rows.withColumn("surplus", F.col(SOURCE_COPIES) - F.col(TARGET_COPIES)).drop(
        SOURCE_COPIES, TARGET_COPIES
    )


def _actual(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names as the frame spells them; catalogs often give them in upper case."""
    by_name = {c.upper(): c for c in df.columns}
    return [by_name[n.upper()] for n in names]


def pair_by_key(surplus: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Surplus rows gathered by key, with one row of each side and the status of the key.

    ``changed``: one row on each side, so cells can be compared. ``ambiguous``: rows on
    both sides and more than one on at least one of them, so no pairing is right; the
    rows themselves are all in ``diff_multiset``.
    """
    keys = _actual(surplus, keys)
    used = {"status", "missing_rows", "extra_rows", "source_row", "target_row", "column_name"}
    taken = {k for k in keys if k.lower() in used}
    if taken:
        raise ValueError(f"rename key columns {sorted(taken)}, which the result uses itself")
    missing = F.col(SOURCE_COPIES) - F.col(TARGET_COPIES)
    values = [c for c in surplus.columns if c not in (*keys, SOURCE_COPIES, TARGET_COPIES)]
    # A table of key columns only has one cell to compare, which is always equal.
    row = F.expr(f"struct({', '.join(map(quoted, values))})" if values else "named_struct('_', '')")
    paired = surplus.groupBy(*map(quoted, keys)).agg(
        F.sum(F.greatest(missing, F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(-missing, F.lit(0))).alias("extra_rows"),
        F.first(F.when(missing > 0, row), ignorenulls=True).alias("source_row"),
        F.first(F.when(missing < 0, row), ignorenulls=True).alias("target_row"),
    )
    status = (
        F.when(F.col("extra_rows") == 0, MISSING)
        .when(F.col("missing_rows") == 0, EXTRA)
        .when((F.col("missing_rows") == 1) & (F.col("extra_rows") == 1), CHANGED)
        .otherwise(AMBIGUOUS)
    )
    return paired.withColumn("status", status)


def cells_of(surplus: DataFrame, keys: Sequence[str], names: Mapping[str, str] | None = None) -> DataFrame:
    """One row per differing cell of the keys that have one row on each side.

    ``names`` gives the names to report for columns that go by others in the frame.
    """
    pairs = pair_by_key(surplus, keys).filter(F.col("status") == CHANGED)
    cells = []
    for c in pairs.schema["source_row"].dataType.names:
        left, right = f"source_row.{quoted(c)}", f"target_row.{quoted(c)}"
        cells.append(
            f"named_struct('column_name', {literal((names or {}).get(c, c))}, 'source_value', CAST({left} AS string), "
            f"'target_value', CAST({right} AS string), 'differs', NOT ({left} <=> {right}))"
        )
    differing = f"inline(filter(array({', '.join(cells)}), cell -> cell.differs))"
    return pairs.selectExpr(*map(quoted, _actual(surplus, keys)), differing).drop("differs")


def diff_cells(
    source: DataFrame, target: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Differing cells: key columns, column_name, source_value, target_value."""
    return cells_of(surplus_rows(source, target, exclude), keys)


def diff_keys(surplus: DataFrame, keys: Sequence[str], *statuses: str) -> DataFrame:
    """Keys with differences, their status and the number of surplus rows per side."""
    pairs = pair_by_key(surplus, keys).select(*map(quoted, _actual(surplus, keys)), "status", "missing_rows", "extra_rows")
    return pairs.filter(F.col("status").isin(*statuses)) if statuses else pairs


def diff_missing_extra(
    source: DataFrame, target: DataFrame, keys: Sequence[str], exclude: Sequence[str] = ()
) -> DataFrame:
    """Keys with rows left over on one side only."""
    return diff_keys(surplus_rows(source, target, exclude), keys, MISSING, EXTRA)


def summarize_cells(cells: DataFrame) -> DataFrame:
    """Mismatches per column. Which rows they are in is the complete list, ``cells`` itself."""
    return cells.groupBy("column_name").agg(F.count(F.lit(1)).alias("mismatches"))


def key_text(keys: Sequence[str]) -> Column:
    """The values of a key as one text, different for different keys."""
    values = ", ".join(f"CAST({quoted(k)} AS string)" for k in keys)
    return F.expr(f"to_json(array({values}))")


# Copies of one row that are written out together, and rows that one task places or writes out.
COPIES_PER_BLOCK = 100_000
ROWS_PER_TASK = 1_000_000


def with_ordinals(
    df: DataFrame, order_by: Sequence[str] = (), name: str = "row_number", ties: bool = True
) -> DataFrame:
    """Number the rows from 1 without putting them all into one task.

    Rows are range-partitioned and sorted by ``order_by``, which should be a total order;
    without it the order the frame already has is kept. The placed rows are written to
    scratch because both the count per partition and the numbering must see one and the
    same placement, also after an executor was lost.

    Rows that tie are ordered by a hash of their content, so that no value of ``order_by``, however
    frequent, has to stay in one partition. Copies of one row tie in that as well; it does not
    matter which of them gets which number. Rows whose copies would fill a quarter of a partition
    are known from a count of the hashes; each of them is placed once, takes as many numbers as it
    has copies, and becomes its copies again at the end, in blocks that are dealt to as many tasks as
    there are rows for. A caller who knows that no rows tie, as ``key_profile`` tells, says so
    with ``ties``: the count is saved.
    """
    columns = list(map(quoted, df.columns))
    copies = F.lit(1).cast("bigint").alias("_copies")
    if not order_by:
        placed = df.select("*", copies)
    elif not ties:
        order = list(map(quoted, order_by))
        placed = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", copies)
    else:
        order = [*map(quoted, order_by), "_hash"]
        hashed = df.withColumn("_hash", F.expr(f"xxhash64({', '.join(columns)})"))
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        count = df.count()
        # Bytes tell little of rows that repeat, as these compress very well.
        tasks = max(parts, min(MOST_TASKS, count // ROWS_PER_TASK))
        most = max(1, count // (4 * tasks))
        frequent = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
        frequent = write_through(frequent.select("_hash"), "frequent")  # four a partition at most
        rows = hashed.withColumn("_copies", copies)
        if frequent.head(1):
            many = hashed.join(F.broadcast(frequent), "_hash", "left_semi")
            many = many.groupBy(*columns, "_hash").agg(F.count(F.lit(1)).alias("_copies"))
            rows = rows.join(F.broadcast(frequent), "_hash", "left_anti").select(*columns, "_hash", "_copies").unionByName(many)
        # Adaptive execution may join the tasks of a small table only.
        placed = rows.repartitionByRange(tasks, *order) if count > ROWS_PER_TASK else rows.repartitionByRange(*order)
        placed = placed.sortWithinPartitions(*order).select(*columns, "_copies")
    placed = write_through(placed.withColumn("_place", F.monotonically_increasing_id()), "ordinals")
    part = F.shiftright("_place", 33)
    position = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    # One row per written partition, so both the window and the broadcast are small, as are the
    # lists of rows of many copies in a partition.
    repeated = F.when(F.col("_copies") > 1, F.struct(position.alias("at"), (F.col("_copies") - 1).alias("more")))
    per_part = placed.groupBy(part.alias("_part")).agg(F.sum("_copies").alias("_rows"), F.collect_list(repeated).alias("_repeated"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("_part", "_repeated", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    passed = "aggregate(filter(_repeated, r -> r.at < _position), 0L, (n, r) -> n + r.more)"
    numbered = placed.withColumns({"_part": part, "_position": position}).join(F.broadcast(offsets), "_part")
    numbered = numbered.select(*columns, "_copies", (F.col("_offset") + F.col("_position") + F.expr(passed) + 1).alias(name))
    if not (order_by and ties):
        return numbered.drop("_copies")
    once = numbered.filter("_copies = 1").drop("_copies")
    blocks = numbered.filter("_copies > 1").withColumn("_from", F.explode(F.expr(f"sequence(0L, _copies - 1, {COPIES_PER_BLOCK}L)")))
    # A block is one row until its copies are written out: without a number of tasks, adaptive
    # execution would take all of them for the work of one.
    blocks = blocks.repartition(tasks, quoted(name), "_from")
    last = F.least(F.col("_copies"), F.col("_from") + COPIES_PER_BLOCK) - 1
    spread = blocks.withColumn("_at", F.explode(F.sequence("_from", last)))
    return once.unionByName(spread.select(*columns, (F.col(quoted(name)) + F.col("_at")).alias(name)))


def diff_positional(
    source: DataFrame, target: DataFrame, order_by: Sequence[str], name: str = "row_number", ties: bool = True
) -> DataFrame:
    """Differing cells of rows at the same 1-based position in the given total order.

    A position that only the longer side has is one row without a column name; its values are
    those of the whole row, as a JSON array in the order of the columns.
    """
    surplus = surplus_rows(with_ordinals(source, order_by, name, ties), with_ordinals(target, order_by, name, ties))
    rows = pair_by_key(surplus, [name]).filter(F.col("status").isin(MISSING, EXTRA))
    fields = surplus.columns[:-2]

    def whole(row: str) -> str:
        values = ", ".join(f"CAST({row}.{quoted(c)} AS string)" for c in fields if c != name)
        return f"CASE WHEN {row} IS NOT NULL THEN to_json(array({values})) END"

    alone = rows.selectExpr(
        quoted(name), "CAST(NULL AS string) AS column_name",
        f"{whole('source_row')} AS source_value", f"{whole('target_row')} AS target_value",
    )
    return cells_of(surplus, [name]).unionByName(alone)


def differing_totals(source: DataFrame, target: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """One row: the record counts of both sides and the number of surplus rows of each."""
    missing = F.col(SOURCE_COPIES) - F.col(TARGET_COPIES)
    totals = signed_rows(source, target, exclude).agg(
        F.sum(SOURCE_COPIES).alias("source_record_count"),
        F.sum(TARGET_COPIES).alias("target_record_count"),
        F.sum(F.greatest(missing, F.lit(0))).alias("missing_rows"),
        F.sum(F.greatest(-missing, F.lit(0))).alias("extra_rows"),
    )
    return totals.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in totals.columns])
