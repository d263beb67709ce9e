"""Whether the documents of a column are well-formed XML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcile.functions import quoted, well_formed_xml, xml_variant

# Fixed value: what stands for every document of a column in which all are well-formed.
VALID = "VALID"


def check_xml(df: DataFrame, column: str, flag: str = "is_valid") -> DataFrame:
    return df.withColumn(flag, F.expr(well_formed_xml(quoted(column))))


def xml_totals(df: DataFrame, column: str) -> DataFrame:
    """One row: documents, malformed documents, and whether all are well-formed."""
    valid = F.expr(well_formed_xml(quoted(column)))
    bad = F.count_if(~valid)
    return df.agg(
        F.count(quoted(column)).alias("documents"), bad.alias("malformed"), (bad == 0).alias("all_valid")
    )


def valid_columns(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` of which every document, on both sides, is well-formed.

    One job reads both sides and brings back one row. Names match in any case; a column that a
    side does not have is not valid.
    """
    if not columns:
        return []
    sides = []
    for side in (source, target):
        names = {c.upper(): c for c in side.columns}
        own = [names.get(c.upper()) for c in columns]
        bad = [F.lit(1) if c is None else F.count_if(~F.expr(well_formed_xml(quoted(c)))) for c in own]
        sides.append(side.agg(*[b.cast("bigint").alias(f"c{i}") for i, b in enumerate(bad)]))
    counts = sides[0].unionAll(sides[1]).agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(columns))]).first()
    return [c for c, n in zip(columns, counts, strict=True) if n == 0]


def with_valid_columns(source: DataFrame, target: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``VALID`` for every document of the columns in which all are well-formed.

    Other columns keep their text on both sides, so that a malformed document makes its column be
    compared as it is. A missing document stays NULL: one that was lost on the way still differs.
    """
    reduced = {c.upper() for c in valid_columns(source, target, columns)}

    def side(df: DataFrame) -> DataFrame:
        return df.selectExpr(
            *[
                f"CASE WHEN {quoted(c)} IS NOT NULL THEN '{VALID}' END AS {quoted(c)}" if c.upper() in reduced else quoted(c)
                for c in df.columns
            ]
        )

    return side(source), side(target)


def with_variant(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add the documents of ``column`` as VARIANT values; NULL where they are not well-formed."""
    whole = f"CASE WHEN {well_formed_xml(quoted(column))} THEN {xml_variant(quoted(column))} END"
    return df.withColumn(name, F.expr(whole))
