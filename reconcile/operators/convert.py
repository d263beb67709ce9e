"""Convert source rows to the types of the target."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from reconcile.functions import NULL_TOKENS, flag_to_int, null_tokens, quoted, scrub_carriage_returns
from reconcile.operators.frames import in_any_case


def convert(
    df: DataFrame,
    source_types: Mapping[str, str],
    spark_types: Mapping[str, str] | None = None,
    tokens: Sequence[str] = NULL_TOKENS,
) -> DataFrame:
    """Scrub XML, turn flags into 0/1, remove null tokens, and cast to the mapped types.

    ``source_types`` are the declared types by column; ``spark_types`` the types to load.
    Text that does not cast becomes NULL here. To have it rejected instead, give no
    ``spark_types`` and load the rows with ``check_rows``. ``tokens`` are the texts that stand
    for NULL; give none to move such texts as they are. Names match in any case, and one that
    ``df`` does not have is an error.
    """
    fields = {f.name: f for f in df.schema.fields}
    declared, loaded = (
        {f.name: kind for f, kind in zip(in_any_case(fields, types).values(), types.values(), strict=True)}
        for types in (source_types, spark_types or {})
    )
    return df.selectExpr(
        *[f"{_converted(f, declared.get(c, '').lower(), loaded.get(c), tokens)} AS {quoted(c)}" for c, f in fields.items()]
    )


def _converted(field: T.StructField, source_type: str, spark_type: str | None, tokens: Sequence[str]) -> str:
    value = quoted(field.name)
    if isinstance(field.dataType, T.StringType):
        value = null_tokens(value, tokens)
        if source_type == "xml":
            value = scrub_carriage_returns(value)
    if source_type == "bit":
        value = flag_to_int(value, field.dataType)
    return f"try_cast({value} AS {spark_type})" if spark_type else value
