"""Small helpers over whole frames."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def condition_of(error: Exception) -> str:
    """A short name for any error, for a report."""
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    return condition or type(error).__name__


Found = TypeVar("Found")


def in_any_case(known: Mapping[str, Found], names: Iterable[str]) -> dict[str, Found]:
    """What ``known`` has for each of ``names``, whatever their case; an unknown name is an error."""
    by_name = {k.upper(): v for k, v in known.items()}
    unknown = [n for n in names if n.upper() not in by_name]
    if unknown:
        raise ValueError(f"no column {', '.join(unknown)}")
    return {n: by_name[n.upper()] for n in names}
