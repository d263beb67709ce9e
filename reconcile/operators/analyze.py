"""Which tables can be moved as they are, and which objects need manual work."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcile.functions import is_numeric_text, quoted, strip_parentheses
from reconcile.operators.catalog import TABLE
from reconcile.operators.typemap import TYPE_MAP

SUPPORTED_TYPES = tuple(source for source, _, _ in TYPE_MAP)

# Defaults that have a counterpart in the target, after parentheses are gone.
SUPPORTED_DEFAULTS = ("newid", "getdate")

SUCCESS, FAIL, NOT_FOUND = "Success", "Fail", "Not-Found"


def analyze(
    scope: DataFrame,
    catalog: DataFrame,
    types: Sequence[str] = SUPPORTED_TYPES,
    defaults: Sequence[str] = SUPPORTED_DEFAULTS,
) -> DataFrame:
    """One verdict per table in scope, with the types and defaults that stand in the way.

    All tables are judged in one job. The remarks gather the columns of one table, whose
    number the source system limits.
    """
    kind = F.lower("data_type")
    default = F.expr(strip_parentheses("default"))
    numeric = F.expr(is_numeric_text(strip_parentheses("default")))
    flagged = catalog.select(
        *TABLE,
        "ordinal",
        F.when(~kind.isin(*types), F.upper("data_type")).alias("bad_type"),
        F.when(~numeric & ~default.isin(*defaults), default).alias("bad_default"),
    )
    per_table = flagged.groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("_columns"),
        F.count(F.coalesce("bad_type", "bad_default")).alias("_bad"),
        F.expr("listagg(bad_type, ', ') within group (order by ordinal)").alias("_types"),
        F.expr("listagg(bad_default, ', ') within group (order by ordinal)").alias("_defaults"),
    )
    verdict = F.when(F.col("_columns").isNull(), NOT_FOUND).when(F.col("_bad") == 0, SUCCESS).otherwise(FAIL)
    return scope.join(per_table, list(TABLE), "left").select(
        F.col("database").alias("Database"),
        F.col("schema").alias("Schema"),
        F.col("table").alias("Table"),
        verdict.alias("DDL_Migration_Analysis"),
        F.coalesce("_types", F.lit("")).alias("Remark-Unsupported Datatypes"),
        F.coalesce("_defaults", F.lit("")).alias("Remark-Unsupported Default Values"),
    )


def analysis_totals(analysis: DataFrame) -> DataFrame:
    """Number of tables per verdict, in one row."""
    verdict = F.col("DDL_Migration_Analysis")
    return analysis.agg(
        F.count_if(verdict == SUCCESS).alias("pass_tables"),
        F.count_if(verdict == FAIL).alias("failed_tables"),
        F.count_if(verdict == NOT_FOUND).alias("not_found_tables"),
    )


def _nested(depth: int) -> str:
    """A block comment that holds others, to a depth; one that never ends goes to the end."""
    inner = f"|{_nested(depth - 1)}" if depth else ""
    return rf"/\*(?:[^*/]++|\*(?!/)|/(?!\*){inner})*+(?:\*/|\z)"


# What is no code, as one ordered alternation: of two that could begin at a place the first counts,
# so that a quote in a comment opens nothing, nor does a comment's sign in a literal.
NO_CODE = "|".join(
    (
        r"--[^\n]*+",
        _nested(3),
        r"N?'(?:[^']++|'')*+(?:'|\z)",
        r'"(?:[^"]++|"")*+(?:"|\z)',
        r"\[(?:[^\]]++|\]\])*+(?:\]|\z)",
    )
)


def code_only(text: Column) -> Column:
    """The text of an object with a blank for every comment, literal and quoted name."""
    return F.regexp_replace(text, NO_CODE, " ")


def scan_keywords(texts: DataFrame, object_id: str, text: str, keywords: Sequence[str], code: bool = False) -> DataFrame:
    """Hits per object and keyword, over the words of the whole text, in any case.

    With ``code`` the text is that of a database object: comments, literals and quoted names do
    not count.
    """
    return _keyword_hits(texts, object_id, text, keywords, code).filter(F.col("keyword").isNotNull())


def keyword_verdict(texts: DataFrame, object_id: str, text: str, keywords: Sequence[str], code: bool = False) -> DataFrame:
    """Every object with its hits and whether it converts as it is.

    The remark gathers distinct keywords, so it is no longer than the keyword list.
    """
    hits = _keyword_hits(texts, object_id, text, keywords, code)
    per_object = hits.groupBy(quoted(object_id)).agg(
        F.count("keyword").alias("keywords"),
        F.coalesce(F.sum(F.when(F.col("keyword").isNotNull(), F.col("hits"))), F.lit(0)).alias("hits"),
        F.expr("listagg(keyword, ', ') within group (order by keyword)").alias("remark"),
    )
    return per_object.select(
        quoted(object_id),
        F.when(F.col("keywords") == 0, "converts").otherwise("needs work").alias("verdict"),
        "keywords",
        "hits",
        F.coalesce("remark", F.lit("")).alias("remark"),
    )


def _keyword_hits(texts: DataFrame, object_id: str, text: str, keywords: Sequence[str], code: bool) -> DataFrame:
    """Counts per object and keyword, and one row with a NULL keyword for objects without any.

    Plain words are found among the words of the text. A keyword of several words, or with other
    signs, is looked for in the text itself, with any white space between its words and no
    letter, digit or underscore right beside it.
    """
    wanted = sorted({" ".join(k.lower().split()) for k in keywords})
    if "" in wanted:
        raise ValueError("a keyword is empty")
    plain = [k for k in wanted if re.fullmatch("[a-z0-9_]+", k)]
    whole = F.col(quoted(text))
    low = F.lower(code_only(whole) if code else whole)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))
    found = F.filter(words, lambda word: word.isin(*plain))
    for keyword in wanted:
        if keyword not in plain:
            hits = F.size(F.regexp_extract_all(low, F.lit(_pattern(keyword)), F.lit(0)))
            found = F.concat(found, F.array_repeat(F.lit(keyword), F.greatest(hits, F.lit(0))))
    return (
        texts.select(F.col(quoted(object_id)), F.explode_outer(found).alias("keyword"))
        .groupBy(quoted(object_id), "keyword")
        .agg(F.count(F.lit(1)).alias("hits"))
    )


def _pattern(keyword: str) -> str:
    parts = r"\s+".join("".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in word) for word in keyword.split())
    before = r"(?<![a-z0-9_])" if keyword[0].isalnum() or keyword[0] == "_" else ""
    after = r"(?![a-z0-9_])" if keyword[-1].isalnum() or keyword[-1] == "_" else ""
    return before + parts + after
