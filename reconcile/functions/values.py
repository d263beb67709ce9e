"""SQL expressions for single values. They take and return SQL text.

Tables to move have hundreds of columns, and text makes one call of a whole select list.
All expressions are built-in functions, so they stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import types as T

# Texts that stand for NULL when two sides are compared.
NULL_TOKENS = ("", "NULL")

# Texts that stand for NULL in a staged file.
LOAD_NULL_TOKENS = ("NULL", "NUL", "")

# A plain decimal number, with optional sign and exponent.
NUMERIC_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"

# The character reference that XML writers put for a carriage return.
CARRIAGE_RETURN_REFERENCE = "&#x0D;"

CLOCK_TEXT = r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"

# A date, with at most a midnight after it.
DATE_TEXT = r"^\s*\d{4}-\d{1,2}-\d{1,2}([ T]00:00(:00(\.0+)?)?)?\s*$"

# The element that a document is put into to be checked; no document may close it.
XML_WRAPPER = "reconcile_document"

# The field of a parsed document for text that is no element's alone; no element has such a name.
XML_TEXT = "#text"

# Bytes of a document that is parsed into one value, of which Spark allows 128 MB.
XML_VALUE_BYTES = 64 << 20

# A reference to an entity that is not one of XML's own five.
XML_OWN_ENTITY = r"&(?!(?:amp|lt|gt|quot|apos);)[A-Za-z_:][A-Za-z0-9_:.-]*;"

# What may stand before the root of an XML document and is no part of it.
XML_PROLOG = r"^\s*(<\?xml[^>]*\?>)?\s*(<!DOCTYPE[^>\[]*(\[[^\]]*\])?\s*>)?"


def quoted(name: str) -> str:
    """A column name as SQL."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A text value as SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def null_tokens(value: str, tokens: Sequence[str] = NULL_TOKENS) -> str:
    """The value, or NULL where it is one of ``tokens``."""
    if not tokens:
        return value
    return f"CASE WHEN {value} NOT IN ({', '.join(map(literal, tokens))}) THEN {value} END"


def scrub_carriage_returns(value: str) -> str:
    return f"replace({value}, {literal(CARRIAGE_RETURN_REFERENCE)}, ' ')"


def flag_to_int(value: str, dtype: T.DataType) -> str:
    """True/false as 1/0. Text keeps its type, and stays as it is where it is no flag."""
    flag = f"coalesce(try_cast({value} AS int), CAST(try_cast({value} AS boolean) AS int))"
    if isinstance(dtype, T.StringType):
        return f"coalesce(CAST({flag} AS string), {value})"
    return flag


def date_only(value: str, dtype: T.DataType) -> str:
    """The date. Text becomes the date's one spelling, and stays as it is where it is no date."""
    if isinstance(dtype, T.StringType):
        return f"coalesce(CAST(CASE WHEN {value} RLIKE r'{DATE_TEXT}' THEN try_cast({value} AS date) END AS string), {value})"
    return f"CAST({value} AS date)"


def time_to_second(value: str) -> str:
    """``HH:mm:ss`` without the fraction; text that is no time stays as it is."""
    text = f"CAST({value} AS string)"
    clock = f"split_part({text}, '.', 1)"
    return f"CASE WHEN {clock} RLIKE r'{CLOCK_TEXT}' THEN {clock} ELSE {text} END"


def decimal_value(value: str, dtype: T.DataType, scale: int) -> str:
    """The number in the one spelling it has at a fixed scale; no digit is rounded off.

    Whole numbers and decimals that fit the scale become decimals. Other values become
    text: the number's spelling if the scale holds all its digits, or else the value as it
    is, so that it differs from NULL and from every shorter number. Two numbers are equal
    only in one type, as comparing decimals of two types may round the longer one.
    """
    if isinstance(dtype, T.IntegralType):
        return f"CAST({value} AS decimal(38,{scale}))"
    if isinstance(dtype, T.DecimalType) and dtype.scale <= scale <= 38 - dtype.precision + dtype.scale:
        return f"CAST({value} AS decimal(38,{scale}))"
    number = f"try_cast({value} AS decimal(38,{scale}))"
    if isinstance(dtype, T.StringType):
        # Plain numbers are told by their digits; those with an exponent by their value.
        plain = f"{value} RLIKE r'^[+-]?\\d+(\\.\\d{{0,{scale}}}0*)?$'"
        finer = f"decimal(38,{max(scale, 18)})"
        exponent = f"({value} RLIKE '[eE]' AND try_cast({number} AS {finer}) = try_cast({value} AS {finer}))"
        exact = f"({plain} OR {exponent})"
    elif isinstance(dtype, T.DecimalType):
        exact = f"try_cast({number} AS {dtype.simpleString()}) = {value}"
    else:
        exact = f"CAST({number} AS double) = {value}"
    return f"CASE WHEN {number} IS NOT NULL AND {exact} THEN CAST({number} AS string) ELSE CAST({value} AS string) END"


def round_decimal(value: str, dtype: T.DataType) -> str:
    """Decimals as doubles with two places; other types are left alone."""
    if isinstance(dtype, T.DecimalType):
        return f"round(CAST({value} AS double), 2)"
    return value


def is_numeric_text(value: str) -> str:
    return f"{value} RLIKE r'{NUMERIC_TEXT}'"


def strip_parentheses(value: str) -> str:
    return f"regexp_replace({value}, '[()]', '')"


def well_formed_xml(value: str) -> str:
    """True for NULL and for a well-formed document: one root, and no text beside it.

    One parse decides. The parser stops at the end of the first element, so the document is put
    into one of its own, which then must hold one element, and no text. A document too large to
    be parsed into one value is parsed for its form alone, and its root is looked for by paths.
    """
    parsed = f"try_variant_get({xml_variant(value)}, '$', 'map<string,variant>')"
    alone = (
        f"m IS NOT NULL AND size(m) = 1 AND NOT map_contains_key(m, '{XML_TEXT}') "
        "AND try_variant_get(map_values(m)[0], '$[1]', 'variant') IS NULL"
    )
    # The list of one element makes the parse run once for all that is asked of it.
    small = f"element_at(transform(array({parsed}), m -> {alone}), 1)"
    closes = f"contains({value}, '</{XML_WRAPPER}')"
    large = f"octet_length({value}) > {XML_VALUE_BYTES}"
    return f"CASE WHEN {value} IS NULL THEN true WHEN {closes} THEN false WHEN {large} THEN {_one_root_by_path(value)} ELSE {small} END"


def xml_variant(value: str) -> str:
    """A document as a VARIANT with its root's name at the top; NULL where it is not well-formed.

    Elements are fields, repeated ones arrays, attributes fields with ``_`` before their name, and
    text beside elements or attributes is the field ``#text``. Text that is a number or a
    truth value becomes one.
    """
    options = f"map('singleVariantColumn', 'v', 'valueTag', '{XML_TEXT}', 'mode', 'PERMISSIVE')"
    return f"(from_xml({_wrapped(value)}, 'v variant', {options})).v"


def _wrapped(value: str) -> str:
    """The document, without what may stand before its root, in an element of its own."""
    body = (
        f"CASE WHEN contains({value}, '<?xml') OR contains({value}, '<!DOCTYPE') "
        f"THEN regexp_replace({value}, r'{XML_PROLOG}', '') ELSE {value} END"
    )
    # Entities that a document declares itself go with the declaration.
    body = f"CASE WHEN contains({value}, '<!ENTITY') THEN regexp_replace({body}, r'{XML_OWN_ENTITY}', ' ') ELSE {body} END"
    return f"concat('<{XML_WRAPPER}>', {body}, '</{XML_WRAPPER}>')"


def _one_root_by_path(value: str) -> str:
    root, wrapped = XML_WRAPPER, _wrapped(value)
    parsed = f"(from_xml({wrapped}, '_corrupt_record string', map('mode', 'PERMISSIVE')))._corrupt_record IS NULL"
    one = f"xpath_boolean({wrapped}, 'count(/{root}/*) = 1 and count(/{root}/text()[normalize-space()]) = 0')"
    return f"CASE WHEN {parsed} THEN {one} ELSE false END"


def number_text(value: str, dtype: T.DataType) -> str:
    """The number's digits as text, alike for equal numbers of any type.

    A whole or decimal number has all its digits, a binary one those that tell it from its
    neighbours.
    """
    text = f"CAST({value} AS string)"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        exact = f"try_cast({text} AS decimal(38,18))"
        kept = f"CAST({exact} AS {dtype.simpleString()}) = {value}"
        text = f"CASE WHEN {exact} IS NOT NULL AND {kept} THEN CAST({exact} AS string) ELSE {text} END"
    # A decimal of many places is written with an exponent where it is zero.
    plain = rf"regexp_replace(regexp_replace({text}, r'^(-?)0E-\d+$', '0'), r'(\.\d*?)0+$', '$1')"
    return rf"regexp_replace(regexp_replace({plain}, r'\.$', ''), '^-0$', '0')"
