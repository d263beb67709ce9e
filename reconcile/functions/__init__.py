from reconcile.functions.values import (
    LOAD_NULL_TOKENS,
    NULL_TOKENS,
    date_only,
    decimal_value,
    flag_to_int,
    is_numeric_text,
    literal,
    null_tokens,
    number_text,
    quoted,
    round_decimal,
    scrub_carriage_returns,
    strip_parentheses,
    time_to_second,
    well_formed_xml,
    xml_variant,
)

__all__ = [
    "LOAD_NULL_TOKENS",
    "NULL_TOKENS",
    "date_only",
    "decimal_value",
    "flag_to_int",
    "is_numeric_text",
    "literal",
    "null_tokens",
    "number_text",
    "quoted",
    "round_decimal",
    "scrub_carriage_returns",
    "strip_parentheses",
    "time_to_second",
    "well_formed_xml",
    "xml_variant",
]
