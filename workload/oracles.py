"""The same results as plain SQL, written for a second engine."""

from __future__ import annotations

from reconcile.operators.typemap import TYPE_MAP
from workload.planted import planted_sql
from workload.queries import CASES, KEYWORDS


def _with(*names: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({planted_sql(n)})" for n in names)


_CLEAN = "nullif(nullif({0}, ''), 'NULL')"

_ORDERS = (
    _with("src_orders", "tgt_orders")
    + f""",
s AS (SELECT o_orderkey, o_custkey, {_CLEAN.format('o_orderstatus')} AS o_orderstatus, o_totalprice, o_orderdate,
             {_CLEAN.format('o_orderpriority')} AS o_orderpriority FROM src_orders),
t AS (SELECT o_orderkey, o_custkey, {_CLEAN.format('o_orderstatus')} AS o_orderstatus, o_totalprice, o_orderdate,
             {_CLEAN.format('o_orderpriority')} AS o_orderpriority FROM tgt_orders)"""
)

_ORDER_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")

_CELLS = " UNION ALL ".join(
    f"""SELECT s.o_orderkey, '{c}' AS column_name, CAST(s.{c} AS VARCHAR) AS source_value,
               CAST(t.{c} AS VARCHAR) AS target_value
        FROM s JOIN t ON s.o_orderkey = t.o_orderkey WHERE s.{c} IS DISTINCT FROM t.{c}"""
    for c in _ORDER_COLUMNS
)

_LINE_VALUES = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate",
)

# Rows of lineitem left over on either side, then keys with one such row on each side.
_LINES = (
    _with("taxed_lineitem")
    + """,
gone AS (SELECT * FROM lineitem EXCEPT ALL SELECT * FROM taxed_lineitem),
come AS (SELECT * FROM taxed_lineitem EXCEPT ALL SELECT * FROM lineitem),
keys AS (SELECT l_orderkey, l_linenumber, CAST(sum(m) AS BIGINT) AS missing_rows, CAST(sum(e) AS BIGINT) AS extra_rows
         FROM (SELECT l_orderkey, l_linenumber, 1 AS m, 0 AS e FROM gone
               UNION ALL SELECT l_orderkey, l_linenumber, 0, 1 FROM come) GROUP BY ALL)"""
)

_LINE_CELLS = " UNION ALL ".join(
    f"""SELECT l_orderkey, l_linenumber, '{c}' AS column_name, CAST(gone.{c} AS VARCHAR) AS source_value,
               CAST(come.{c} AS VARCHAR) AS target_value
        FROM keys JOIN gone USING (l_orderkey, l_linenumber) JOIN come USING (l_orderkey, l_linenumber)
        WHERE missing_rows = 1 AND extra_rows = 1 AND gone.{c} IS DISTINCT FROM come.{c}"""
    for c in _LINE_VALUES
)

_UNPAIRED = """
        SELECT o_orderkey, 'missing_in_target' AS status, CAST(1 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows
        FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey)
        UNION ALL SELECT o_orderkey, 'extra_in_target', 0, 1
        FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE t.o_orderkey = s.o_orderkey)"""

_OBJECTS = """WITH hits AS (
    SELECT o_orderkey AS object_id, 'merge' AS keyword, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS hits FROM orders
    UNION ALL SELECT o_orderkey, 'goto', CASE WHEN o_orderkey % 13 = 0 THEN 2 ELSE 0 END FROM orders
    UNION ALL SELECT o_orderkey, 'cursor', CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END FROM orders) """

_TYPES = "(VALUES " + ", ".join(f"('{s}', '{t}', '{k}')" for s, t, k in TYPE_MAP) + ") AS m(source_type, target_type, spark_type)"

_RENDERED = """CASE
    WHEN c.data_type = 'bit' THEN 'NUMBER(1,0)'
    WHEN c.data_type IN ('money', 'smallmoney', 'float') THEN 'FLOAT'
    WHEN c.data_type = 'date' THEN 'DATE'
    WHEN c.data_type = 'xml' THEN 'VARIANT'
    WHEN c.data_type = 'binary' THEN 'BINARY(8388608)'
    WHEN c.data_type = 'uniqueidentifier' THEN 'VARCHAR(16777216)'
    WHEN m.target_type = 'NUMBER' THEN 'NUMBER(' || c.length || ',' || c.scale || ')'
    WHEN m.target_type = 'VARCHAR' AND c.length <= 0 THEN 'VARCHAR(16777216)'
    WHEN c.length < 0 THEN c.data_type
    ELSE coalesce(m.target_type, c.data_type) || '(' || c.length || ')' END"""

_MAPPED = f"""SELECT c.*, coalesce(m.target_type, c.data_type) AS target_type, {_RENDERED} AS rendered_type,
    CASE WHEN m.spark_type = 'decimal' THEN 'decimal(' || c.length || ',' || c.scale || ')'
         ELSE coalesce(m.spark_type, 'string') END AS spark_type
    FROM catalog c LEFT JOIN {_TYPES} ON lower(c.data_type) = m.source_type"""

_SUPPORTED = ", ".join(f"'{s}'" for s, _, _ in TYPE_MAP)

_ANALYSIS = _with("catalog", "scope") + f""",
flagged AS (SELECT *, CASE WHEN lower(data_type) NOT IN ({_SUPPORTED}) THEN upper(data_type) END AS bad_type,
                   regexp_replace("default", '[()]', '', 'g') AS d FROM catalog),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(d, '^\\s*[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?\\s*$')
                           AND d NOT IN ('newid', 'getdate') THEN d END AS bad_default FROM flagged),
analysis AS (
SELECT s.database AS "Database", s.schema AS "Schema", s."table" AS "Table",
       CASE WHEN count(j."column") = 0 THEN 'Not-Found'
            WHEN count(bad_type) + count(bad_default) = 0 THEN 'Success' ELSE 'Fail' END AS "DDL_Migration_Analysis",
       coalesce(string_agg(bad_type, ', ' ORDER BY ordinal), '') AS "Remark-Unsupported Datatypes",
       coalesce(string_agg(bad_default, ', ' ORDER BY ordinal), '') AS "Remark-Unsupported Default Values"
FROM scope s LEFT JOIN judged j ON s."table" = j."table" GROUP BY ALL)"""

_SCHEMA = _with("catalog", "actual") + f""",
mapped AS ({_MAPPED}),
comparison AS (
SELECT coalesce(e.database, a.database) || '.' || coalesce(e.schema, a.schema) || '.' || coalesce(e."table", a."table")
           AS Table_name,
       coalesce(upper(e."column"), upper(a."column")) AS column_name, e.data_type AS SQL_Datatype,
       a.type AS Snowflake_Datatype, e.rendered_type AS Final_Data_types,
       CASE WHEN e."column" IS NOT NULL AND a."column" IS NOT NULL THEN 'True' ELSE 'False' END AS COLUMN_COMPAR,
       CASE WHEN e.rendered_type = a.type THEN 'True' ELSE 'False' END AS COLUMN_AND_LEN_COMPAR,
       CASE WHEN e.ordinal = a.ordinal THEN 'True' ELSE 'False' END AS ORDINAL_COMPAR
FROM mapped e FULL JOIN (SELECT * REPLACE (lower("table") AS "table") FROM actual) a ON e."table" = a."table" AND upper(e."column") = upper(a."column"))"""

_NUMBER = "TRY_CAST(nullif(nullif(nullif({0}, 'NULL'), 'NUL'), '') AS {1})"
_FILLED = "coalesce({0}, '') NOT IN ('NULL', 'NUL', '')"
_LOADED = {"o_orderkey": "BIGINT", "o_totalprice": "DOUBLE", "o_orderdate": "DATE"}
_SPARK_NAMES = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "date"}
_BAD = {c: f"({_FILLED.format(c)} AND {_NUMBER.format(c, t)} IS NULL)" for c, t in _LOADED.items()}
_ANY_BAD = " OR ".join(_BAD.values())

_GOOD = _with("raw_orders") + " SELECT " + ", ".join(
    f"CAST({_NUMBER.format(c, t)} AS {'VARCHAR' if t == 'DATE' else t}) AS {c}" for c, t in _LOADED.items()
) + f" FROM raw_orders WHERE NOT ({_ANY_BAD})"

_REJECTS = _with("raw_orders") + " " + " UNION ALL ".join(
    f"""SELECT _row AS row_number, o_orderkey || ',' || o_totalprice || ',' || o_orderdate AS rejected_record,
               '{c}' AS column_name, 'conversion' AS category, 'value of {c} is no {_SPARK_NAMES[c]}' AS error
        FROM raw_orders WHERE {bad}"""
    for c, bad in _BAD.items()
)

_FIRST = "CASE " + " ".join(f"WHEN {bad} THEN '{c}'" for c, bad in _BAD.items()) + " END"
_FIRST_ERROR = "CASE " + " ".join(
    f"WHEN {bad} THEN 'value of {c} is no {_SPARK_NAMES[c]}'" for c, bad in _BAD.items()
) + " END"

_LOAD_RESULT = _with("raw_orders") + f""",
r AS (SELECT *, ({_ANY_BAD}) AS bad, {_FIRST} AS bad_column, {_FIRST_ERROR} AS error FROM raw_orders)
SELECT CASE WHEN count(*) FILTER (bad) = 0 THEN 'LOADED' WHEN count(*) FILTER (NOT bad) = 0 THEN 'LOAD_FAILED'
            ELSE 'PARTIALLY_LOADED' END AS status,
       count(*) AS rows_parsed, count(*) FILTER (NOT bad) AS rows_loaded, count(*) AS error_limit,
       count(*) FILTER (bad) AS errors_seen,
       arg_min(error, _row) FILTER (bad) AS first_error, min(_row) FILTER (bad) AS first_error_line,
       arg_min(bad_column, _row) FILTER (bad) AS first_error_column_name
FROM r"""

_NORMALIZED = _with("spelled_orders") + """
SELECT o_orderkey, nullif(nullif(status, ''), 'NULL') AS status,
       CASE WHEN day IN ('2024-13-45', 'no day') THEN day ELSE left(day, 10) END AS day,
       CASE WHEN regexp_matches(split_part(clock, '.', 1), '^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$')
            THEN split_part(clock, '.', 1) ELSE clock END AS clock,
       coalesce(CAST(TRY_CAST(price AS DECIMAL(18,4)) AS VARCHAR), price) AS price, CAST(flag AS INTEGER) AS flag
FROM spelled_orders"""

_WORDS = "(VALUES " + ", ".join(f"('{k}')" for k in KEYWORDS) + ") AS k(keyword)"
_HITS = f"""SELECT doc_id, w.keyword, count(*) AS hits
    FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z0-9_]+')) AS keyword FROM documents) w
    JOIN {_WORDS} ON w.keyword = k.keyword GROUP BY ALL"""


def _profile(column: str, ordinal: int, dtype: str, text: bool) -> str:
    value = _CLEAN.format(column) if text else column
    return f"""SELECT {ordinal} AS ordinal, '{column}' AS column_name, '{dtype}' AS data_type, count(*) AS row_count,
        count(*) - count({value}) AS null_count, CAST(max(length(CAST({value} AS VARCHAR))) AS INTEGER) AS max_length,
        CAST(min({value}) AS VARCHAR) AS min_value, CAST(max({value}) AS VARCHAR) AS max_value FROM src_orders"""


_PROFILE = _with("src_orders") + " " + " UNION ALL ".join(
    _profile(*args)
    for args in (
        ("o_orderkey", 1, "bigint", False),
        ("o_custkey", 2, "bigint", False),
        ("o_orderstatus", 3, "string", True),
        ("o_totalprice", 4, "double", False),
        ("o_orderdate", 5, "timestamp_ntz", False),
        ("o_orderpriority", 6, "string", True),
    )
)


def _misfits(column: str, declared: str, value: str, fits: str) -> str:
    return f"""SELECT '{column}' AS column_name, '{declared}' AS declared_type, count({value}) AS checked,
        count(*) FILTER ({value} IS NOT NULL AND NOT ({fits})) AS misfits FROM src_orders"""


_FIT = _with("src_orders") + " " + " UNION ALL ".join(
    (
        _misfits("o_orderkey", "tinyint", "o_orderkey", "TRY_CAST(o_orderkey AS TINYINT) IS NOT NULL"),
        _misfits("o_orderstatus", "varchar(1)", _CLEAN.format("o_orderstatus"), "length(o_orderstatus) <= 1"),
        _misfits("o_orderpriority", "varchar(8)", _CLEAN.format("o_orderpriority"), "length(o_orderpriority) <= 8"),
        _misfits("o_totalprice", "decimal(7,2)", "o_totalprice", "TRY_CAST(o_totalprice AS DECIMAL(7,2)) IS NOT NULL"),
    )
)


def _key(name: str, keys: str, rows: str) -> str:
    nulls = " OR ".join(f"{k} IS NULL" for k in keys.split(","))
    return f"""SELECT '{name}' AS table_name, '{keys}' AS key_columns, CAST(sum(n) AS BIGINT) AS row_count,
        count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated_keys, max(n) AS max_rows_per_key,
        CAST(coalesce(sum(n) FILTER ({nulls}), 0) AS BIGINT) AS null_key_rows,
        count(*) FILTER (n > 1) = 0 AND coalesce(sum(n) FILTER ({nulls}), 0) = 0 AS is_key
        FROM (SELECT {keys}, count(*) AS n FROM {rows} GROUP BY ALL)"""


_PAIRS = (("orders", "src_orders", "tgt_orders"), ("lineitem", "lineitem", "tgt_lineitem"),
          ("customer", "customer", "customer"))

_LINE_ALL = (
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, "
    "l_linestatus, l_shipdate"
)
_LINE_JSON = "to_json([" + ", ".join(f"CAST({c} AS VARCHAR)" for c in _LINE_ALL.split(", ")) + "])"

_BAD_XML = "o_orderkey % 73 <> 0 AND (o_orderkey % 71 = 0 OR o_orderkey % 61 = 0 OR o_orderkey % 59 = 0)"

_DECLARED = " UNION ALL ".join(
    f"""SELECT {i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, count(*) AS row_count,
        count(*) - count({v}) AS null_count, CAST(max(length(CAST({v} AS VARCHAR))) AS INTEGER) AS max_length,
        CAST(min({v}) AS VARCHAR) AS min_value, CAST(max({v}) AS VARCHAR) AS max_value,
        '{t}' AS declared_type, CAST({n} AS INTEGER) AS declared_length,
        '{'NOT NULL' if i == 1 else 'NULL'}' AS is_nullable FROM lineitem"""
    for i, (c, t, n) in enumerate(
        (
            ("l_orderkey", "bigint", 19), ("l_partkey", "bigint", 19), ("l_suppkey", "bigint", 19),
            ("l_linenumber", "int", 19), ("l_quantity", "double", "NULL"), ("l_extendedprice", "double", "NULL"),
            ("l_discount", "double", "NULL"), ("l_tax", "double", "NULL"), ("l_returnflag", "string", 10),
            ("l_linestatus", "string", 10), ("l_shipdate", "timestamp_ntz", 6),
        ),
        start=1,
    )
    for v in (_CLEAN.format(c) if t == "string" else c,)
)

_COUNTS = _with("src_orders", "tgt_orders", "tgt_lineitem") + " " + " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name, (SELECT count(*) FROM {s}) AS source_record_count,
               (SELECT count(*) FROM {t}) AS target_record_count,
               CASE WHEN (SELECT count(*) FROM {s}) = (SELECT count(*) FROM {t}) THEN 'Matched' ELSE 'Not-Matched' END
                   AS result_status"""
    for n, s, t in _PAIRS
) + """ UNION ALL SELECT 'customer', count(*), count(*), 'Matched' FROM supplier
    UNION ALL SELECT 'part', count(*), 0, 'Table does not exist in snowflake' FROM part
    UNION ALL SELECT 'events', count(*), 0, 'Table has no data' FROM events"""


def _left_over(a: str, b: str) -> str:
    return f"(SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b}))"


_REPORT = _ORDERS + f", tgt_lineitem AS ({planted_sql('tgt_lineitem')}) SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{n}' AS table_name,
               CASE WHEN {_left_over(s, t)} + {_left_over(t, s)} = 0 THEN 'Matched' ELSE 'Not-Matched' END AS result_status,
               (SELECT count(*) FROM {s}) AS source_record_count, (SELECT count(*) FROM {t}) AS target_record_count,
               {_left_over(s, t)} AS missing_rows, {_left_over(t, s)} AS extra_rows"""
    for n, s, t in (("orders", "s", "t"), *_PAIRS[1:])
) + """ UNION ALL SELECT 'part', 'Table does not exist in snowflake', count(*), 0, count(*), 0 FROM part
    UNION ALL SELECT 'events', 'Table has no data', count(*), 0, count(*), 0 FROM events)"""


def _case(number: int, left: str, right: str, status: str) -> str:
    case = CASES[number - 1]
    sql = case.sql.replace("'", "''").replace("\r", "' || chr(13) || '")
    return f"""SELECT {number} AS case_no, '{case.table}' AS source_table_name, '{case.table.upper()}' AS target_table_name,
        '{sql}' AS test_case, {left} AS source_table_result, {right} AS target_table_result, {status} AS status"""


def _scalar(number: int, value: str, left: str, right: str) -> str:
    status = f"CASE WHEN (SELECT {value} FROM {left}) = (SELECT {value} FROM {right}) THEN 'PASS' ELSE 'FAIL' END"
    return _case(number, "'1 rows'", "'1 rows'", status)


def _listed(number: int, value: str, left: str, right: str) -> str:
    return f"""SELECT {number} AS case_no, to_json([CAST(v AS VARCHAR)]) AS row_values, CAST(sum(a) AS BIGINT) AS source_copies,
        CAST(sum(b) AS BIGINT) AS target_copies
        FROM (SELECT {value} AS v, 1 AS a, 0 AS b FROM {left} UNION ALL SELECT {value}, 0, 1 FROM {right}) GROUP BY v"""


def _rows(table: str) -> str:
    return f"(SELECT count(*) || ' rows' FROM {table})"


_SEGMENTS = "(SELECT count(DISTINCT c_mktsegment) || ' rows' FROM customer)"

_PRICE_SUM = "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 2)"
_BALANCE_SUM = "round(CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE), 2)"
_TESTS = _with("tgt_orders") + " " + " UNION ALL ".join(
    (
        _scalar(1, "count(*)", "orders", "tgt_orders"),
        _scalar(2, "min(o_custkey)", "orders", "tgt_orders"),
        _scalar(3, _PRICE_SUM, "orders", "tgt_orders"),
        _scalar(4, _BALANCE_SUM, "customer", "customer"),
        _scalar(5, "count(*) FILTER (lang = 'en')", "documents", "documents"),
        _case(6, _SEGMENTS, _SEGMENTS, "'PASS'"),
        _case(7, _rows("orders"), _rows("tgt_orders"), "'FAIL'"),
        _case(8, _rows("customer"), _rows("customer"), "'PASS'"),
        _case(9, "NULL", "'UNRESOLVED_COLUMN.WITH_SUGGESTION'", "'ERROR'"),
    )
)

_ALL_ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_FROM, _AT, _END = "'2024-01-01 00:00:00'", "'2024-02-01 00:00:00'", "'9999-12-31 00:00:00'"
_HISTORY = _ORDERS + f"""
SELECT {_ALL_ORDER}, {_FROM} AS START_TIME, {_END} AS END_TIME, 'Y' AS ACTIVE FROM (SELECT * FROM s INTERSECT SELECT * FROM t)
UNION ALL
SELECT {_ALL_ORDER}, {_FROM}, {_AT}, 'N' FROM (SELECT * FROM s EXCEPT SELECT * FROM t)
UNION ALL
SELECT {_ALL_ORDER}, {_AT}, {_END}, 'Y' FROM (SELECT * FROM t EXCEPT SELECT * FROM s)"""

ORACLES: dict[str, str] = {
    "cell_diff": f"{_ORDERS} {_CELLS}",
    "cell_diff_summary": f"""{_ORDERS}, cells AS ({_CELLS})
        SELECT column_name, count(*) AS mismatches FROM cells GROUP BY column_name""",
    "cell_diff_types": _with("typed_source", "typed_target") + """
        SELECT o_orderkey, 'big' AS column_name, CAST(9007199254740992 + o_orderkey % 3 AS VARCHAR) AS source_value,
               '9007199254740992' AS target_value FROM orders WHERE o_orderkey % 3 <> 0
        UNION ALL SELECT o_orderkey, 'wide', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) || '.5'
        FROM orders WHERE o_orderkey % 47 = 0
        UNION ALL SELECT o_orderkey, 'day', 'x', 'y' FROM orders WHERE o_orderkey % 53 = 0
        UNION ALL SELECT o_orderkey, 'flag', CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '0' END, '7'
        FROM orders WHERE o_orderkey % 59 = 0""",
    "validate_detail": _with("tgt_lineitem") + f""",
        d AS (SELECT {_LINE_JSON} AS row_key, CAST(sum(side) AS BIGINT) AS n
              FROM (SELECT *, 1 AS side FROM lineitem UNION ALL SELECT *, -1 FROM tgt_lineitem)
              GROUP BY {_LINE_ALL} HAVING sum(side) <> 0)
        SELECT 'lineitem' AS table_name, CAST(NULL AS VARCHAR) AS column_name, row_key,
               CASE WHEN n > 0 THEN 'missing_in_target' ELSE 'extra_in_target' END AS status,
               CAST(greatest(n, 0) AS VARCHAR) AS source_value, CAST(greatest(-n, 0) AS VARCHAR) AS target_value FROM d""",
    "scope_report": f"""{_ORDERS}, tgt_lineitem AS ({planted_sql('tgt_lineitem')})
        SELECT 'run-1' AS run_id, 'SQL_SERVER' AS source_dbms, 'SNOWFLAKE' AS target_dbms, *, true AS stamped FROM (
        SELECT 'orders' AS table_name, 'Not-Matched' AS result_status, (SELECT count(*) FROM s) AS source_record_count,
               (SELECT count(*) FROM t) AS target_record_count
        UNION ALL SELECT 'lineitem', 'Not-Matched', (SELECT count(*) FROM lineitem), (SELECT count(*) FROM tgt_lineitem)
        UNION ALL SELECT 'customer', 'Matched', count(*), count(*) FROM customer
        UNION ALL SELECT 'supplier', CASE WHEN count(*) >= 7 THEN 'Not-Matched' ELSE 'Matched' END, count(*), count(*) FROM supplier
        UNION ALL SELECT 'part', 'Table does not exist in snowflake', count(*), 0 FROM part
        UNION ALL SELECT 'nation', 'Error while fetching data from SQL server, validation failed', NULL, NULL
        UNION ALL SELECT 'events', 'Data Comparison failed due to some error', NULL, NULL)""",
    "declared_profile": _DECLARED,
    "fine_rejects": _with("fine_orders") + """
        SELECT _row AS row_number, CAST(CAST(whole AS DOUBLE) AS VARCHAR) || ',' || cents AS rejected_record, 'whole' AS column_name,
               'conversion' AS category, 'value of whole is no int' AS error FROM fine_orders WHERE _row % 31 = 0
        UNION ALL SELECT _row, CAST(CAST(whole AS DOUBLE) AS VARCHAR) || ',' || cents, 'cents', 'conversion',
               'value of cents is no decimal(12,2)' FROM fine_orders WHERE _row % 37 = 0""",
    "load_readback": f"""SELECT o_orderkey AS O_ORDERKEY, o_totalprice AS O_TOTALPRICE,
        o_orderdate AS O_ORDERDATE FROM ({_GOOD})""",
    "load_audit": f"""WITH r AS ({_LOAD_RESULT})
        SELECT 'run-1' AS run_id, 'orders' AS table_name, status, true AS ended, rows_parsed, rows_loaded, errors_seen FROM r
        UNION ALL SELECT 'run-1', 'customer', 'LOADED', true, count(*), count(*), 0 FROM customer
        UNION ALL SELECT 'run-1', 'part', 'Table not created due to PATH_NOT_FOUND', true, NULL, NULL, NULL
        UNION ALL SELECT r, 'supplier', 'LOADED', true, count(*), count(*), 0
        FROM supplier, (VALUES ('run-1'), ('run-2')) AS v(r) GROUP BY r""",
    "staged_rejects": _with("raw_lines") + """
        SELECT line AS rejected_record, CASE WHEN line LIKE 'x%' THEN 'o_orderkey' END AS column_name,
               CASE WHEN line LIKE 'x%' THEN 'conversion' ELSE 'parsing' END AS category,
               CASE WHEN line LIKE 'x%' THEN 'value of o_orderkey is no bigint'
                    ELSE 'number of columns in file does not match the table' END AS error, true AS placed
        FROM raw_lines WHERE line LIKE 'x%' OR len(regexp_split_to_array(line, ',')) <> 3""",
    "test_case_rows": _with("tgt_orders") + " " + " UNION ALL ".join((
        _listed(1, "count(*)", "orders", "tgt_orders"),
        _listed(2, "min(o_custkey)", "orders", "tgt_orders"),
        _listed(5, "count(*) FILTER (lang = 'en')", "documents", "documents"),
        """SELECT 6, to_json([CAST(row_number() OVER (ORDER BY c_mktsegment) AS VARCHAR), c_mktsegment, CAST(count(*) AS VARCHAR)]),
                  CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM customer GROUP BY c_mktsegment""",
        """SELECT 7, to_json([CAST(o_orderkey AS VARCHAR), CAST(o_totalprice AS VARCHAR)]), CAST(sum(a) AS BIGINT), CAST(sum(b) AS BIGINT)
           FROM (SELECT o_orderkey, o_totalprice, 1 AS a, 0 AS b FROM orders
                 UNION ALL SELECT o_orderkey, o_totalprice, 0, 1 FROM tgt_orders) GROUP BY o_orderkey, o_totalprice""",
        """SELECT 8, to_json([CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR), CAST(c_custkey AS VARCHAR), c_name]),
                  CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM customer""",
    )),
    "case_file": f"""SELECT 'run-1' AS run_id, case_no, source_table_name, status, true AS timed FROM ({_TESTS})""",
    "cell_diff_repeated_keys": f"{_LINES} {_LINE_CELLS}",
    "diff_ambiguous_keys": f"""{_LINES} SELECT l_orderkey, l_linenumber, 'ambiguous' AS status, missing_rows, extra_rows
        FROM keys WHERE missing_rows > 0 AND extra_rows > 0 AND missing_rows + extra_rows > 2""",
    "diff_missing_extra": f"""{_ORDERS}
        SELECT o_orderkey, 'missing_in_target' AS status, CAST(1 AS BIGINT) AS missing_rows, CAST(0 AS BIGINT) AS extra_rows
        FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = s.o_orderkey)
        UNION ALL SELECT o_orderkey, 'extra_in_target', 0, 1
        FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE t.o_orderkey = s.o_orderkey)""",
    "cell_diff_positional": _with("tgt_supplier") + """,
        a AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS row_number FROM supplier),
        b AS (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS row_number FROM tgt_supplier)
        SELECT a.row_number, 's_acctbal' AS column_name, CAST(a.s_acctbal AS VARCHAR) AS source_value,
               CAST(b.s_acctbal AS VARCHAR) AS target_value
        FROM a JOIN b ON a.row_number = b.row_number WHERE a.s_acctbal IS DISTINCT FROM b.s_acctbal""",
    "multiset_diff": _with("tgt_lineitem") + """
        SELECT * EXCLUDE (side), CAST(sum(side) AS BIGINT) AS surplus
        FROM (SELECT *, 1 AS side FROM lineitem UNION ALL SELECT *, -1 FROM tgt_lineitem)
        GROUP BY ALL HAVING sum(side) <> 0""",
    "normalize_rows": _NORMALIZED,
    "row_counts": _COUNTS,
    "reconcile_report": _REPORT,
    "key_profile": f"{_ORDERS} {_key('lineitem', 'l_orderkey,l_linenumber', 'lineitem')}"
    f" UNION ALL {_key('orders', 'o_orderkey', 's')} UNION ALL {_key('orders', 'o_orderstatus', 's')}",
    "key_columns": _with("constraints", "usage") + """
        SELECT database, schema, "table", count(*) AS key_size,
               string_agg(upper("column"), ',' ORDER BY ordinal) AS key_columns
        FROM usage JOIN constraints USING (constraint_name, database, schema, "table")
        WHERE constraint_type = 'PRIMARY KEY' OR (constraint_name ILIKE 'pk%' AND constraint_type <> 'FOREIGN KEY'
          AND NOT EXISTS (SELECT 1 FROM constraints c WHERE c.schema = usage.schema AND c."table" = usage."table"
                          AND (c.constraint_type = 'PRIMARY KEY'
                               OR (c.constraint_name ILIKE 'pk%' AND c.constraint_type <> 'FOREIGN KEY'
                                   AND c.constraint_name < usage.constraint_name))))
        GROUP BY database, schema, "table" """,
    "column_profile": _PROFILE,
    "analyze_tables": f"{_ANALYSIS} SELECT * FROM analysis",
    "analyze_totals": f"""{_ANALYSIS}
        SELECT count(*) FILTER ("DDL_Migration_Analysis" = 'Success') AS pass_tables,
               count(*) FILTER ("DDL_Migration_Analysis" = 'Fail') AS failed_tables,
               count(*) FILTER ("DDL_Migration_Analysis" = 'Not-Found') AS not_found_tables FROM analysis""",
    "map_types": _with("catalog") + f' SELECT * EXCLUDE (is_nullable, "default", length, scale) FROM ({_MAPPED})',
    "fit_check": _FIT,
    "schema_mismatch": f"""{_SCHEMA} SELECT * FROM comparison
        WHERE COLUMN_COMPAR = 'False' OR COLUMN_AND_LEN_COMPAR = 'False'""",
    "schema_verdict": f"""{_SCHEMA}
        SELECT Table_name, CASE WHEN bool_and(COLUMN_COMPAR = 'True' AND COLUMN_AND_LEN_COMPAR = 'True')
                                THEN 'valid' ELSE 'Not-valid' END AS result_status,
               count(*) AS columns_compared,
               count(*) FILTER (COLUMN_COMPAR = 'False' OR COLUMN_AND_LEN_COMPAR = 'False') AS columns_differing
        FROM comparison GROUP BY Table_name""",
    "extract_filtered": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_totalprice > 250000 AND o_orderstatus = 'F'""",
    "convert_rows": _with("conv_orders") + """
        SELECT o_orderkey, CAST(flag AS INTEGER) AS flag, replace(note, '&#x0D;', ' ') AS note FROM conv_orders""",
    "load_good": _GOOD,
    "load_rejects": _REJECTS,
    "load_result": _LOAD_RESULT,
    "staged_load": _GOOD,
    # The second engine has no XML; the documents without an end tag, with text after
    # it or with a second root were planted by this rule.
    "xml_validity": f"SELECT o_orderkey, NOT ({_BAD_XML}) AS is_valid FROM orders",
    "xml_totals": f"""SELECT count(*) FILTER (o_orderkey % 73 <> 0) AS documents, count(*) FILTER ({_BAD_XML}) AS malformed,
        count(*) FILTER ({_BAD_XML}) = 0 AS all_valid FROM orders""",
    "keyword_scan": _HITS,
    "keyword_verdict": f"""WITH h AS ({_HITS})
        SELECT d.doc_id, CASE WHEN count(h.keyword) = 0 THEN 'converts' ELSE 'needs work' END AS verdict,
               count(h.keyword) AS keywords, CAST(coalesce(sum(h.hits), 0) AS BIGINT) AS hits,
               coalesce(string_agg(h.keyword, ', ' ORDER BY h.keyword), '') AS remark
        FROM documents d LEFT JOIN h ON d.doc_id = h.doc_id GROUP BY d.doc_id""",
    "test_case_results": _TESTS,
    "audit_latest": _with("audit") + """
        SELECT run_id, database_name, schema_name, table_name, arg_max(source_dbms, event_seq) AS source_dbms,
               arg_max(target_dbms, event_seq) AS target_dbms, arg_max(status, event_seq) AS status,
               CAST(min(event_time) AS VARCHAR) AS start_time,
               CASE WHEN arg_max(status, event_seq) <> 'IN PROGRESS' THEN CAST(max(event_time) AS VARCHAR) END AS end_time,
               arg_min(created_by, event_seq) AS created_by, arg_max(created_by, event_seq) AS updated_by
        FROM audit GROUP BY run_id, database_name, schema_name, table_name""",
    "history_apply": _HISTORY,
    "escaped_load": _with("escaped_records") + """
        SELECT o_orderkey, CAST(o_custkey AS INT) AS o_custkey,
               CASE WHEN o_orderkey % 59 = 0 THEN 'x,y' WHEN o_orderkey % 61 = 0 THEN 'a "quoted", text'
                    WHEN o_orderkey % 67 = 0 THEN 'two' || chr(10) || 'lines'
                    WHEN o_orderkey % 79 = 0 THEN 'tab' || chr(9) || chr(92) || 'n'
                    WHEN o_orderkey % 83 = 0 THEN 'C:' || chr(92) || 'new' WHEN o_orderkey % 89 = 0 THEN NULL ELSE 'plain' END AS note
        FROM orders WHERE o_orderkey % 43 <> 0 AND o_orderkey % 53 <> 0 AND o_orderkey % 73 <> 0
          AND (o_orderkey % 47 <> 0) AND (o_orderkey % 71 <> 0 OR o_orderkey % 59 = 0 OR o_orderkey % 61 = 0 OR o_orderkey % 67 = 0)""",
    "escaped_rejects": _with("escaped_records") + """,
        placed AS (
          SELECT *, row_number() OVER w AS row_number, 2 + coalesce(sum(1 + len(record) - len(replace(record, chr(10), ''))) OVER before, 0) AS row_start_line,
                 26 + coalesce(sum(strlen(record) + 1) OVER before, 0) AS byte_offset
          FROM escaped_records
          WINDOW w AS (PARTITION BY part ORDER BY o_orderkey), before AS (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ),
        wrong AS (
          SELECT *, o_orderkey % 53 = 0 AS bad_key, o_orderkey % 73 = 0 AND o_orderkey % 43 <> 0 AS bad_customer,
                 len(CASE WHEN o_orderkey % 53 = 0 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR)) + 2 AS second,
                 CASE WHEN o_orderkey % 43 = 0 THEN 'short' WHEN o_orderkey % 47 = 0 THEN 'long'
                      WHEN o_orderkey % 71 = 0 AND o_orderkey % 59 <> 0 AND o_orderkey % 61 <> 0 AND o_orderkey % 67 <> 0 THEN 'beside' END AS shape
          FROM placed
        ),
        found AS (
          SELECT *, CASE shape WHEN 'short' THEN len(record) + 1 WHEN 'long' THEN len(record) - 3 ELSE len(record) - 9 END AS character,
                 NULL AS column_name, 'parsing' AS category, 'number of columns in file does not match the table' AS error
          FROM wrong WHERE shape IS NOT NULL
          UNION ALL SELECT *, 1, 'o_orderkey', 'conversion', 'value of o_orderkey is no bigint' FROM wrong WHERE shape IS NULL AND bad_key
          UNION ALL SELECT *, second, 'o_custkey', 'conversion', 'value of o_custkey is no int' FROM wrong WHERE shape IS NULL AND bad_customer
        )
        SELECT CAST(part AS INT) AS part, row_number, record AS rejected_record, CAST(row_start_line AS BIGINT) AS row_start_line,
               CAST(byte_offset AS BIGINT) AS byte_offset, CAST(character AS BIGINT) AS character, column_name, category, error
        FROM found""",
    "load_xml": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 73 <> 0 THEN o_orderkey END AS id,
        CASE WHEN o_orderkey % 73 <> 0 THEN o_custkey END AS custkey, CASE WHEN o_orderkey % 73 <> 0 THEN o_orderstatus END AS orderstatus,
        CASE WHEN o_orderkey % 73 <> 0 THEN CAST(o_orderkey % 7 AS INT) END AS second_item FROM orders WHERE NOT ({_BAD_XML})""",
    "load_xml_rejects": f"""SELECT o_orderkey AS row_number, 'doc' AS column_name, 'conversion' AS category,
        'value of doc is no variant' AS error FROM orders WHERE {_BAD_XML}""",
    "xml_cell_diff": _with("xml_documents", "xml_spelled") + """
        SELECT 'orders' AS table_name, NULL AS column_name, to_json([CAST(o_orderkey AS VARCHAR)]) AS row_key, 'missing_in_target' AS status,
               '1' AS source_value, '0' AS target_value FROM xml_documents WHERE o_orderkey % 29 = 0
        UNION ALL SELECT 'orders', 'doc', to_json([CAST(o_orderkey AS VARCHAR)]), 'changed', s.doc, t.doc
        FROM xml_documents s JOIN xml_spelled t USING (o_orderkey) WHERE s.doc <> t.doc""",
    "history_rebuild": _with("snapshots") + """,
        times AS (SELECT n, '2024-01-' || CAST(10 + n AS VARCHAR) || ' 00:00:00' AS taken FROM range(10) AS r(n)),
        counts AS (SELECT o_orderkey, o_orderstatus, o_totalprice, n, count(*) AS copies FROM snapshots JOIN times USING (taken) GROUP BY ALL),
        marked AS (
          SELECT *, CASE WHEN lag(n) OVER w = n - 1 AND lag(copies) OVER w = copies THEN 0 ELSE 1 END AS begins
          FROM counts WINDOW w AS (PARTITION BY o_orderkey, o_orderstatus, o_totalprice ORDER BY n)
        ),
        islands AS (SELECT *, sum(begins) OVER (PARTITION BY o_orderkey, o_orderstatus, o_totalprice ORDER BY n) AS island FROM marked),
        versions AS (
          SELECT o_orderkey, o_orderstatus, o_totalprice, min(n) AS first, max(n) + 1 AS next, any_value(copies) AS copies
          FROM islands GROUP BY o_orderkey, o_orderstatus, o_totalprice, island
        )
        SELECT o_orderkey, o_orderstatus, o_totalprice, a.taken AS START_TIME, coalesce(b.taken, '9999-12-31 00:00:00') AS END_TIME,
               CASE WHEN b.taken IS NULL THEN 'Y' ELSE 'N' END AS ACTIVE
        FROM (SELECT *, unnest(range(copies)) FROM versions) v JOIN times a ON a.n = first LEFT JOIN times b ON b.n = next""",
    "object_keywords": _OBJECTS + "SELECT object_id, keyword, hits FROM hits WHERE hits > 0",
    "object_verdict": _OBJECTS + """
        SELECT verdict, remark, count(*) AS objects, CAST(sum(hits) AS BIGINT) AS hits FROM (
          SELECT object_id, CASE WHEN sum(hits) = 0 THEN 'converts' ELSE 'needs work' END AS verdict, sum(hits) AS hits,
                 coalesce(string_agg(keyword, ', ' ORDER BY keyword) FILTER (hits > 0), '') AS remark
          FROM hits GROUP BY object_id) GROUP BY verdict, remark""",
    "key_ranges": "SELECT CAST(n AS INT) AS range_no, true AS even, true AS covered FROM range(1, 17) AS r(n), (SELECT count(*) FROM lineitem)",
    "catalog_scan": """SELECT table_name AS "table", CAST(o AS INT) AS ordinal, c AS "column", t AS type, true AS nullable, b AS buckets FROM (VALUES
        ('nation', 1, 'N_NATIONKEY', 'int', 'N_REGIONKEY,N_NATIONKEY'), ('nation', 2, 'N_NAME', 'string', 'N_REGIONKEY,N_NATIONKEY'),
        ('nation', 3, 'N_REGIONKEY', 'int', 'N_REGIONKEY,N_NATIONKEY'), ('orders', 1, 'O_ORDERKEY', 'bigint', NULL),
        ('orders', 2, 'FLAG', 'boolean', NULL), ('orders', 3, 'NOTE', 'string', NULL)) AS v(table_name, o, c, t, b), (SELECT count(*) FROM nation)""",
    "scope_keys_report": _ORDERS + ",\n" + _LINES.removeprefix("WITH ") + f"""
        SELECT 'shop.dbo.orders' AS table_name, NULL AS column_name, to_json([CAST(o_orderkey AS VARCHAR)]) AS row_key, status,
               CASE status WHEN 'missing_in_target' THEN '1' ELSE '0' END AS source_value,
               CASE status WHEN 'missing_in_target' THEN '0' ELSE '1' END AS target_value
        FROM ({_UNPAIRED})
        UNION ALL SELECT 'shop.dbo.orders', CASE column_name WHEN 'o_orderkey' THEN 'order,key' ELSE column_name END,
               to_json([CAST(o_orderkey AS VARCHAR)]), 'changed', source_value, target_value FROM ({_CELLS})
        UNION ALL SELECT 'shop.dbo.items', NULL, to_json([CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)]), 'ambiguous',
               CAST(missing_rows AS VARCHAR), CAST(extra_rows AS VARCHAR)
        FROM keys WHERE missing_rows > 0 AND extra_rows > 0 AND missing_rows + extra_rows > 2
        UNION ALL SELECT 'shop.dbo.items', column_name, to_json([CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)]), 'changed',
               source_value, target_value FROM ({_LINE_CELLS})""",
    "limited_extract": """SELECT least(10, count(*)) AS "rows", 'limited' AS part FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT count(*), 'whole' FROM orders WHERE o_orderkey % 2 = 0""",
    "case_tables": f"""SELECT source_table_name, test_case, status FROM ({_TESTS}) WHERE source_table_name IN ('customer', 'documents')""",
    "file_counts": """
        SELECT 'orders' AS table_name, (SELECT count(*) FROM orders) AS source_record_count, (SELECT count(*) FROM orders) AS target_record_count,
               'Matched' AS result_status
        UNION ALL SELECT 'customer', (SELECT count(*) FROM customer), (SELECT count(*) FROM supplier), 'Not-Matched'
        UNION ALL SELECT 'part', (SELECT count(*) FROM part), 0, 'Table does not exist in snowflake'
        UNION ALL SELECT 'events', (SELECT count(*) FROM events), (SELECT count(*) FROM events), 'Matched'""",
    "ordinals_with_ties": """
        SELECT l_returnflag, l_linestatus, l_quantity, min(n) AS first_row, max(n) AS last_row, count(DISTINCT n) AS numbers
        FROM (SELECT *, row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity) AS n FROM lineitem) GROUP BY ALL""",
    "failed_readback": f"""SELECT 'orders' AS table_name, 'PARTIALLY_LOADED' AS status, count(*) AS "rows" FROM ({_GOOD})
        UNION ALL SELECT 'nothing', 'LOAD_FAILED', NULL UNION ALL SELECT 'supplier', 'LOADED', count(*) FROM supplier""",
}

ORACLES["load_files"] = f"""
    WITH found AS (
      SELECT CASE WHEN loaded = total THEN 'LOADED' ELSE 'PARTIALLY_LOADED' END AS status, total AS rows_parsed, loaded AS rows_loaded,
             total - loaded AS errors_seen, rejects, offsets, loaded AS "rows"
      FROM (SELECT count(*) AS loaded FROM ({ORACLES['escaped_load']})),
           (SELECT count(*) AS rejects, CAST(sum(byte_offset) AS BIGINT) AS offsets FROM ({ORACLES['escaped_rejects']})),
           (SELECT count(*) AS total FROM orders)
    )
    SELECT measure, value FROM (SELECT COLUMNS(*)::VARCHAR FROM found) UNPIVOT (value FOR measure IN (status, rows_parsed, rows_loaded, errors_seen, rejects, offsets, "rows"))"""
