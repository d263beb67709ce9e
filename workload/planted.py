"""Inputs with known differences, derived from the given tables.

Each is one SQL text that Spark and a second engine both run, with ``{table}`` where a
given table is read.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

PLANTED = {
    # The source: null tokens in two text columns.
    "src_orders": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 79 = 0 THEN 'NULL' ELSE o_orderstatus END AS o_orderstatus,
               o_totalprice, o_orderdate,
               CASE WHEN o_orderkey % 83 = 0 THEN '' ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # The target: rows removed and re-keyed, cells changed, NULL for the source's null tokens.
    "tgt_orders": """
        SELECT CASE WHEN o_orderkey % 103 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS o_orderkey,
               o_custkey,
               CASE WHEN o_orderkey % 79 = 0 OR o_orderkey % 89 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 83 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
        FROM {orders} WHERE o_orderkey % 101 <> 0""",
    # Rows removed and rows doubled.
    "tgt_lineitem": """
        SELECT * FROM {lineitem} WHERE l_partkey % 37 <> 0
        UNION ALL SELECT * FROM {lineitem} WHERE l_partkey % 41 = 0""",
    # One changed column, in a table whose key repeats.
    "taxed_lineitem": """
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount,
               CASE WHEN l_partkey % 29 = 0 THEN l_tax + 1 ELSE l_tax END AS l_tax,
               l_returnflag, l_linestatus, l_shipdate
        FROM {lineitem}""",
    "tgt_supplier": """
        SELECT s_suppkey, s_name, s_nationkey,
               CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal
        FROM {supplier}""",
    # Values in the many spellings that two systems give one and the same value.
    "spelled_orders": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 79 = 0 THEN 'NULL' WHEN o_orderkey % 83 = 0 THEN '' ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 67 = 0 THEN '2024-13-45' WHEN o_orderkey % 59 = 0 THEN 'no day'
                    WHEN o_orderkey % 5 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' 00:00:00'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS day,
               CASE WHEN o_orderkey % 71 = 0 THEN '25:00:00'
                    ELSE concat('10:', CAST(10 + o_orderkey % 50 AS VARCHAR(2)), ':30.1234567') END AS clock,
               CASE WHEN o_orderkey % 61 = 0 THEN 'n/a' ELSE CAST(o_totalprice AS VARCHAR(30)) END AS price,
               o_orderkey % 2 = 0 AS flag
        FROM {orders}""",
    # One table in two systems' types, with values that a careless comparison calls equal.
    "typed_source": """
        SELECT o_orderkey, 9007199254740992 + o_orderkey % 3 AS big, CAST(o_orderkey AS DECIMAL(38,0)) AS wide,
               CASE WHEN o_orderkey % 53 = 0 THEN 'x' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS day,
               o_orderkey % 2 = 0 AS flag
        FROM {orders}""",
    "typed_target": """
        SELECT o_orderkey, CAST(9007199254740992 AS DOUBLE) AS big,
               CAST(o_orderkey AS DECIMAL(38,10)) + CASE WHEN o_orderkey % 47 = 0 THEN 0.5 ELSE 0.0 END AS wide,
               CASE WHEN o_orderkey % 53 = 0 THEN 'y' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) || ' 00:00:00' END AS day,
               CAST(CASE WHEN o_orderkey % 59 = 0 THEN 7 WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS flag
        FROM {orders}""",
    # Lines of a CSV file, some with a column too few or too many, some with a value of no use.
    "raw_lines": """
        SELECT CASE WHEN o_orderkey % 43 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) || ',' || CAST(o_totalprice AS VARCHAR(30))
                    WHEN o_orderkey % 47 = 0 THEN CAST(o_orderkey AS VARCHAR(20)) || ',' || CAST(o_totalprice AS VARCHAR(30)) || ',2024-01-01,more'
                    WHEN o_orderkey % 53 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR(20)) || ',' || CAST(o_totalprice AS VARCHAR(30)) || ',2024-01-01'
                    ELSE CAST(o_orderkey AS VARCHAR(20)) || ',' || CAST(o_totalprice AS VARCHAR(30)) || ',2024-01-01'
               END AS line
        FROM {orders}""",
    # Numbers that a load must not cut or round.
    "fine_orders": """
        SELECT o_orderkey AS _row, o_orderkey + CASE WHEN o_orderkey % 31 = 0 THEN 0.5 ELSE 0.0 END AS whole,
               CAST(o_orderkey AS VARCHAR(20)) || CASE WHEN o_orderkey % 37 = 0 THEN '.239' ELSE '.250' END AS cents
        FROM {orders}""",
    "conv_orders": """
        SELECT o_orderkey, o_orderkey % 2 = 0 AS flag,
               'a&#x0D;b' || CAST(o_orderkey AS VARCHAR(20)) AS note
        FROM {orders}""",
    "xml_orders": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE
               '<p><k>' || CAST(o_orderkey AS VARCHAR(20)) || '</k>' ||
               CASE WHEN o_orderkey % 71 = 0 THEN '' WHEN o_orderkey % 61 = 0 THEN '</p>junk'
                    WHEN o_orderkey % 59 = 0 THEN '</p><q/>' ELSE '</p>' END END AS doc
        FROM {orders}""",
    # Records of delimited files, one file for each part: escapes, quotes, line breaks inside quotes,
    # fields too few or too many, text beside a quoted field, and values of no use.
    "escaped_records": """
        SELECT o_orderkey, o_orderkey % 16 AS part,
               CASE WHEN o_orderkey % 53 = 0 THEN 'x' ELSE '' END || CAST(o_orderkey AS VARCHAR(20)) ||
               CASE WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 73 = 0 THEN ',n/a' ELSE ',' || CAST(o_custkey AS VARCHAR(20)) END ||
               CASE WHEN o_orderkey % 43 = 0 THEN ',short'
                    WHEN o_orderkey % 47 = 0 THEN ',a,more'
                    WHEN o_orderkey % 59 = 0 THEN ',x' || chr(92) || ',y'
                    WHEN o_orderkey % 61 = 0 THEN ',' || chr(34) || 'a ' || chr(34) || chr(34) || 'quoted' || chr(34) || chr(34) || ', text' || chr(34)
                    WHEN o_orderkey % 67 = 0 THEN ',' || chr(34) || 'two' || chr(10) || 'lines' || chr(34)
                    WHEN o_orderkey % 71 = 0 THEN ',' || chr(34) || 'bad' || chr(34) || ' text'
                    WHEN o_orderkey % 79 = 0 THEN ',tab' || chr(92) || 't' || chr(92) || chr(92) || 'n'
                    WHEN o_orderkey % 83 = 0 THEN ',' || chr(34) || 'C:' || chr(92) || 'new' || chr(34)
                    WHEN o_orderkey % 89 = 0 THEN ',NULL'
                    ELSE ',plain' END AS record
        FROM {orders}""",
    "xml_documents": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE
               '<p id=' || chr(34) || CAST(o_orderkey AS VARCHAR(20)) || chr(34) || '><k>' || CAST(o_custkey AS VARCHAR(20)) || '</k><s>' || o_orderstatus ||
               '</s><i>1</i><i>' || CAST(o_orderkey % 7 AS VARCHAR(20)) || '</i>' ||
               CASE WHEN o_orderkey % 71 = 0 THEN '' WHEN o_orderkey % 61 = 0 THEN '</p>junk'
                    WHEN o_orderkey % 59 = 0 THEN '</p><q/>' ELSE '</p>' END END AS doc,
               '<n>' || CAST(o_orderkey AS VARCHAR(20)) || '</n>' AS note
        FROM {orders}""",
    # Documents in another spelling; all of one column are well-formed on both sides.
    "xml_spelled": """
        SELECT o_orderkey, doc, '<n >' || CAST(o_orderkey AS VARCHAR(20)) || '</n>' AS note
        FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 73 = 0 THEN NULL ELSE
               '<p id=' || chr(34) || CAST(o_orderkey AS VARCHAR(20)) || chr(34) || '><k>' || CAST(o_custkey AS VARCHAR(20)) || '</k><s>' || o_orderstatus ||
               '</s><i>1</i><i>' || CAST(o_orderkey % 7 AS VARCHAR(20)) || '</i>' ||
               CASE WHEN o_orderkey % 71 = 0 THEN '' WHEN o_orderkey % 61 = 0 THEN '</p>junk'
                    WHEN o_orderkey % 59 = 0 THEN '</p><q/>' WHEN o_orderkey % 31 = 0 THEN '</p >' ELSE '</p>' END END AS doc
              FROM {orders}) d
        WHERE o_orderkey % 29 <> 0""",
    # Ten snapshots of a table, the eighth of them empty: rows that go and come back, change, or stand twice.
    "snapshots": """
        SELECT o_orderkey, o_orderstatus, o_totalprice + CASE WHEN o_orderkey % 5 = 0 AND n >= 4 THEN 1 ELSE 0 END AS o_totalprice,
               '2024-01-' || CAST(10 + n AS VARCHAR(2)) || ' 00:00:00' AS taken
        FROM (SELECT *, o_orderkey % 1 AS k FROM {orders} UNION ALL SELECT *, o_orderkey % 1 FROM {orders} WHERE o_orderkey % 11 = 0) o
        JOIN (VALUES (0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 0), (6, 0), (8, 0), (9, 0)) AS s(n, k) ON o.k = s.k
        WHERE (o_orderkey + n) % 7 <> 0 AND (o_orderkey % 11 <> 0 OR n <= 5 OR o_orderkey % 2 = 0)""",
    # Texts of database objects with keywords in code, in comments, in literals and in quoted names.
    "object_texts": """
        SELECT o_orderkey AS object_id, 'CREATE VIEW v AS SELECT 1 ' ||
               CASE WHEN o_orderkey % 3 = 0 THEN '-- cursor in a comment, its quote' || chr(39) || ' opens nothing' || chr(10) ELSE '' END ||
               CASE WHEN o_orderkey % 5 = 0 THEN '/* merge /* goto */ merge */' ELSE '' END ||
               CASE WHEN o_orderkey % 7 = 0 THEN ' ' || chr(39) || 'it' || chr(39) || chr(39) || 's a cursor -- no comment' || chr(39) ELSE '' END ||
               CASE WHEN o_orderkey % 11 = 0 THEN ' MERGE INTO t' ELSE '' END ||
               CASE WHEN o_orderkey % 13 = 0 THEN ' goto a; GOTO b' ELSE '' END ||
               CASE WHEN o_orderkey % 17 = 0 THEN ' [cursor] ' || chr(34) || 'merge' || chr(34) ELSE '' END ||
               CASE WHEN o_orderkey % 19 = 0 THEN ' DECLARE c CURSOR' ELSE '' END ||
               CASE WHEN o_orderkey % 23 = 0 THEN ' /* never ends: goto' ELSE '' END AS code
        FROM {orders}""",
    # Text rows to load, some cells of which do not convert.
    "raw_orders": """
        SELECT o_orderkey AS _row,
               CASE WHEN o_orderkey % 53 = 0 THEN 'x' || CAST(o_orderkey AS VARCHAR(20))
                    ELSE CAST(o_orderkey AS VARCHAR(20)) END AS o_orderkey,
               CASE WHEN o_orderkey % 59 = 0 THEN 'NUL' WHEN o_orderkey % 61 = 0 THEN 'n/a'
                    ELSE CAST(o_totalprice AS VARCHAR(30)) END AS o_totalprice,
               CASE WHEN o_orderkey % 67 = 0 THEN '2024-13-45'
                    ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) END AS o_orderdate
        FROM {orders}""",
    # A column catalog with eight columns per table, one for every part. Tables with a
    # number divisible by 4 also have types the target lacks.
    "catalog": """
        SELECT 'shop' AS database, 'dbo' AS schema, 't' || CAST(p.table_no AS VARCHAR(20)) AS "table",
               CAST(p.p_partkey % 8 + 1 AS INT) AS ordinal, 'c' || CAST(p.p_partkey AS VARCHAR(20)) AS "column",
               k.data_type, k.length, k.scale,
               CASE WHEN p.p_size % 2 = 0 THEN 'NULL' ELSE 'NOT NULL' END AS is_nullable,
               CASE p.p_size % 8 WHEN 1 THEN '((0))' WHEN 2 THEN '(getdate())' WHEN 3 THEN '(newid())'
                    WHEN 4 THEN '((1.5e3))'
                    WHEN 5 THEN CASE WHEN p.table_no % 5 = 0 THEN '(''N'')' END
                    WHEN 6 THEN CASE WHEN p.table_no % 7 = 0 THEN '(user_name())' END END AS "default"
        FROM (SELECT p_partkey, p_size, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS table_no FROM {part}) p
        JOIN (VALUES (0, 'bigint', 19, 0), (1, 'bit', NULL, NULL), (2, 'decimal', 18, 4), (3, 'int', 10, 0),
                     (4, 'money', 19, 4), (5, 'numeric', 10, 2), (6, 'smallint', 5, 0), (7, 'smallmoney', 10, 4),
                     (8, 'tinyint', 3, 0), (9, 'float', 53, NULL), (10, 'real', 24, NULL), (11, 'date', 0, NULL),
                     (12, 'datetime2', 7, NULL), (13, 'datetime', 3, NULL), (14, 'datetimeoffset', 7, NULL),
                     (15, 'smalldatetime', 0, NULL), (16, 'time', 7, NULL), (17, 'char', 10, NULL),
                     (18, 'text', 2147483647, NULL), (19, 'varchar', 50, NULL), (20, 'nchar', 10, NULL),
                     (21, 'ntext', 1073741823, NULL), (22, 'nvarchar', -1, NULL), (23, 'uniqueidentifier', NULL, NULL),
                     (24, 'xml', -1, NULL), (25, 'hierarchyid', 892, NULL), (26, 'binary', 8, NULL),
                     (27, 'varbinary', -1, NULL), (28, 'geography', -1, NULL), (29, 'sql_variant', 0, NULL),
                     (30, 'image', 2147483647, NULL), (31, 'geometry', -1, NULL)) AS k(no, data_type, length, scale)
          ON k.no = CASE WHEN p.table_no % 4 = 0 THEN p.p_partkey % 32 ELSE p.p_partkey % 29 END""",
    # The columns the target has: some dropped, renamed, narrowed or added.
    "actual": """
        SELECT 'shop' AS database, 'dbo' AS schema,
               CASE WHEN p.table_no % 2 = 0 THEN 'T' ELSE 't' END || CAST(p.table_no AS VARCHAR(20)) AS "table",
               CAST(p.p_partkey % 8 + 1 AS INT) AS ordinal,
               CASE WHEN p.p_partkey % 97 = 0 THEN 'X' ELSE 'C' END || CAST(p.p_partkey AS VARCHAR(20)) AS "column",
               CASE WHEN p.p_partkey % 89 = 0 THEN 'VARCHAR(1)' ELSE k.type END AS type
        FROM (SELECT p_partkey, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS table_no FROM {part}) p
        JOIN (VALUES (0, 'NUMBER(19,0)'), (1, 'NUMBER(1,0)'), (2, 'NUMBER(18,4)'), (3, 'NUMBER(10,0)'), (4, 'FLOAT'),
                     (5, 'NUMBER(10,2)'), (6, 'NUMBER(5,0)'), (7, 'FLOAT'), (8, 'NUMBER(3,0)'), (9, 'FLOAT'),
                     (10, 'NUMERIC(24)'), (11, 'DATE'), (12, 'TIMESTAMP_NTZ(7)'), (13, 'TIMESTAMP_NTZ(3)'),
                     (14, 'TIMESTAMP_LTZ(7)'), (15, 'DATETIME(0)'), (16, 'TIME(7)'), (17, 'VARCHAR(10)'),
                     (18, 'VARCHAR(2147483647)'), (19, 'VARCHAR(50)'), (20, 'VARCHAR(10)'), (21, 'VARCHAR(1073741823)'),
                     (22, 'VARCHAR(16777216)'), (23, 'VARCHAR(16777216)'), (24, 'VARIANT'), (25, 'VARCHAR(892)'),
                     (26, 'BINARY(8388608)'), (27, 'VARCHAR(16777216)'), (28, 'VARCHAR(16777216)'),
                     (29, 'sql_variant(0)'), (30, 'image(2147483647)'), (31, 'geometry')) AS k(no, type)
          ON k.no = CASE WHEN p.table_no % 4 = 0 THEN p.p_partkey % 32 ELSE p.p_partkey % 29 END
        WHERE p.p_partkey % 101 <> 0
        UNION ALL
        SELECT 'shop', 'dbo', 't' || CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS VARCHAR(20)), 9,
               'ADDED' || CAST(p_partkey AS VARCHAR(20)), 'DATE'
        FROM {part} WHERE p_partkey % 83 = 0""",
    # The catalog's tables, and some that it does not have.
    "scope": """
        SELECT DISTINCT 'shop' AS database, 'dbo' AS schema,
               't' || CAST(CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS VARCHAR(20)) AS "table" FROM {part}
        UNION ALL
        SELECT DISTINCT 'shop', 'dbo', 'gone' || CAST(CAST((p_partkey - p_partkey % 80) / 80 AS BIGINT) AS VARCHAR(20))
        FROM {part}""",
    # Key constraints by type and by name, and foreign keys, with two columns each.
    "constraints": """
        SELECT DISTINCT CASE c.no % 3 WHEN 0 THEN 'PK_t' WHEN 1 THEN 'pk_t' ELSE 'key_t' END || CAST(c.no AS VARCHAR(20)) AS constraint_name,
               'shop' AS database, c.schema, 't' || CAST(c.no AS VARCHAR(20)) AS "table",
               CASE c.no % 3 WHEN 1 THEN 'UNIQUE' ELSE 'PRIMARY KEY' END AS constraint_type
        FROM (SELECT CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS no, 'dbo' AS schema FROM {part}
              UNION ALL
              SELECT CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT), 'old' FROM {part}
              WHERE CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) % 11 = 0) c
        UNION ALL
        SELECT DISTINCT 'FK_t' || CAST(c.no AS VARCHAR(20)), 'shop', 'dbo', 't' || CAST(c.no AS VARCHAR(20)), 'FOREIGN KEY'
        FROM (SELECT CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS no FROM {part}) c
        UNION ALL
        SELECT DISTINCT 'pk_alt' || CAST(c.no AS VARCHAR(20)), 'shop', 'dbo', 't' || CAST(c.no AS VARCHAR(20)), 'UNIQUE'
        FROM (SELECT CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS no FROM {part}) c WHERE c.no % 4 = 0""",
    "usage": """
        SELECT CASE WHEN c.at >= 6 AND c.no % 4 = 0 THEN 'pk_alt' WHEN c.at >= 3 THEN 'FK_t' WHEN c.no % 3 = 0 THEN 'PK_t' WHEN c.no % 3 = 1 THEN 'pk_t' ELSE 'key_t' END
                 || CAST(c.no AS VARCHAR(20)) AS constraint_name,
               'shop' AS database, 'dbo' AS schema, 't' || CAST(c.no AS VARCHAR(20)) AS "table",
               'c' || CAST(c.p_partkey AS VARCHAR(20)) AS "column", CAST(8 - c.at AS INT) AS ordinal
        FROM (SELECT p_partkey, p_partkey % 8 AS at, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS no FROM {part}) c
        UNION ALL
        SELECT CASE WHEN c.no % 3 = 0 THEN 'PK_t' WHEN c.no % 3 = 1 THEN 'pk_t' ELSE 'key_t' END || CAST(c.no AS VARCHAR(20)),
               'shop', 'old', 't' || CAST(c.no AS VARCHAR(20)), 'o' || CAST(c.p_partkey AS VARCHAR(20)), CAST(8 - c.at AS INT)
        FROM (SELECT p_partkey, p_partkey % 8 AS at, CAST((p_partkey - p_partkey % 8) / 8 AS BIGINT) AS no FROM {part}) c
        WHERE c.no % 11 = 0 AND c.at < 2""",
    # Audit events: a user is a run, an event type a table.
    "audit": """
        SELECT CAST(user_id AS VARCHAR(20)) AS run_id, event_id AS event_seq, 'SQL_SERVER' AS source_dbms,
               'SNOWFLAKE' AS target_dbms, 'shop' AS database_name, 'dbo' AS schema_name, event_type AS table_name,
               CASE WHEN value < 20 THEN 'IN PROGRESS' WHEN value < 100 THEN 'LOADED' ELSE 'LOAD_FAILED' END AS status,
               ts AS event_time, 'u' || CAST(event_id % 7 AS VARCHAR(20)) AS created_by
        FROM {events}""",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def planted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A planted input over the Parquet files of ``sf_dir``."""
    text = PLANTED[name].replace('"', "`")
    return spark.sql(text.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in _tables_in(text)}))


def planted_sql(name: str) -> str:
    """The same text over registered table names."""
    text = PLANTED[name]
    return text.format(**{t: t for t in _tables_in(text)})


def _tables_in(text: str) -> set[str]:
    return {field for _, field, _, _ in string.Formatter().parse(text) if field}
