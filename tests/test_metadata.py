"""Catalogs, types, analysis and schema comparison."""

import pytest
from pyspark.sql import functions as F

from reconcile.operators import analyze, catalog, schema, typemap
from reconcile.sources import tables

CATALOG = (
    "database string, schema string, table string, ordinal int, column string, data_type string, length int, "
    "is_nullable string, default string, scale int"
)


def column(table, ordinal, data_type, length=None, scale=None, default=None):
    return ("shop", "dbo", table, ordinal, f"c{ordinal}", data_type, length, "NULL", default, scale)


# Every source type with its length and scale, the target type text and the type it is loaded as.
TYPES = [
    ("bigint", 19, 0, "NUMBER(19,0)", "bigint"),
    ("bit", None, None, "NUMBER(1,0)", "int"),
    ("decimal", 18, 4, "NUMBER(18,4)", "decimal(18,4)"),
    ("int", 10, 0, "NUMBER(10,0)", "int"),
    ("money", 19, 4, "FLOAT", "decimal(19,4)"),
    ("numeric", 10, 2, "NUMBER(10,2)", "decimal(10,2)"),
    ("smallint", 5, 0, "NUMBER(5,0)", "smallint"),
    ("smallmoney", 10, 4, "FLOAT", "decimal(10,4)"),
    ("tinyint", 3, 0, "NUMBER(3,0)", "smallint"),
    ("float", 53, None, "FLOAT", "double"),
    ("real", 24, None, "NUMERIC(24)", "float"),
    ("date", 0, None, "DATE", "date"),
    ("datetime2", 7, None, "TIMESTAMP_NTZ(7)", "timestamp_ntz"),
    ("datetime", 3, None, "TIMESTAMP_NTZ(3)", "timestamp_ntz"),
    ("datetimeoffset", 7, None, "TIMESTAMP_LTZ(7)", "timestamp"),
    ("smalldatetime", 0, None, "DATETIME(0)", "timestamp_ntz"),
    ("time", 7, None, "TIME(7)", "string"),
    ("char", 10, None, "VARCHAR(10)", "string"),
    ("text", 2147483647, None, "VARCHAR(2147483647)", "string"),
    ("varchar", 50, None, "VARCHAR(50)", "string"),
    ("nchar", 10, None, "VARCHAR(10)", "string"),
    ("ntext", 1073741823, None, "VARCHAR(1073741823)", "string"),
    ("nvarchar", -1, None, "VARCHAR(16777216)", "string"),
    ("uniqueidentifier", None, None, "VARCHAR(16777216)", "string"),
    ("xml", -1, None, "VARIANT", "string"),
    ("hierarchyid", 892, None, "VARCHAR(892)", "string"),
    ("binary", 8, None, "BINARY(8388608)", "binary"),
    ("varbinary", -1, None, "VARCHAR(16777216)", "binary"),
    ("geography", -1, None, "VARCHAR(16777216)", "string"),
]


def test_every_type(spark):
    rows = [column("t", i, t, n, s) for i, (t, n, s, _, _) in enumerate(TYPES, 1)]
    assert len(rows) == 29
    mapped = typemap.map_types(spark.createDataFrame(rows, CATALOG)).orderBy("ordinal").collect()
    assert [(r["data_type"], r["rendered_type"], r["spark_type"]) for r in mapped] == [
        (t, rendered, loaded) for t, _, _, rendered, loaded in TYPES
    ]


def test_upper_case_types_map_and_unknown_types_pass(spark):
    rows = [column("t", 1, "BIGINT", 19, 0), column("t", 2, "sql_variant", 0), column("t", 3, "geometry", -1)]
    mapped = typemap.map_types(spark.createDataFrame(rows, CATALOG)).orderBy("ordinal").collect()
    assert [r["rendered_type"] for r in mapped] == ["NUMBER(19,0)", "sql_variant(0)", "geometry"]


def test_own_type_map(spark):
    mapping = spark.createDataFrame([("x", "number", "NUMBER", "decimal")],
                                    "dialect string, source_type string, target_type string, spark_type string")
    mapped = typemap.map_types(spark.createDataFrame([column("t", 1, "number", 12, 3)], CATALOG), mapping).first()
    assert (mapped["rendered_type"], mapped["spark_type"]) == ("NUMBER(12,3)", "decimal(12,3)")


def test_types_of_one_table(spark):
    rows = [column("t", 2, "decimal", 9, 2), column("t", 1, "INT", 10, 0), column("u", 1, "date", 0),
            column("t", 3, "xml", -1), column("t", 4, "tinyint", 3, 0), column("t", 5, "nvarchar", 20),
            column("t", 6, "nvarchar", -1), column("t", 7, "varbinary", 8)]
    assert typemap.column_types(spark.createDataFrame(rows, CATALOG), "shop", "dbo", "t") == [
        ("c1", "int", "int", "int"), ("c2", "decimal", "decimal(9,2)", "decimal(9,2)"), ("c3", "xml", "xml", "string"),
        ("c4", "tinyint", "smallint", "unsigned tinyint"), ("c5", "nvarchar", "string", "varchar(20)"),
        ("c6", "nvarchar", "string", "string"), ("c7", "varbinary", "binary", "binary"),
    ]


def analysis_of(spark, *rows, scope=("t",)):
    scope_rows = spark.createDataFrame([("shop", "dbo", t) for t in scope], "database string, schema string, table string")
    return {r["Table"]: tuple(r)[3:] for r in analyze.analyze(scope_rows, spark.createDataFrame(rows, CATALOG)).collect()}


@pytest.mark.parametrize(
    "default",
    [None, "((0))", "(getdate())", "(newid())", "((1.5e3))", "(-1)", "(.5)", "((+2.))", "( 7 )"],
)
def test_defaults_that_move(spark, default):
    assert analysis_of(spark, column("t", 1, "int", 10, 0, default))["t"] == ("Success", "", "")


@pytest.mark.parametrize(
    ("default", "remark"),
    [("('N')", "'N'"), ("(user_name())", "user_name"), ("(1d)", "1d"), ("(1_0)", "1_0"), ("(GETDATE())", "GETDATE"), ("()", "")],
)
def test_defaults_that_do_not(spark, default, remark):
    assert analysis_of(spark, column("t", 1, "int", 10, 0, default))["t"] == ("Fail", "", remark)


def test_remarks_keep_duplicates_in_catalog_order(spark):
    rows = [
        column("t", 5, "geometry", -1), column("t", 4, "geometry", -1), column("t", 2, "Image"),
        column("t", 1, "sql_variant"), column("t", 3, "varchar", 20, None, "('N')"),
        column("t", 6, "varchar", 20, None, "(user_name())"),
    ]
    assert analysis_of(spark, *rows)["t"] == ("Fail", "SQL_VARIANT, IMAGE, GEOMETRY, GEOMETRY", "'N', user_name")


def test_table_without_columns(spark):
    result = analysis_of(spark, column("t", 1, "int"), scope=("t", "gone"))
    assert result == {"t": ("Success", "", ""), "gone": ("Not-Found", "", "")}


def test_totals(spark):
    scope = spark.createDataFrame([("shop", "dbo", t) for t in ("t", "u", "gone")], "database string, schema string, table string")
    rows = spark.createDataFrame([column("t", 1, "int"), column("u", 1, "image")], CATALOG)
    assert tuple(analyze.analysis_totals(analyze.analyze(scope, rows)).first()) == (1, 1, 1)


def test_keywords(spark):
    texts = spark.createDataFrame(
        [(1, "SELECT GETDATE() from t; goto x"), (2, "select 1"), (3, "goto_x Goto goto"), (4, None), (1, "goto")],
        "id int, body string",
    )
    hits = analyze.scan_keywords(texts, "id", "body", ["GOTO", "getdate"])
    assert sorted(tuple(r) for r in hits.collect()) == [(1, "getdate", 1), (1, "goto", 2), (3, "goto", 2)]
    verdict = analyze.keyword_verdict(texts, "id", "body", ["GOTO", "getdate"])
    assert sorted(tuple(r) for r in verdict.collect()) == [
        (1, "needs work", 2, 3, "getdate, goto"), (2, "converts", 0, 0, ""), (3, "needs work", 1, 2, "goto"),
        (4, "converts", 0, 0, ""),
    ]


ACTUAL = "database string, schema string, table string, ordinal int, column string, type string"


def comparison(spark, expected, actual):
    left = typemap.map_types(spark.createDataFrame(expected, CATALOG))
    return schema.compare_schema(left, spark.createDataFrame(actual, ACTUAL))


def test_schema_valid_in_any_case_and_order(spark):
    compared = comparison(
        spark,
        [column("t", 1, "int", 10, 0), column("t", 2, "date", 0)],
        [("shop", "dbo", "t", 2, "C1", "NUMBER(10,0)"), ("shop", "dbo", "t", 1, "C2", "DATE")],
    )
    assert tuple(schema.schema_verdicts(compared).first()) == ("shop.dbo.t", "valid", 2, 0)
    assert {r["ORDINAL_COMPAR"] for r in compared.collect()} == {"False"}


def test_schema_dropped_added_and_narrowed(spark):
    compared = comparison(
        spark,
        [column("t", 1, "int", 10, 0), column("t", 2, "date", 0), column("t", 3, "varchar", 50)],
        [("shop", "dbo", "t", 1, "C1", "NUMBER(10,0)"), ("shop", "dbo", "t", 2, "C3", "VARCHAR(20)"),
         ("shop", "dbo", "t", 3, "NEW", "DATE")],
    )
    found = {r["column_name"]: (r["COLUMN_COMPAR"], r["COLUMN_AND_LEN_COMPAR"]) for r in schema.schema_mismatches(compared).collect()}
    assert found == {"C2": ("False", "False"), "C3": ("True", "False"), "NEW": ("False", "False")}
    assert schema.schema_verdicts(compared).first()["result_status"] == "Not-valid"


def test_schema_with_names_alike_but_for_case(spark):
    compared = comparison(
        spark,
        [column("t", 1, "date", 0)],
        [("shop", "dbo", "t", 1, "c1", "DATE"), ("shop", "dbo", "t", 2, "C1", "DATE")],
    )
    assert [(r["column_name"], r["COLUMN_COMPAR"]) for r in compared.collect()] == [("C1", "False")]


def test_schema_of_a_spark_target(spark):
    expected = typemap.map_types(spark.createDataFrame([column("t", 1, "int", 10, 0), column("t", 2, "money", 19, 4)], CATALOG))
    target = spark.createDataFrame([], "C1 int, C2 decimal(19,4)")
    compared = schema.compare_schema(expected, catalog.describe(target, "shop", "dbo", "t"), "spark_type")
    assert schema.schema_verdicts(compared).first()["result_status"] == "valid"


def test_catalog_from_information_schema(spark):
    views = spark.createDataFrame(
        [("shop", "dbo", "t", 1, "name", "varchar", 50, None, None, "YES", None, None),
         ("shop", "dbo", "t", 2, "price", "decimal", None, 10, None, "NO", "((0))", 2),
         ("shop", "dbo", "t", 3, "at", "datetime2", None, None, 7, "YES", None, None)],
        "TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, ORDINAL_POSITION int, COLUMN_NAME string, "
        "DATA_TYPE string, CHARACTER_MAXIMUM_LENGTH int, NUMERIC_PRECISION int, DATETIME_PRECISION int, "
        "IS_NULLABLE string, COLUMN_DEFAULT string, NUMERIC_SCALE int",
    )
    assert set(tables.COLUMNS_QUERY.split("SELECT ")[1].split(" FROM")[0].split(", ")) == set(views.columns)
    rows = catalog.catalog_rows(views).orderBy("ordinal").collect()
    assert [(r["column"], r["length"], r["is_nullable"], r["default"], r["scale"]) for r in rows] == [
        ("name", 50, "NULL", None, None), ("price", 10, "NOT NULL", "((0))", 2), ("at", 7, "NULL", None, None),
    ]


def test_key_columns(spark):
    constraints = catalog.constraint_rows(spark.createDataFrame(
        [("PK_a", "shop", "dbo", "a", "PRIMARY KEY"), ("pk_b", "shop", "dbo", "b", "UNIQUE"),
         ("fk_c", "shop", "dbo", "c", "FOREIGN KEY"), ("own", "shop", "dbo", "d", "PRIMARY KEY"),
         ("pk_alt", "shop", "dbo", "d", "UNIQUE"), ("PK_a", "shop", "old", "a", "PRIMARY KEY")],
        "CONSTRAINT_NAME string, TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_TYPE string"))
    usage = catalog.usage_rows(spark.createDataFrame(
        [("PK_a", "shop", "dbo", "a", "y", 2), ("PK_a", "shop", "dbo", "a", "x", 1), ("pk_b", "shop", "dbo", "b", "k", 1),
         ("fk_c", "shop", "dbo", "c", "k", 1), ("own", "shop", "dbo", "d", "k", 1),
         ("pk_alt", "shop", "dbo", "d", "code", 1), ("PK_a", "shop", "old", "a", "id", 1)],
        "CONSTRAINT_NAME string, TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int"))
    keys = {(r["schema"], r["table"]): r["key_columns"] for r in catalog.key_columns(constraints, usage).collect()}
    assert keys == {("dbo", "a"): "X,Y", ("dbo", "b"): "K", ("dbo", "d"): "K", ("old", "a"): "ID"}


def test_key_profile(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (None, 1), (2, None)], "a int, b int")
    assert tuple(catalog.key_profile(df, ["a", "b"], "t").first()) == ("t", "a,b", 5, 4, 1, 2, 2, False)
    assert catalog.key_profile(spark.range(10), ["id"], "r").first()["is_key"]
    assert tuple(catalog.key_profile(spark.range(0), ["id"], "r").first()) == ("r", "id", 0, 0, 0, 0, 0, True)


def test_profile(spark):
    df = spark.createDataFrame([(1, "abc"), (2, "NULL"), (None, ""), (3, "b")], "n int, s string")
    assert [tuple(r) for r in catalog.profile_columns(df).collect()] == [
        (1, "n", "int", 4, 1, 1, "1", "3"), (2, "s", "string", 4, 2, 3, "abc", "b"),
    ]


def test_profile_beside_what_is_declared(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "C1 int, other string")
    rows = catalog.profile_columns(df, spark.createDataFrame([column("t", 1, "int", 10, 0)], CATALOG)).collect()
    assert {r["column_name"]: (r["null_count"], r["declared_type"], r["declared_length"]) for r in rows} == {
        "C1": (0, "int", 10), "other": (1, None, None)}


def test_wide_profile_keeps_the_order(spark):
    df = spark.range(3).selectExpr(*[f"id + {i} AS c{i}" for i in range(120)])
    rows = catalog.profile_columns(df).collect()
    assert [(r["ordinal"], r["column_name"], r["max_value"]) for r in rows] == [
        (i + 1, f"c{i}", str(i + 2)) for i in range(120)]


@pytest.mark.parametrize(
    ("values", "schema_text", "declared", "misfits"),
    [
        (["a", "abc", "NULL", None, ""], "v string", "varchar(2)", 1),
        (["abc"], "v string", "nvarchar(-1)", 0),
        ([-129, -128, 127, 128], "v bigint", "tinyint", 2),
        ([-2147483649, 2147483647], "v bigint", "int", 1),
        ([-128.9, -128.0, 127.0, 127.9, 128.0, float("nan")], "v double", "tinyint", 4),
        ([-9.3e18, -9223372036854775808.0, 9.2e18, 9.3e18], "v double", "bigint", 2),
        ([99999.99, 99999.994, 99999.995, -100000.0, 0.07], "v double", "decimal(7,2)", 3),
        ([1, 100000], "v int", "decimal(7, 2)", 1),
        (["1", "x", "1.5"], "v string", "int", 2),
        (["0", "255", "256", "-1", "x"], "v string", "unsigned tinyint", 3),
        ([0, 255, 256, -1], "v int", "Unsigned  TinyInt", 2),
        (["1.234", "1.230", "99999", "1e5", "1e2", "1.5e-2"], "v string", "decimal(7,2)", 3),
        (["1.9", "2.0", "-3", " 4 ", "1e1"], "v string", "int", 3),
        (["2024-01-01 10:00:00", "2024-01-01 00:00:00"], "v string", "date", 1),
        (["2024-01-01", "2024-13-01"], "v string", "date", 1),
    ],
)
def test_fit(spark, values, schema_text, declared, misfits):
    df = spark.createDataFrame([(v,) for v in values], schema_text)
    assert typemap.fit_check(df, {"v": declared}).first()["misfits"] == misfits
    if "char" not in declared and "unsigned" not in declared.lower():
        # What does not cast at all never fits.
        col = F.nullif("v", F.lit("NULL")) if "string" in schema_text else F.col("v")
        failing = df.filter(col.isNotNull() & (col.cast("string") != "") & col.try_cast(declared).isNull())
        assert failing.count() <= misfits


def test_time_of_day_does_not_fit_a_date(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-01-01 00:00:00', timestamp_ntz'2024-01-01 10:00:00')) AS v")
    assert typemap.fit_check(df, {"v": "date"}).first()["misfits"] == 1


def test_keywords_of_several_words_and_signs(spark):
    df = spark.createDataFrame(
        [(1, "select * from a CROSS\n apply b; @@identity x_cross apply"), (2, "crossapply @@identityx"), (3, None)], "id int, sql string")
    hits = analyze.scan_keywords(df, "id", "sql", ["Cross  Apply", "@@IDENTITY", "select", "a.b"]).collect()
    assert sorted(tuple(r) for r in hits) == [(1, "@@identity", 1), (1, "cross apply", 1), (1, "select", 1)]
    verdicts = {r["id"]: r["verdict"] for r in analyze.keyword_verdict(df, "id", "sql", ["cross apply"]).collect()}
    assert verdicts == {1: "needs work", 2: "converts", 3: "converts"}


def test_table_names_match_in_any_case(spark):
    columns = "database string, schema string, table string, ordinal int, column string"
    expected = spark.createDataFrame([("s", "d", "t", 1, "k", "int", "NUMBER(10,0)")], f"{columns}, data_type string, rendered_type string")
    actual = spark.createDataFrame([("S", "D", "T", 1, "K", "NUMBER(10,0)"), ("S", "D", "T", 2, "X", "DATE")], f"{columns}, type string")
    rows = {r["column_name"]: (r["Table_name"], r["COLUMN_COMPAR"]) for r in schema.compare_schema(expected, actual).collect()}
    assert rows == {"K": ("s.d.t", "True"), "X": ("s.d.t", "False")}


def test_jdbc_options():
    options = tables.jdbc_options("jdbc:x", "dbo.t", partition_column="id", lower_bound=1, upper_bound=9, num_partitions=4)
    assert options == {"url": "jdbc:x", "dbtable": "dbo.t", "fetchsize": "50000", "partitionColumn": "id",
                       "lowerBound": "1", "upperBound": "9", "numPartitions": "4"}
    assert "partitionColumn" not in tables.jdbc_options("jdbc:x", "t")
    with pytest.raises(ValueError, match="numPartitions"):
        tables.jdbc_options("jdbc:x", "t", partition_column="id", lower_bound=1, upper_bound=2)
    assert tables.metadata_options("jdbc:x", tables.CONSTRAINTS_QUERY)["query"].startswith("SELECT CONSTRAINT_NAME")


def test_key_ranges_cover_every_row_once(spark):
    df = spark.createDataFrame([(i,) for i in (None, -5, 1, 2, 3, 50, 99)], "k int")
    for bounds in ([], [2], [1, 3, 60]):
        parts = [df.filter(p) for p in tables.key_range_predicates("k", bounds)]
        assert sum(p.count() for p in parts) == 7
        assert len(parts) == len(bounds) + 1


def test_extract_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    df = tables.extract(orders, ["o_orderkey"], F.col("o_orderkey") > 100)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "GreaterThan(o_orderkey,100)" in plan
    assert tables.extract(orders, limit=3).count() == 3 and tables.extract(orders).count() == 1500
