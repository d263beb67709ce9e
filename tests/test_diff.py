import datetime as dt
from decimal import Decimal

import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reconcile.operators import diff

SCHEMA = "k int, a string, b double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cells_missing_and_extra(spark):
    source = frame(spark, [(1, "x", 1.0), (2, "y", 2.0), (3, "z", 3.0), (None, "n", 1.0)])
    target = frame(spark, [(1, "x", 1.0), (2, "w", 2.5), (4, "q", 4.0), (None, "m", 1.0)])
    assert rows_of(diff.diff_cells(source, target, ["k"])) == sorted(
        [(2, "a", "y", "w"), (2, "b", "2.0", "2.5"), (None, "a", "n", "m")], key=repr
    )
    assert rows_of(diff.diff_missing_extra(source, target, ["k"])) == [
        (3, "missing_in_target", 1, 0),
        (4, "extra_in_target", 0, 1),
    ]


def test_null_differs_from_value_but_not_from_null(spark):
    source = frame(spark, [(1, None, None), (2, None, 1.0)])
    target = frame(spark, [(1, None, None), (2, "a", None)])
    assert rows_of(diff.diff_cells(source, target, ["k"])) == [(2, "a", None, "a"), (2, "b", "1.0", None)]


def test_repeated_keys(spark):
    source = frame(spark, [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 1.0), (2, "b", 1.0), (3, "a", 1.0), (3, "a", 1.0)])
    target = frame(spark, [(1, "a", 1.0), (1, "c", 1.0), (2, "x", 1.0), (2, "y", 1.0), (3, "a", 1.0)])
    surplus = diff.surplus_rows(source, target)
    # Equal rows cancel first, so key 1 still has one row on each side.
    assert rows_of(diff.cells_of(surplus, ["k"])) == [(1, "a", "b", "c")]
    assert rows_of(diff.diff_keys(surplus, ["k"], diff.AMBIGUOUS)) == [(2, "ambiguous", 2, 2)]
    assert rows_of(diff.diff_keys(surplus, ["k"], diff.MISSING)) == [(3, "missing_in_target", 1, 0)]


def test_composite_key_and_excluded_column(spark):
    schema = "k int, l int, a string, stamp int"
    source = frame(spark, [(1, 1, "x", 1), (1, 2, "y", 1)], schema)
    target = frame(spark, [(1, 1, "x", 2), (1, 2, "z", 2)], schema)
    assert rows_of(diff.diff_cells(source, target, ["k", "l"], exclude=["STAMP"])) == [(1, 2, "a", "y", "z")]


def test_key_only_table(spark):
    source, target = frame(spark, [(1,), (2,)], "k int"), frame(spark, [(2,), (3,)], "k int")
    assert rows_of(diff.diff_missing_extra(source, target, ["k"])) == [
        (1, "missing_in_target", 1, 0),
        (3, "extra_in_target", 0, 1),
    ]
    assert diff.diff_cells(source, target, ["k"]).count() == 0


def test_names_match_in_any_case_and_types_are_brought_together(spark):
    source = frame(spark, [(1, Decimal("1.50")), (2, Decimal("2.00"))], "k int, v decimal(10,2)")
    target = frame(spark, [(1, Decimal("1.5000")), (2, Decimal("2.0001"))], "K bigint, V decimal(18,4)")
    cells = diff.diff_cells(source, target, ["K"])
    assert cells.columns[0] == "k" and rows_of(cells) == [(Decimal(2), "v", "2.0000", "2.0001")]


@pytest.mark.parametrize(
    ("left", "right", "equal"),
    [
        ("1", "CAST(1 AS bigint)", True),
        ("CAST(1 AS tinyint)", "1.00", True),
        ("CAST(12345678901234567890 AS decimal(38,0))", "CAST(12345678901234567890.5 AS decimal(22,1))", False),
        ("CAST(9223372036854775807 AS bigint)", "CAST(9223372036854775806 AS decimal(20,0))", False),
        ("CAST(0.5 AS float)", "CAST(0.5 AS double)", True),
        ("1.5", "CAST(1.5 AS double)", True),
        ("date'2024-01-01'", "timestamp_ntz'2024-01-01 00:00:00'", True),
        ("date'2024-01-01'", "timestamp_ntz'2024-01-01 00:00:01'", False),
        ("CAST('NaN' AS double)", "CAST('NaN' AS double)", True),
        ("CAST(0.0 AS double)", "CAST(-0.0 AS double)", True),
        ("X'00ff'", "X'00FF'", True),
        ("CAST(9007199254740993 AS bigint)", "CAST(9007199254740992 AS double)", False),
        ("CAST(9007199254740992 AS bigint)", "CAST(9007199254740992 AS double)", True),
        ("CAST(0 AS bigint)", "CAST(-0.0 AS double)", True),
        ("CAST(-120 AS bigint)", "CAST(-120 AS double)", True),
        ("CAST(0.1 AS decimal(10,4))", "CAST(0.1 AS double)", True),
        ("CAST(1e-7 AS decimal(20,10))", "CAST(1e-7 AS double)", True),
        ("CAST(12345678901234567.25 AS decimal(20,2))", "CAST(12345678901234568 AS double)", False),
        ("CAST(5 AS decimal(38,0))", "CAST(5 AS decimal(38,10))", True),
        ("CAST(0 AS decimal(38,0))", "CAST(0 AS decimal(38,10))", True),
        ("CAST(12345678901234567890123456789012345678 AS decimal(38,0))", "CAST(5.5 AS decimal(38,10))", False),
        ("date'2024-01-01'", "timestamp'2024-01-01 00:00:00'", True),
        ("timestamp_ntz'2024-01-01 00:00:01'", "timestamp'2024-01-01 00:00:00'", False),
        ("true", "1", True),
        ("true", "0", False),
        ("false", "CAST(0 AS decimal(5,2))", True),
    ],
)
def test_values_of_two_types(spark, left, right, equal):
    sides = [spark.sql(f"SELECT 1 AS k, {value} AS v") for value in (left, right)]
    assert diff.diff_cells(*sides, ["k"]).count() == (0 if equal else 1)


def test_key_names_the_result_uses_itself(spark):
    df = spark.createDataFrame([("a", 1)], "status string, v int")
    with pytest.raises(ValueError, match="rename"):
        diff.diff_cells(df, df, ["STATUS"])


def test_missing_column_is_an_error(spark):
    with pytest.raises(ValueError, match="no column b"):
        diff.surplus_rows(frame(spark, [(1, "x", 1.0)]), frame(spark, [(1, "x")], "k int, a string"))


@pytest.mark.parametrize("token", ["", "NULL", None])
def test_null_tokens_are_equal_on_both_sides(spark, token):
    source, target = frame(spark, [(1, token, 1.0)]), frame(spark, [(1, None, 1.0)])
    for left, right in ((source, target), (target, source)):
        assert diff.diff_multiset(diff.normalize(left), diff.normalize(right)).count() == 0


def test_na_is_ordinary_data(spark):
    source, target = frame(spark, [(1, "Na", 1.0)]), frame(spark, [(1, None, 1.0)])
    assert diff.diff_cells(diff.normalize(source), diff.normalize(target), ["k"]).count() == 1


def test_normalize_by_target_type(spark):
    rows = [
        ("2024-02-29", "10:20:30.1234567", "1.5", "true", "<a/>"),
        ("2024-02-30", "24:00:00", "n/a", "0", "<a>"),
        ("", "NULL", None, None, None),
        ("1700-01-01", "00:00:00", "-9999.9999", "maybe", "junk"),
    ]
    schema = "d string, t string, n string, f string, x string"
    types = {"D": "DATE", "T": "TIME(9)", "N": "NUMBER(10,4)", "F": "BOOLEAN", "X": "VARIANT"}
    assert [tuple(r) for r in diff.normalize(spark.createDataFrame(rows, schema), types).collect()] == [
        ("2024-02-29", "10:20:30", "1.5000", "1", "<a/>"),
        ("2024-02-30", "24:00:00", "n/a", "0", "<a>"),
        (None, None, None, None, None),
        ("1700-01-01", "00:00:00", "-9999.9999", "maybe", "junk"),
    ]
    valid = diff.normalize(spark.createDataFrame(rows, schema), types, xml_by_validity=True).select("x")
    assert [r[0] for r in valid.collect()] == ["VALID", "<a>", None, "junk"]


@pytest.mark.parametrize(
    ("kind", "left", "right", "equal"),
    [
        ("DATE", "'x'", "'y'", False),
        ("DATE", "'2024-13-45'", "CAST(NULL AS string)", False),
        ("DATE", "'2024-01-15 00:00:00'", "date'2024-01-15'", True),
        ("DATE", "'2024-1-5'", "date'2024-01-05'", True),
        ("DATE", "'2024-01-15 10:00:00'", "date'2024-01-15'", False),
        ("DATE", "'2024-01-15 junk'", "date'2024-01-15'", False),
        ("TIME(7)", "'25:00:00'", "CAST(NULL AS string)", False),
        ("TIME(7)", "'10:00'", "'garbage'", False),
        ("TIME(7)", "'10:00:00.123'", "'10:00:00'", True),
        ("VARIANT", "'<a>1</a>'", "'<a>999</a>'", False),
        ("VARIANT", "'<a>1</a>'", "'<a>1</a>'", True),
    ],
)
def test_bad_text_differs_from_null_and_other_text(spark, kind, left, right, equal):
    sides = [diff.normalize(spark.sql(f"SELECT 1 AS k, {value} AS v"), {"V": kind}) for value in (left, right)]
    assert diff.diff_cells(*sides, ["k"]).count() == (0 if equal else 1)


def test_flags_of_several_types(spark):
    types = {"F": "BOOLEAN"}
    sides = [diff.normalize(spark.sql(q), types) for q in (
        "SELECT * FROM VALUES (1, true), (2, false), (3, NULL), (4, NULL) AS t(k, f)",
        "SELECT * FROM VALUES (1, 1), (2, 0), (3, NULL), (4, 0) AS t(k, f)",
        "SELECT * FROM VALUES (1, 'True'), (2, '0'), (3, 'NULL'), (4, 'maybe') AS t(k, f)",
    )]
    for a in sides:
        for b in sides:
            assert {r["k"] for r in diff.diff_cells(a, b, ["k"]).collect()} == (set() if a is b else {4})


def test_number_text_equals_decimal(spark):
    source = spark.createDataFrame([(1, "1.5"), (2, "x")], "k int, n string")
    target = spark.createDataFrame([(1, Decimal("1.50")), (2, None)], "k int, n decimal(10,2)")
    types = {"N": "NUMBER(10,2)"}
    cells = diff.diff_cells(diff.normalize(source, types), diff.normalize(target, types), ["k"])
    assert rows_of(cells) == [(2, "n", "x", None)]


@pytest.mark.parametrize(
    ("left", "right", "equal"),
    [
        ("'1.5'", "'1.50'", True),
        ("'+01.500'", "CAST(1.5 AS decimal(10,2))", True),
        ("'1.5e1'", "CAST(15 AS int)", True),
        ("'1.505'", "'1.50'", False),
        ("'1.500000001e0'", "'1.50'", False),
        ("'1.505'", "CAST(1.51 AS decimal(10,2))", False),
        ("'1.50000000000000000000001'", "'1.50'", False),
        ("CAST(1.505 AS decimal(18,4))", "CAST(1.51 AS decimal(10,2))", False),
        ("CAST(1.5 AS decimal(18,4))", "CAST(1.5 AS decimal(10,2))", True),
        ("CAST(1.5 AS decimal(18,4))", "'1.50'", True),
        ("CAST(1.505 AS double)", "CAST(1.51 AS decimal(10,2))", False),
        ("CAST(1.51 AS double)", "CAST(1.51 AS decimal(10,2))", True),
        ("CAST(1.51 AS double)", "'1.510'", True),
        ("CAST(123456789012 AS bigint)", "CAST(NULL AS decimal(10,2))", False),
        ("'123456789012'", "CAST(123456789012 AS bigint)", True),
        ("CAST('NaN' AS double)", "CAST(NULL AS decimal(10,2))", False),
        ("'n/a'", "CAST(NULL AS decimal(10,2))", False),
        ("'NULL'", "CAST(NULL AS decimal(10,2))", True),
        ("CAST('1e36' AS decimal(38,0))", "CAST(NULL AS decimal(10,2))", False),
    ],
)
def test_numbers_in_two_spellings(spark, left, right, equal):
    sides = [diff.normalize(spark.sql(f"SELECT 1 AS k, {v} AS n"), {"N": "NUMBER(10,2)"}) for v in (left, right)]
    for a, b in (sides, sides[::-1]):
        assert diff.diff_cells(a, b, ["k"]).count() == (0 if equal else 1)


def test_positional(spark):
    source = frame(spark, [(i, "x", float(i)) for i in range(100)]).repartition(7)
    target = frame(spark, [(i, "x" if i != 42 else "y", float(i)) for i in range(100)]).repartition(3)
    assert rows_of(diff.diff_positional(source, target, ["k"])) == [(43, "a", "x", "y")]


def test_ordinals_over_many_partitions(spark):
    df = spark.range(10_000).selectExpr("id", "id % 3 AS hot").repartition(13)
    numbered = diff.with_ordinals(df, ["hot", "id"])
    expected = sorted(range(10_000), key=lambda i: (i % 3, i))
    assert [r["id"] for r in numbered.orderBy("row_number").collect()] == expected
    assert numbered.agg({"row_number": "max"}).first()[0] == 10_000


def test_frequent_values_are_numbered_by_several_tasks(spark):
    df = spark.range(40_000).selectExpr("id % 2 AS tied", "if(id % 3 = 0, 'copy', concat('r', id)) AS a").repartition(5)
    # Adaptive execution would put so few rows into one partition again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        numbered = diff.with_ordinals(df, ["tied"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [pq.ParquetFile(f.removeprefix("file://")).metadata.num_rows for f in numbered.inputFiles()]
    assert max(sizes) < 10_000
    rows = numbered.orderBy("row_number").collect()
    assert [r["row_number"] for r in rows] == list(range(1, 40_001))
    assert [r["tied"] for r in rows] == [0] * 20_000 + [1] * 20_000
    assert diff.diff_multiset(numbered.drop("row_number"), df).count() == 0
    # The same rows in another arrangement are numbered alike.
    assert diff.diff_positional(df, df.repartition(3, "a"), ["tied"]).count() == 0


def test_positions_of_the_longer_side(spark):
    source, target = frame(spark, [(1, "x", 1.0), (2, "y", None)]), frame(spark, [(1, "x", 1.0)])
    for ties in (True, False):
        assert rows_of(diff.diff_positional(source, target, ["k"], ties=ties)) == [(2, None, '["2","y",null]', None)]
        assert rows_of(diff.diff_positional(target, source, ["k"], ties=ties)) == [(2, None, None, '["2","y",null]')]


def test_columns_of_the_target_alone_are_an_error(spark):
    with pytest.raises(ValueError, match="no column b"):
        diff.surplus_rows(frame(spark, [(1, "x")], "k int, a string"), frame(spark, [(1, "x", 1.0)]))
    sides = frame(spark, [(1, "x")], "k int, a string"), frame(spark, [(1, "x", 1.0)])
    assert diff.surplus_rows(*sides, exclude=["B"]).count() == 0


def test_names_that_the_comparison_uses(spark):
    df = frame(spark, [(1, 2)], "k int, source_copies int")
    assert diff.diff_cells(df, df, ["k"]).count() == 0
    taken = frame(spark, [(1, 2)], "k int, _source_copies int")
    with pytest.raises(ValueError, match="rename"):
        diff.surplus_rows(taken, taken)


def test_key_texts_are_told_apart(spark):
    keys = frame(spark, [("a|b", "c"), ("a", "b|c"), (None, "x"), ("NULL", "x")], "k string, l string")
    assert keys.select(diff.key_text(["k", "l"])).distinct().count() == 4


def test_summary_counts_all(spark):
    source = frame(spark, [(i, "x", 1.0) for i in range(50)])
    target = frame(spark, [(i, "y", 1.0 if i else 2.0) for i in range(50)])
    summary = diff.summarize_cells(diff.diff_cells(source, target, ["k"]))
    assert rows_of(summary) == [("a", 50), ("b", 1)]


small_rows = st.lists(
    st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "", "NULL", None]), st.sampled_from([0.0, 1.0, None])),
    max_size=8,
)
several = settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@several
@given(left=small_rows, right=small_rows)
def test_properties(spark, left, right):
    a, b = diff.normalize(frame(spark, left)), diff.normalize(frame(spark, right))
    forth = {tuple(r)[:-1]: r["surplus"] for r in diff.diff_multiset(a, b).collect()}
    back = {tuple(r)[:-1]: r["surplus"] for r in diff.diff_multiset(b, a.repartition(3)).collect()}
    assert forth == {k: -v for k, v in back.items()}
    assert sum(forth.values()) == len(left) - len(right)
    assert diff.diff_multiset(a, a.repartition(2)).count() == 0
    # Brute force over the lists themselves.
    clean = [[(k, None if t in ("", "NULL") else t, v) for k, t, v in side] for side in (left, right)]
    expected = {r: clean[0].count(r) - clean[1].count(r) for r in clean[0] + clean[1]}
    assert forth == {k: v for k, v in expected.items() if v}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_has_no_join_no_python_and_combines_before_the_shuffle(spark):
    source, target = frame(spark, [(1, "x", 1.0)]), frame(spark, [(1, "y", 1.0)])
    plan = plan_of(diff.diff_cells(source, target, ["k"]))
    assert "Join" not in plan and "Python" not in plan and "SinglePartition" not in plan
    assert plan.count("Exchange") == 2 and "partial_sum" in plan


def test_hot_key(spark):
    """A third of the rows share one key, and a third of those are copies of one row."""
    source = spark.range(90_000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS k", "CASE WHEN id % 9 = 0 THEN 'copy' ELSE concat('r', id) END AS a"
    )
    target = source.selectExpr("k", "CASE WHEN k = 500 THEN 'new' ELSE a END AS a")
    assert rows_of(diff.diff_cells(source, target, ["k"])) == [(500, "a", "r500", "new")]
    gone = source.filter("a <> 'copy'")
    assert rows_of(diff.diff_keys(diff.surplus_rows(source, gone), ["k"])) == [(-1, "missing_in_target", 10_000, 0)]


def test_ordinals_of_rows_in_very_many_copies(spark, monkeypatch):
    monkeypatch.setattr(diff, "COPIES_PER_BLOCK", 50)
    rows = spark.range(4000).selectExpr("CASE WHEN id < 1500 THEN 3 WHEN id < 2600 THEN 9 ELSE id % 13 END AS k", "CASE WHEN id < 2600 THEN 'x' ELSE concat('v', id % 90) END AS v")
    numbered = diff.with_ordinals(rows, ["k"], "n")
    assert numbered.columns == ["k", "v", "n"]
    found = [tuple(r) for r in numbered.orderBy("n").collect()]
    assert [n for _, _, n in found] == list(range(1, 4001))
    assert [k for k, _, _ in found] == sorted(k for k, _, _ in found)
    assert sorted((k, v) for k, v, _ in found) == sorted(tuple(r) for r in rows.collect())


def test_copies_are_written_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(diff, "COPIES_PER_BLOCK", 1000)
    monkeypatch.setattr(diff, "ROWS_PER_TASK", 20_000)
    numbered = diff.with_ordinals(spark.range(400_000).selectExpr("id % 4 AS k"), ["k"], "n")
    tasks = numbered.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("rows"), F.sum("n").alias("total")).collect()
    assert max(t["rows"] for t in tasks) <= 60_000
    assert sum(t["rows"] for t in tasks) == 400_000 and sum(t["total"] for t in tasks) == 400_000 * 400_001 // 2


def test_counts_are_read_from_footers(spark, tmp_path):
    from reconcile.plans import reconcile

    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    counts = reconcile.file_counts(spark, [("t", path, path), ("u", path, str(tmp_path / "gone"))])
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedAggregation: [COUNT(*)]") == 3 and "ReadSchema: struct<count(*):bigint>" in plan
    assert sorted(tuple(r)[:3] for r in counts.collect()) == [("t", 1000, 1000), ("u", 1000, 0)]
