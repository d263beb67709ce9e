"""Conversion, staging, loading, history, audit, test cases and whole runs."""

import datetime as dt
import os
import uuid
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reconcile.operators import analyze, audit, convert, diff, history, testcases, typemap, xml
from reconcile.operators.testcases import TestCase
from reconcile.plans import migrate, reconcile, reports
from reconcile.session import clear_scratch, shuffle_partitions, split_bytes, temporary_scratch, write_through
from reconcile.sources import staged


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_convert(spark):
    df = spark.createDataFrame(
        [(1, True, "a&#x0D;b", "x&#x0D;", "12.345", "NULL"), (2, None, None, "", "x", "ok")],
        "k int, f boolean, doc string, plain string, n string, s string",
    )
    types = {"f": "bit", "doc": "XML", "n": "decimal"}
    assert rows_of(convert.convert(df, types, {"n": "decimal(10,2)"})) == [
        (1, 1, "a b", "x&#x0D;", Decimal("12.35"), None),
        (2, None, None, None, None, "ok"),
    ]


def test_xml(spark):
    docs = ["<a><b/></a>", "<a>", "junk", None, "<a>&amp;</a>", "<a></b>", "<a/>junk", "<a/><b/>", " <a/>\n",
            '<?xml version="1.0"?>\n<!DOCTYPE a><a>x</a>', "junk<a/>", "<a/></reconcile_document><reconcile_document>", ""]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, doc string")
    flags = [r["is_valid"] for r in xml.check_xml(df, "doc").orderBy("i").collect()]
    assert flags == [True, False, False, True, True, False, False, False, True, True, False, False, False]
    assert tuple(xml.xml_totals(df, "doc").first()) == (12, 8, False)
    assert xml.xml_totals(df.filter("i in (0, 3)"), "doc").first()["all_valid"]


def several_texts(test):
    texts = st.text(st.sampled_from('a,"\\\n\r\ts n\u2028é'), max_size=6)
    limits = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    return limits(given(values=st.lists(st.none() | texts, min_size=1, max_size=8))(test))


TYPES = {"id": "bigint", "price": "decimal(7,2)", "day": "date"}


def raw(spark, rows):
    return spark.createDataFrame(rows, "_row bigint, id string, price string, day string")


def test_rejects_name_every_bad_cell(spark):
    rows = raw(spark, [(0, "1", "1.5", "2024-01-01"), (1, "x", "n/a", "2024-01-01"), (2, "NUL", "NULL", ""),
                       (3, "4", "100000", "2024-13-01")])
    checked = staged.check_rows(rows, TYPES)
    assert rows_of(staged.good_rows(checked, TYPES)) == [
        (1, Decimal("1.50"), dt.date(2024, 1, 1)), (None, None, None),
    ]
    rejects = staged.reject_rows(checked, TYPES)
    assert sorted((r["row_number"], r["column_name"], r["category"]) for r in rejects.collect()) == [
        (1, "id", "conversion"), (1, "price", "conversion"), (3, "day", "conversion"), (3, "price", "conversion"),
    ]
    assert rejects.filter("row_number = 3").first()["rejected_record"] == "4,100000,2024-13-01"
    result = staged.load_result(checked, TYPES).first()
    assert (result["status"], result["rows_parsed"], result["rows_loaded"], result["errors_seen"]) == (
        "PARTIALLY_LOADED", 4, 2, 2)
    assert (result["first_error_line"], result["first_error_column_name"]) == (1, "id")


@pytest.mark.parametrize(("ids", "status"), [(["1", "2"], "LOADED"), (["x", "y"], "LOAD_FAILED"), ([], "LOADED")])
def test_load_status(spark, tmp_path, ids, status):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(ids)], "_row bigint, id string")
    target = migrate.Target("shop", "dbo", "t", str(tmp_path / "t"))
    assert migrate.load_with_rejects(rows, {"id": "int"}, target, str(tmp_path / "reports"), "r1") == status


def test_malformed_xml_is_rejected(spark):
    rows = spark.createDataFrame([(0, "<a/>"), (1, "<a>"), (2, None)], "_row bigint, doc string")
    checked = staged.check_rows(rows, {"doc": "xml"})
    assert rows_of(staged.good_rows(checked, {"doc": "xml"})) == [("<a/>",), (None,)]
    assert staged.reject_rows(checked, {"doc": "xml"}).first()["row_number"] == 1


cells = st.sampled_from(["1", "22", "x", "", "NUL", None, "1.5"])


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(cells, cells, st.sampled_from(["2024-01-01", "bad", ""])), max_size=10))
def test_good_and_rejected_rows_add_up(spark, rows):
    frame = raw(spark, [(i, *r) for i, r in enumerate(rows)])
    checked = staged.check_rows(frame, TYPES)
    good = staged.good_rows(checked, TYPES).count()
    bad = staged.reject_rows(checked, TYPES).select("row_number").distinct().count()
    assert good + bad == len(rows)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_stage_and_load_back(spark, tmp_path, fmt):
    source = spark.createDataFrame(
        [(1, 'say "hi", you', "two\nlines", Decimal("1.50")), (2, " padded ", None, None), (3, "back\\slash", "é", Decimal("-2.00"))],
        "id int, a string, b string, n decimal(7,2)",
    )
    path = str(tmp_path / "staged")
    staged.stage(source.repartition(2), path, fmt)
    types = {"id": "int", "a": "string", "b": "string", "n": "decimal(7,2)"}
    frame = staged.read_staged_csv(spark, path, list(types)) if fmt == "csv" else spark.read.parquet(path)
    checked = staged.check_rows(frame, types)
    assert rows_of(staged.good_rows(checked, types)) == rows_of(source)
    assert checked.select("_row").distinct().count() == 3


@pytest.mark.parametrize("multi_line", [True, False])
def test_misshapen_rows_are_rejected(spark, tmp_path, multi_line):
    file = tmp_path / "in.csv"
    file.write_text('id,price,day\n1,1.5,2024-01-01\n2,2.5\n3,3.5,2024-01-01,extra\n4,"4.5",2024-01-04\nx,1,2024-01-01\n')
    frame = staged.read_staged_csv(spark, str(file), list(TYPES), numbered=False, multi_line=multi_line)
    checked = staged.check_rows(frame, TYPES)
    assert [r[0] for r in rows_of(staged.good_rows(checked, TYPES))] == [1, 4]
    rejects = staged.reject_rows(checked, TYPES).collect()
    assert sorted((r["category"], r["rejected_record"]) for r in rejects) == [
        ("conversion", "x,1,2024-01-01"), ("parsing", "2,2.5"), ("parsing", "3,3.5,2024-01-01,extra"),
    ]
    # Counting alone must see the shape of the rows too.
    result = staged.load_result(checked, TYPES).first()
    assert (result["rows_parsed"], result["rows_loaded"], result["errors_seen"]) == (5, 2, 3)
    assert result["file"].endswith("in.csv")


def test_row_numbers_of_files_read_in_blocks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    bad = {"a.csv": {7, 61, 200}, "b.csv": {1, 120}}
    for name, lines in bad.items():
        rows = [f"{'x' if i in lines else i},1.5,2024-01-01" for i in range(1, 201)]
        (folder / name).write_text("id,price,day\n" + "\n".join(rows) + "\n")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        frame = staged.read_staged_csv(spark, str(folder), list(TYPES), numbered=False, multi_line=False)
        checked = staged.check_rows(frame, TYPES)
        assert frame.rdd.getNumPartitions() > 4
        rejects = staged.reject_rows(staged.with_file_rows(checked), TYPES).collect()
        result = staged.load_result(checked, TYPES).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    found = {}
    for r in rejects:
        found.setdefault(r["file"].rsplit("/", 1)[1], set()).add(r["row_number"])
    assert found == bad
    assert {r["file"].rsplit("/", 1)[1]: (r["rows_parsed"], r["errors_seen"], r["first_error_line"], r["first_error_column_name"])
            for r in result} == {"a.csv": (200, 3, 7, "id"), "b.csv": (200, 2, 1, "id")}


def test_migrate_under_audit(spark, tmp_path):
    root, run = str(tmp_path / "reports"), "run-1"
    source = spark.createDataFrame([("1", "1.5"), ("2", "x"), ("3", "NULL")], "id string, price string")
    types = {"id": "int", "price": "double"}
    target = migrate.Target("shop", "dbo", "t", str(tmp_path / "t"))
    status = migrate.migrate_table(spark, lambda: source, types, target, root, run)
    assert status == "PARTIALLY_LOADED"
    loaded = migrate.read_back(spark, target, status)
    assert loaded.columns == ["ID", "PRICE"] and rows_of(loaded) == [(1, 1.5), (3, None)]
    result = reports.read_report(spark, root, "row_validation").first()
    assert (result["rows_parsed"], result["rows_loaded"], result["errors_seen"], result["source_dbms"]) == (3, 2, 1, "SQL_SERVER")
    assert reports.read_report(spark, root, "rejects").first()["rejected_record"] == "2,x"

    def fail():
        return spark.read.parquet(str(tmp_path / "nothing"))

    lost = migrate.Target("shop", "dbo", "u", str(tmp_path / "u"))
    status = migrate.migrate_table(spark, fail, types, lost, root, run)
    assert status == "Table not created due to PATH_NOT_FOUND" and migrate.read_back(spark, lost, status) is None

    def raises():
        raise KeyError("no such reader")

    odd = migrate.Target("shop", "dbo", "v", str(tmp_path / "v"))
    assert migrate.migrate_table(spark, raises, types, odd, root, "run-2") == "Table not created due to KeyError"
    (tmp_path / "damaged.parquet").write_bytes(b"PAR1 no footer")
    status = migrate.migrate_table(
        spark, lambda: spark.read.schema("id string, price string").parquet(str(tmp_path / "damaged.parquet")), types, odd, root, "run-3"
    )
    assert status.startswith("Table not created due to")
    last = audit.audit_latest(reports.read_report(spark, root, "audit").filter("run_id <> 'run-1'")).collect()
    assert len(last) == 2 and all(r["status"].startswith("Table not created") and r["end_time"] for r in last)
    state = {r["table_name"]: r for r in audit.audit_latest(reports.read_report(spark, root, "audit")).collect()}
    assert state["t"]["status"] == "PARTIALLY_LOADED" and state["u"]["status"].startswith("Table not created due to")
    assert state["t"]["end_time"] >= state["t"]["start_time"]
    assert reports.read_report(spark, root, "audit").filter("run_id = 'run-1'").count() == 4


def test_typed_columns_are_loaded_as_they_are(spark):
    rows = spark.createDataFrame(
        [(0, bytearray(b"\xff\x00"), 300, 1.5, dt.datetime(2024, 1, 1), True), (1, None, 5, -1e30, None, False)],
        "_row bigint, b binary, n bigint, d double, t timestamp_ntz, f boolean",
    )
    types = {"b": "binary", "n": "tinyint", "d": "decimal(9,2)", "t": "timestamp_ntz", "f": "int"}
    checked = staged.check_rows(rows, types)
    assert sorted(r["column_name"] for r in staged.reject_rows(checked, types).collect()) == ["d", "n"]
    wide = {**types, "n": "bigint", "d": "double"}
    assert staged.good_rows(staged.check_rows(rows, wide), wide).collect()[0] == (
        bytearray(b"\xff\x00"), 300, 1.5, dt.datetime(2024, 1, 1), 1)


def test_migrate_as_the_catalog_says(spark, tmp_path):
    catalog = spark.createDataFrame(
        [("shop", "dbo", "t", i, c, t, n, "NULL", None, s)
         for i, (c, t, n, s) in enumerate([("id", "int", 10, 0), ("ok", "bit", None, None), ("doc", "xml", -1, None)], 1)],
        "database string, schema string, table string, ordinal int, column string, data_type string, length int, "
        "is_nullable string, default string, scale int")
    source = spark.createDataFrame([(1, True, "<a>&#x0D;</a>"), (2, False, "<a>"), (3, None, None)], "id int, ok boolean, doc string")
    job = migrate.job_of(catalog, lambda: source, migrate.Target("shop", "dbo", "t", str(tmp_path / "t")), staged=True)
    root = str(tmp_path / "reports")
    assert migrate.migrate_scope(spark, [job], root, "r") == {"t": "PARTIALLY_LOADED"}
    assert rows_of(spark.read.parquet(job.target.path)) == [(1, 1, "<a> </a>"), (3, None, None)]
    assert reports.read_report(spark, root, "rejects").first()["column_name"] == "doc"


def test_a_flag_that_is_none_is_rejected(spark, tmp_path):
    source = spark.createDataFrame([("true",), ("0",), ("maybe",), ("NULL",)], "ok string")
    target, root = migrate.Target("shop", "dbo", "t", str(tmp_path / "t")), str(tmp_path / "reports")
    job = migrate.Job(lambda: source, {"ok": "int"}, target, {"ok": "bit"})
    assert migrate.migrate_scope(spark, [job], root, "r") == {"t": "PARTIALLY_LOADED"}
    assert rows_of(spark.read.parquet(target.path)) == [(0,), (1,), (None,)]
    assert reports.read_report(spark, root, "rejects").first()["rejected_record"] == "maybe"


def test_reports_take_results_as_they_are(spark, sides, tmp_path):
    root = str(tmp_path / "reports")
    results = testcases.run_test_cases(spark, [TestCase("t", "ROW_COUNT")], *sides)
    reports.append_report(results, root, "test_results", "r1")
    assert reports.read_report(spark, root, "test_results").first()["status"] == "PASS"
    scope = spark.createDataFrame([("shop", "dbo", "gone")], "database string, schema string, table string")
    catalog = spark.createDataFrame([], "database string, schema string, table string, ordinal int, column string, "
                                        "data_type string, length int, is_nullable string, default string, scale int")
    reports.append_report(analyze.analyze(scope, catalog), root, "analysis", "r1")
    row = reports.read_report(spark, root, "analysis").first()
    assert (row["Table"], row["DDL_Migration_Analysis"], row["run_id"]) == ("gone", "Not-Found", "r1")


def test_migrate_again_replaces_the_target(spark, tmp_path):
    target, root = migrate.Target("shop", "dbo", "t", str(tmp_path / "t")), str(tmp_path / "reports")
    for n in (5, 3):
        migrate.migrate_table(spark, lambda: spark.range(n).selectExpr("cast(id as string) id"), {"id": "int"}, target, root, "r")  # noqa: B023
    assert spark.read.parquet(target.path).count() == 3
    state = audit.audit_latest(reports.read_report(spark, root, "audit")).collect()
    assert [r["status"] for r in state] == ["LOADED"]


def test_load_creates_a_table(spark):
    target = migrate.Target("shop" + uuid.uuid4().hex[:6], "dbo", "t")
    migrate.load(spark.range(3), target)
    assert migrate.read_back(spark, target, "LOADED").columns == ["ID"]
    spark.sql(f"DROP DATABASE `{target.database}_{target.schema}` CASCADE")


@pytest.mark.parametrize(("fmt", "options"), [("orc", {}), ("csv", {"header": "true", "inferSchema": "true", "sep": ";"})])
def test_load_into_other_formats(spark, tmp_path, fmt, options):
    target = migrate.Target("shop", "dbo", "t", str(tmp_path / "t"), fmt, options)
    migrate.load(spark.range(3).selectExpr("CAST(id AS int) AS id", "concat('v', id) AS v"), target)
    assert rows_of(migrate.read_back(spark, target, "LOADED")) == [(0, "v0"), (1, "v1"), (2, "v2")]


def test_a_key_too_frequent_for_a_bucket_is_refused(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    name = f"t{uuid.uuid4().hex[:8]}"
    with pytest.raises(ValueError, match="too many for a bucket"):
        migrate.load(rows, migrate.Target("shop", "dbo", name, bucket_by=("k",), buckets=2, most_per_key=1))


def test_texts_that_look_like_null_can_be_moved(spark):
    df = spark.createDataFrame([("NULL", "")], "a string, b string")
    assert rows_of(convert.convert(df, {}, tokens=())) == [("NULL", "")]


def test_tables_bucketed_alike_are_compared_without_a_shuffle(spark):
    database = "shop" + uuid.uuid4().hex[:6]
    sides = [migrate.Target(database, side, "t", bucket_by=("k",), buckets=4) for side in ("a", "b")]
    rows = spark.range(1000).selectExpr("id AS k", "concat('v', id % 7) AS v")
    migrate.load(rows, sides[0])
    migrate.load(rows.selectExpr("k", "CASE WHEN k = 5 THEN 'new' ELSE v END AS v"), sides[1])
    source, target = (diff.normalize(migrate.read_back(spark, t, "LOADED")) for t in sides)
    cells = diff.diff_cells(source, target, ["K"])
    assert rows_of(cells) == [(5, "V", "v5", "new")]
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    assert len(spark.table(sides[0].name).inputFiles()) == 4
    for t in sides:
        spark.sql(f"DROP DATABASE `{t.database}_{t.schema}` CASCADE")


def test_load_into_buckets_counts_rows(spark, tmp_path):
    target = migrate.Target("shop" + uuid.uuid4().hex[:6], "dbo", "t", bucket_by=("id",), buckets=3)
    rows = spark.createDataFrame([(i, "x" if i == 4 else str(i)) for i in range(9)], "_row bigint, id string")
    assert migrate.load_with_rejects(rows, {"id": "int"}, target, str(tmp_path), "r") == "PARTIALLY_LOADED"
    result = reports.read_report(spark, str(tmp_path), "row_validation").first()
    assert (result["rows_parsed"], result["rows_loaded"], result["first_error_line"]) == (9, 8, 4)
    spark.sql(f"DROP DATABASE `{target.database}_{target.schema}` CASCADE")


def test_migrate_many_tables(spark, tmp_path):
    jobs = [
        migrate.Job(lambda n=n: spark.range(n).selectExpr("cast(id as string) id"), {"id": "int"},
                    migrate.Target("shop", "dbo", f"t{n}", str(tmp_path / f"t{n}")))
        for n in (3, 4)
    ]
    root = str(tmp_path / "reports")
    assert migrate.migrate_scope(spark, jobs, root, "r") == {"t3": "LOADED", "t4": "LOADED"}
    assert audit.audit_latest(reports.read_report(spark, root, "audit")).count() == 2


def test_audit_running_table_has_no_end(spark):
    event = audit.audit_event(spark, "r", 1, ("d", "s", "t"), audit.IN_PROGRESS)
    state = audit.audit_latest(event).first()
    assert state["status"] == "IN PROGRESS" and state["end_time"] is None and state["start_time"] is not None


def test_history(spark):
    t1, t2, t3 = (F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp_ntz") for m in (1, 2, 3))

    def snapshot(*rows):
        return spark.createDataFrame(rows, "k int, a string")

    first = history.history_start(snapshot((1, "a"), (2, "b"), (3, "c"), (3, "c")), t1)
    second = history.history_apply(first, snapshot((1, "a"), (2, "B"), (3, "c"), (3, "c"), (4, None)), t2)
    third = history.history_apply(second, snapshot((1, "a"), (3, "c"), (4, None)), t3)
    jan, feb, mar, end = (dt.datetime(y, m, d) for y, m, d in ((2024, 1, 1), (2024, 2, 1), (2024, 3, 1), (9999, 12, 31)))
    assert rows_of(third) == sorted(
        [
            (1, "a", jan, end, "Y"),
            (2, "b", jan, feb, "N"),
            (2, "B", feb, mar, "N"),
            (3, "c", jan, mar, "N"),
            (3, "c", jan, mar, "N"),
            (3, "c", mar, end, "Y"),
            (4, None, feb, end, "Y"),
        ],
        key=repr,
    )


def test_history_keeps_rows_without_a_flag(spark):
    at = [F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp_ntz") for m in (1, 2)]
    snapshot = spark.createDataFrame([(1, "a"), (2, "b")], "k int, a string")
    first = history.history_start(snapshot, at[0]).withColumn("ACTIVE", F.when(F.col("k") == 1, F.col("ACTIVE")))
    second = history.history_apply(first, snapshot, at[1])
    assert sorted((r["k"], str(r["ACTIVE"])) for r in second.collect()) == [(1, "Y"), (2, "None"), (2, "Y")]


def test_versions_of_a_history(spark, tmp_path):
    root = str(tmp_path / "history")
    assert history.read_history(spark, root) is None
    at = [F.lit(f"2024-0{m}-01 00:00:00").cast("timestamp_ntz") for m in (1, 2)]
    snapshots = [spark.createDataFrame(rows, "k int, a string") for rows in ([(1, "a")], [(1, "b")])]
    history.store_history(history.history_start(snapshots[0], at[0]), root)
    # The new version is made of the one before, which is read while it is written.
    history.store_history(history.history_apply(history.read_history(spark, root), snapshots[1], at[1]), root)
    rows = history.read_history(spark, root).collect()
    assert sorted((r["a"], r["ACTIVE"]) for r in rows) == [("a", "N"), ("b", "Y")]
    os.makedirs(f"{root}/version=00000009")  # a write that did not end
    assert history.read_history(spark, root).count() == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(snapshots=st.lists(st.lists(st.tuples(st.integers(0, 2), st.sampled_from(["a", None])), max_size=5), min_size=2, max_size=3))
def test_history_gives_back_every_snapshot(spark, snapshots):
    times = [dt.datetime(2024, m, 1) for m in range(1, len(snapshots) + 1)]
    frames = [spark.createDataFrame(s, "k int, a string") for s in snapshots]
    stamps = [F.lit(t) .cast("timestamp_ntz") for t in times]
    state = history.history_start(frames[0], stamps[0])
    for frame, at in zip(frames[1:], stamps[1:]):
        state = history.history_apply(state, frame, at)
    rows = state.collect()
    for snapshot, at in zip(snapshots, times):
        seen = [(r["k"], r["a"]) for r in rows if r["START_TIME"] <= at < r["END_TIME"]]
        assert sorted(seen, key=repr) == sorted(snapshot, key=repr)


def test_many_copies_are_written_by_several_tasks(spark):
    df = spark.createDataFrame([("hot", 350_000), ("one", 1)], "a string, n bigint")
    spread = history.with_copies(df, "n")
    assert sorted(map(tuple, spread.groupBy("a").count().collect())) == [("hot", 350_000), ("one", 1)]
    assert spread.filter("a = 'hot'").groupBy(F.spark_partition_id()).count().count() > 1


@pytest.fixture(scope="module")
def sides(spark):
    source = testcases.session_with(spark, {"t": lambda s: s.sql("SELECT * FROM VALUES (1, 1.005, 'x'), (2, 2.5, 'y') AS t(k, v, s)")})
    target = testcases.session_with(spark, {"t": lambda s: s.sql("SELECT * FROM VALUES (2, 2.5, 'y'), (1, 1.005, 'X') AS t(k, v, s)")})
    return source, target


@pytest.mark.parametrize(
    ("case", "status", "left", "right"),
    [
        (TestCase("t", "Row_Count\r"), "PASS", "1 rows", "1 rows"),
        (TestCase("t", "SELECT k FROM t"), "PASS", "2 rows", "2 rows"),
        (TestCase("t", "SELECT k FROM t ORDER BY k", True), "PASS", "2 rows", "2 rows"),
        (TestCase("t", "SELECT k FROM t ORDER BY s = 'X', k", True), "FAIL", "2 rows", "2 rows"),
        (TestCase("t", "SELECT max(s) FROM t WHERE s LIKE 'x'"), "FAIL", "1 rows", "1 rows"),
        (TestCase("t", "SELECT sum(v) FROM t"), "PASS", "1 rows", "1 rows"),
        (TestCase("t", "SELECT k FROM t WHERE k > 9"), "PASS", "0 rows", "0 rows"),
        (TestCase("t", "SELECT nope FROM t"), "ERROR", None, "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
        (TestCase("t", "SELEC 1"), "ERROR", None, "PARSE_SYNTAX_ERROR"),
        (TestCase("t", "SELECT k / 0 FROM t"), "ERROR", None, "DIVIDE_BY_ZERO"),
    ],
)
def test_cases(spark, sides, case, status, left, right):
    row = testcases.run_test_cases(spark, [case], *sides).first()
    assert (row["status"], row["target_table_result"]) == (status, right)
    assert row["source_table_result"] == left
    assert row["execution_end_time"] >= row["execution_start_time"]


def test_cases_with_long_results(spark):
    sides = [testcases.session_with(spark, {"r": lambda s, n=n: s.range(n)}) for n in (5000, 5001)]
    cases = [TestCase("r", "SELECT id FROM r"), TestCase("r", "SELECT id FROM r WHERE id < 5000 ORDER BY id", True)]
    rows = testcases.run_test_cases(spark, cases, *sides).orderBy("case_no").collect()
    assert [(r["status"], r["source_table_result"], r["target_table_result"]) for r in rows] == [
        ("FAIL", "5000 rows", "5001 rows"), ("PASS", "5000 rows", "5000 rows"),
    ]
    missing = testcases.result_rows(1, cases[0], *sides).filter("source_copies <> target_copies")
    assert [tuple(r) for r in missing.collect()] == [(1, '["5000"]', 0, 1)]


@pytest.mark.parametrize("n", [3, 1_001, 100_000])
def test_results_have_one_form_at_every_size(spark, n):
    sides = [testcases.session_with(spark, {"r": lambda s, to=to: s.range(to)}) for to in (n, n + 1)]
    case = TestCase("r", "SELECT id FROM r")
    row = testcases.run_test_cases(spark, [case], *sides).first()
    assert (row["status"], row["source_table_result"], row["target_table_result"]) == ("FAIL", f"{n} rows", f"{n + 1} rows")
    rows = testcases.result_rows(7, case, *sides)
    assert rows.columns == ["case_no", "row_values", "source_copies", "target_copies"] and rows.count() == n + 1


def test_run_of_a_case_file_is_reported(spark, sides, tmp_path):
    file, root = tmp_path / "cases.csv", str(tmp_path / "reports")
    file.write_text("table,sql\nt,ROW_COUNT\nt,SELECT s FROM t\nt,SELECT nope FROM t\n")
    testcases.run_case_file(spark, str(file), *sides, root, "r")
    verdicts = reports.read_report(spark, root, "test_results").select("case_no", "status")
    assert rows_of(verdicts) == [(1, "PASS"), (2, "FAIL"), (3, "ERROR")]
    rows = reports.read_report(spark, root, "test_result_rows").select("case_no", "row_values", "source_copies", "target_copies")
    assert rows_of(rows) == [(1, '["2"]', 1, 1), (2, '["X"]', 0, 1), (2, '["x"]', 1, 0), (2, '["y"]', 1, 1)]


def test_result_rows_that_could_not_be_written_are_not_passed_over(spark, sides, tmp_path, monkeypatch):
    file, root = tmp_path / "cases.csv", str(tmp_path / "reports")
    file.write_text("table,sql\nt,ROW_COUNT\nt,SELECT s FROM t\nt,SELECT nope FROM t\n")
    whole = testcases.result_rows

    def broken(number, *case):
        if number == 1:
            raise OSError("disk full")
        return whole(number, *case)

    monkeypatch.setattr(testcases, "result_rows", broken)
    with pytest.raises(RuntimeError, match="of cases 1$"):
        testcases.run_case_file(spark, str(file), *sides, root, "r")
    assert reports.read_report(spark, root, "test_results").count() == 3
    assert {r["case_no"] for r in reports.read_report(spark, root, "test_result_rows").collect()} == {2}


def test_cases_with_different_columns(spark):
    sides = [testcases.session_with(spark, {"t": lambda s, q=q: s.sql(q)}) for q in ("SELECT 1 a", "SELECT 1 a, 2 b")]
    assert testcases.run_test_cases(spark, [TestCase("t", "SELECT * FROM t")], *sides).first()["status"] == "FAIL"


def test_case_file(spark, tmp_path):
    file = tmp_path / "cases.csv"
    file.write_text('table,sql,ordered\nt,ROW_COUNT,\nu,"SELECT a, ""b""\nFROM u",true\n')
    assert testcases.read_cases(spark, str(file)) == [
        TestCase("t", "ROW_COUNT", False), TestCase("u", 'SELECT a, "b"\nFROM u', True),
    ]
    assert [c.table for c in testcases.read_cases(spark, str(file), ["u"])] == ["u"]


def test_run_scope(spark, tmp_path):
    source = spark.createDataFrame([(1, "a"), (2, "b"), (3, "NULL")], "k int, v string")
    target = spark.createDataFrame([(1, "a"), (2, "c"), (3, None), (4, "d")], "k int, v string")
    lost, damaged = str(tmp_path / "lost"), str(tmp_path / "damaged.parquet")
    (tmp_path / "damaged.parquet").write_bytes(b"PAR1 no footer")
    expected = typemap.map_types(spark.createDataFrame(
        [("s", "d", "changed", 1, "k", "int", 10, "NULL", None, 0), ("s", "d", "changed", 2, "v", "varchar", 9, "NULL", None, None)],
        "database string, schema string, table string, ordinal int, column string, data_type string, length int, "
        "is_nullable string, default string, scale int"))
    actual = spark.createDataFrame([("s", "d", "changed", 1, "K", "NUMBER(10,0)"), ("s", "d", "changed", 2, "V", "VARCHAR(5)")],
                                   "database string, schema string, table string, ordinal int, column string, type string")
    tables = [
        reconcile.Table("same", lambda: source, lambda: source, ["k"]),
        reconcile.Table("changed", lambda: source, lambda: target, ["k"], expected=expected, actual=actual),
        reconcile.Table("keyless", lambda: source, lambda: target),
        reconcile.Table("gone", lambda: source, lambda: spark.read.parquet(lost)),
        reconcile.Table("empty", lambda: source, lambda: source.filter("k > 9"), ["k"]),
        reconcile.Table("both_empty", lambda: source.filter("k > 9"), lambda: source.filter("k > 9"), ["k"]),
        reconcile.Table("unreadable", lambda: spark.read.parquet(lost), lambda: target),
        reconcile.Table("no_target", lambda: source, lambda: target.select("nope")),
        reconcile.Table("narrow", lambda: source, lambda: target.drop("v")),
        reconcile.Table("no_key", lambda: source, lambda: target, ["nope"]),
        reconcile.Table("by_position", lambda: source, lambda: source.selectExpr("k", "if(k = 2, 'x', v) AS v"), order_by=["k"]),
        reconcile.Table("wide", lambda: source.drop("v"), lambda: target),
        reconcile.Table("raises", lambda: {}["nothing"], lambda: target),
        reconcile.Table("damaged", lambda: spark.read.schema("k int").parquet(damaged), lambda: target.select("k")),
        reconcile.Table("own_names", lambda: source.selectExpr("k AS status", "v AS column_name", "v AS source_copies"),
                        lambda: target.selectExpr("k AS status", "v AS column_name", "v AS source_copies")),
        reconcile.Table("broken", lambda: source.selectExpr("k / 0 AS k"), lambda: source.select("k")),
    ]
    root = str(tmp_path / "reports")
    reconcile.run_scope(spark, tables, root, "run-1", threads=4)
    verdicts = {r["table_name"]: (r["result_status"], r["source_record_count"], r["target_record_count"])
                for r in reports.read_report(spark, root, "data_report").orderBy("created_on").collect()}
    assert verdicts == {
        "no_key": ("Not-Matched", 3, 4),
        "by_position": ("Not-Matched", 3, 3),
        "same": ("Matched", 3, 3),
        "changed": ("Not-Matched", 3, 4),
        "keyless": ("Not-Matched", 3, 4),
        "gone": ("Table does not exist in snowflake", 3, 0),
        "empty": ("Table has no data", 3, 0),
        "both_empty": ("Matched", 0, 0),
        "unreadable": ("Error while fetching data from SQL server, validation failed", None, None),
        "no_target": ("Error while fetching data from snowflake, validation failed", None, None),
        "narrow": ("Data Comparison failed due to some error", None, None),
        "wide": ("Data Comparison failed due to some error", None, None),
        "raises": ("Error while fetching data from SQL server, validation failed", None, None),
        "damaged": ("Data Comparison failed due to some error", None, None),
        "own_names": ("Not-Matched", 3, 4),
        "broken": ("Data Comparison failed due to some error", None, None),
    }
    statuses = reports.read_report(spark, root, "data_report").filter("table_name = 'no_key'").select("result_status")
    assert {r[0] for r in statuses.collect()} == {
        "Not-Matched", "Error while fetching Primary keys, validation on first few column order"}
    detail = reports.read_report(spark, root, "data_detail")
    changed = detail.filter("table_name = 'changed'").select("row_key", "status", "column_name", "source_value", "target_value")
    assert rows_of(changed) == [('["2"]', "changed", "v", "b", "c"), ('["4"]', "extra_in_target", None, "0", "1")]
    moved = detail.filter("table_name = 'by_position'").select("row_key", "status", "column_name", "source_value", "target_value")
    assert rows_of(moved) == [('["2"]', "changed", "v", "b", "x")]
    assert detail.filter("table_name = 'keyless'").count() == 3
    assert detail.filter("table_name = 'own_names'").count() == 3
    assert detail.filter("table_name in ('same', 'both_empty')").count() == 0
    assert reports.read_report(spark, root, "schema_report").first()["result_status"] == "Not-valid"
    assert [r["column_name"] for r in reports.read_report(spark, root, "schema_mismatch").collect()] == ["V"]


def test_scope_list(spark, tmp_path):
    scope = spark.createDataFrame([("s", "d", "b"), ("s", "d", "a")], "database string, schema string, table string")
    keys = spark.createDataFrame([("s", "d", "a", 2, "K,V")],
                                 "database string, schema string, table string, key_size bigint, key_columns string")
    rows = spark.createDataFrame([(1, "x", 1)], "k int, v string, n int")
    tables = reconcile.tables_of(scope, lambda *name: rows, lambda *name: rows.withColumn("n", F.lit(len(name[2]) + 1)), keys)
    assert [(t.name, list(t.keys)) for t in tables] == [("s.d.a", ["K", "V"]), ("s.d.b", [])]
    root = str(tmp_path / "reports")
    reconcile.run_scope(spark, tables, root, "r")
    detail = reports.read_report(spark, root, "data_detail").select("table_name", "row_key", "column_name", "source_value")
    assert ("s.d.a", '["1","x"]', "n", "1") in rows_of(detail) and detail.count() == 3


def test_row_counts_of_one_pair(spark):
    pair = reconcile.Pair("t", spark.range(3), spark.range(4))
    assert tuple(reconcile.row_counts([pair]).first()) == ("t", 3, 4, "Not-Matched")


def test_scratch_of_a_block_is_deleted_with_it(spark):
    kept = write_through(spark.range(3), "kept")
    with temporary_scratch(spark):
        inner = write_through(spark.range(5), "inner")
        assert inner.count() == 5
    assert kept.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        inner.collect()


@several_texts
def test_staged_lines_give_back_any_value(spark, tmp_path_factory, values):
    path = str(tmp_path_factory.mktemp("staged") / "rows")
    staged.stage(spark.createDataFrame([(v,) for v in values], "a string"), path, "csv")
    rows = staged.read_staged_csv(spark, path, ["a"]).orderBy("_row").select("a").collect()
    assert [r["a"] or "" for r in rows] == [v or "" for v in values]


def test_scratch_is_in_the_folder_the_session_names(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    other = f"{root}/another-application"
    spark.range(1).write.parquet(other)
    frame = write_through(spark.range(3), "x")
    assert frame.inputFiles()[0].removeprefix("file://").startswith(f"{root}/reconcile-") and frame.count() == 3
    clear_scratch(spark)
    assert not os.path.exists(f"{root}/reconcile-{spark.sparkContext.applicationId}")
    assert spark.read.parquet(other).count() == 1


def test_shuffle_partitions_grow_with_the_data():
    sizes = (10**6, 10**12, 50 * 10**12)
    assert [shuffle_partitions(n) for n in sizes] == [200, 7451, 50_000]
    assert [split_bytes(n) for n in sizes] == [2**27, 2**27, 2**30]
