"""Histories of many snapshots, code without comments, key ranges, the session's catalog, names in any case."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reconcile.operators import analyze, catalog, convert, history, typemap
from reconcile.plans import migrate, reconcile, reports
from reconcile.sources import staged, tables


def _times(n):
    return [dt.datetime(2024, 1, 1) + dt.timedelta(days=i * i) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_many_snapshots_are_as_if_one_by_one(spark, seed):
    draw = random.Random(seed)
    times = _times(8)
    empty = draw.randrange(1, 8)
    snapshots = []
    for i in range(8):
        rows = [(draw.choice([1, 2, 3, None]), draw.choice(["a", None])) for _ in range(draw.randrange(6))]
        snapshots.append([] if i == empty else rows)
    schema = "k int, v string"
    frames = [spark.createDataFrame(rows, schema) for rows in snapshots]
    state = history.history_start(frames[0], F.lit(times[0]).cast("timestamp_ntz"))
    for frame, at in zip(frames[1:], times[1:], strict=True):
        state = history.history_apply(state, frame, F.lit(at).cast("timestamp_ntz"))
    whole = spark.createDataFrame([(*r, t) for rows, t in zip(snapshots, times, strict=True) for r in rows] + [(9, "x", None)], schema + ", at timestamp_ntz")
    taken = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    rebuilt = history.history_rebuild(whole, "AT", taken)
    assert rebuilt.columns == state.columns
    assert sorted(map(repr, rebuilt.collect())) == sorted(map(repr, state.collect()))


def test_a_row_of_very_many_copies_in_every_snapshot(spark, monkeypatch):
    monkeypatch.setattr(history, "COPIES_PER_BLOCK", 100)
    rows = spark.range(3000).selectExpr("'same' AS v", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id % 3 AS int)) AS at")
    rebuilt = history.history_rebuild(rows, "at")
    assert rebuilt.count() == 1000 and rebuilt.distinct().count() == 1


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("a -- b 'c\nd", "a  \nd"), ("a /* b -- c\n*/ d", "a   d"), ("a /* b /* c */ d */ e", "a   e"), ("a 'it''s -- b' c", "a   c"),
        ("a '/* b' c '*/' d", "a   c   d"), ("[a]]b] c", "  c"), ('"x""y" z', "  z"), ("a 'never ends", "a  "), ("a /* never ends", "a  "),
        ("a - b / c * d", "a - b / c * d"), ("N'x' y", "  y"), ("--", " "), ("", ""), ("'" + "x''" * 5000 + "'", " "), ("/*" + "x* / " * 5000 + "*/b", " b"),
    ],
)
def test_code_without_comments_and_literals(spark, text, code):
    assert spark.createDataFrame([(text,)], "t string").select(analyze.code_only(F.col("t"))).first()[0] == code


def test_keywords_of_code(spark):
    texts = spark.createDataFrame([(1, "SELECT goto -- goto\n FROM [goto]"), (2, "-- goto"), (3, None)], "id int, t string")
    hits = analyze.scan_keywords(texts, "id", "t", ["goto"], code=True)
    assert [tuple(r) for r in hits.collect()] == [(1, "goto", 1)]
    verdicts = analyze.keyword_verdict(texts, "id", "t", ["goto"], code=True).orderBy("id").collect()
    assert [r["verdict"] for r in verdicts] == ["needs work", "converts", "converts"]


def test_key_bounds_share_rows_evenly(spark):
    rows = spark.range(50_000).selectExpr("id * id AS k")
    ranges = tables.key_range_predicates("k", tables.key_bounds(rows, "k", 10))
    counts = [rows.filter(r).count() for r in ranges]
    assert len(counts) == 10 and sum(counts) == 50_000 and max(counts) - min(counts) < 100
    # A key that fills several ranges takes one; null keys are in the first.
    hot = spark.range(1000).selectExpr("CASE WHEN id < 600 THEN 5 WHEN id < 700 THEN NULL ELSE id END AS k")
    ranges = tables.key_range_predicates("k", tables.key_bounds(hot, "k", 8))
    assert sum(hot.filter(r).count() for r in ranges) == 1000
    assert tables.key_bounds(rows.filter("k < 0"), "k", 4) == [] and tables.key_bounds(rows, "k", 1) == []


def test_session_catalog(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS scanned")
    spark.sql("CREATE TABLE scanned.odd_name (a INT NOT NULL COMMENT 'first', `b,c` STRING DEFAULT 'x', d DECIMAL(9,2)) USING parquet CLUSTERED BY (a) INTO 2 BUCKETS")
    spark.sql("CREATE TABLE scanned.plain (v VARIANT) USING parquet")
    try:
        rows = catalog.session_catalog(spark, ["scanned"]).orderBy("table", "ordinal").collect()
        assert [(r["table"], r["column"], r["type"], r["comment"], r["bucket_columns"]) for r in rows] == [
            ("odd_name", "a", "int", "first", ["a"]), ("odd_name", "b,c", "string", None, ["a"]),
            ("odd_name", "d", "decimal(9,2)", None, ["a"]), ("plain", "v", "variant", None, None),
        ]
        assert rows[1]["default"] == "'x'"
        assert "scanned" in {r["schema"] for r in catalog.session_catalog(spark).collect()}
    finally:
        spark.sql("DROP DATABASE scanned CASCADE")


def test_names_in_any_case(spark):
    df = spark.createDataFrame([(True, "a&#x0D;b", "7")], "ok boolean, doc string, n string")
    rows = convert.convert(df, {"OK": "bit", "DOC": "xml"}, {"N": "int"})
    assert [tuple(r) for r in rows.collect()] == [(1, "a b", 7)]
    with pytest.raises(ValueError, match="no column gone"):
        convert.convert(df, {"gone": "bit"})
    checked = staged.check_rows(df.withColumn("_row", F.lit(1)), {"N": "int"})
    assert [tuple(r) for r in staged.good_rows(checked, {"N": "int"}).collect()] == [(7,)]
    with pytest.raises(ValueError, match="no column M"):
        staged.check_rows(df, {"M": "int"})
    assert typemap.fit_check(df, {"N": "tinyint"}).first()["misfits"] == 0


def test_keys_with_commas(spark):
    scope = spark.createDataFrame([("s", "d", "t")], "database string, schema string, table string")
    def keys(size, text):
        return spark.createDataFrame([("s", "d", "t", size, text)], "database string, schema string, table string, key_size bigint, key_columns string")

    read = lambda *name: None
    assert list(reconcile.tables_of(scope, read, read, keys(1, "A,B"))[0].keys) == ["A,B"]
    with pytest.raises(ValueError, match="give the key as an array"):
        reconcile.tables_of(scope, read, read, keys(2, "A,B,C"))
    listed = spark.createDataFrame([("s", "d", "t", ["A,B", "C"])], "database string, schema string, table string, key_list array<string>")
    assert list(reconcile.tables_of(scope, read, read, listed)[0].keys) == ["A,B", "C"]


def test_files_are_loaded_with_the_places_of_rejects(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.csv").write_text('a,b\n1,"x\ny"\nq,2\n3,z\\,z\n4\n')
    target = migrate.Target("s", "d", "t", str(tmp_path / "t"))
    status = migrate.load_files(spark, str(tmp_path / "in"), {"a": "int", "b": "string"}, target, str(tmp_path / "r"), "run", multi_line=True)
    assert status == staged.PARTIALLY_LOADED
    assert sorted(tuple(r) for r in spark.read.parquet(target.path).collect()) == [(1, "x\ny"), (3, "z,z")]
    rejects = reports.read_report(spark, str(tmp_path / "r"), "rejects").orderBy("row_number").collect()
    assert [(r["row_number"], r["row_start_line"], r["byte_offset"], r["character"], r["rejected_record"]) for r in rejects] == [
        (2, 4, 12, 1, "q,2"), (4, 6, 23, 2, "4"),
    ]
