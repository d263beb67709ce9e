"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reconcile.operators import analyze, audit, catalog, convert, diff, history, schema, testcases, typemap, xml
from reconcile.operators.frames import union_all
from reconcile.plans import migrate, reconcile, reports
from reconcile.plans.reconcile import Pair
from reconcile.session import scratch_path
from reconcile.sources import records, staged, tables
from workload.planted import planted, table

KEYWORDS = ("with", "for", "of", "and", "or", "merge", "cursor", "goto", "on", "le", "der")

DECLARED = {
    "o_orderkey": "tinyint",
    "o_orderstatus": "varchar(1)",
    "o_orderpriority": "varchar(8)",
    "o_totalprice": "decimal(7,2)",
}

LOAD_TYPES = {"o_orderkey": "bigint", "o_totalprice": "double", "o_orderdate": "date"}

SPELLED_TYPES = {
    "day": "DATE", "clock": "TIME(9)", "price": "NUMBER(18,4)", "flag": "BOOLEAN",
}

HISTORY_FROM, HISTORY_AT = "2024-01-01 00:00:00", "2024-02-01 00:00:00"

CASES = (
    testcases.TestCase("orders", "row_count\r"),
    testcases.TestCase("orders", "SELECT min(o_custkey) FROM orders"),
    testcases.TestCase("orders", "SELECT sum(CAST(o_totalprice AS DECIMAL(18,4))) FROM orders"),
    testcases.TestCase("customer", "SELECT sum(CAST(c_acctbal AS DECIMAL(18,4))) FROM customer"),
    testcases.TestCase("documents", "SELECT count(*) FROM documents WHERE lang = 'en'"),
    testcases.TestCase(
        "customer", "SELECT c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment ORDER BY c_mktsegment", True
    ),
    testcases.TestCase("orders", "SELECT o_orderkey, o_totalprice FROM orders"),
    testcases.TestCase("customer", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", True),
    testcases.TestCase("customer", "SELECT nope FROM customer"),
)

# The cases whose result rows are listed: those without sums, which engines spell differently.
ROW_CASES = (1, 2, 5, 6, 7, 8)


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Dates, and the far end of history, as text: readers of results differ in what they hold."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    source, target = planted(spark, sf_dir, "src_orders"), planted(spark, sf_dir, "tgt_orders")
    return diff.normalize(source), diff.normalize(target)


def cell_diff(spark, sf_dir):
    return diff.diff_cells(*_sides(spark, sf_dir), ["o_orderkey"])


def cell_diff_summary(spark, sf_dir):
    return diff.summarize_cells(cell_diff(spark, sf_dir))


def cell_diff_types(spark, sf_dir):
    source, target = planted(spark, sf_dir, "typed_source"), planted(spark, sf_dir, "typed_target")
    types = {"day": "DATE"}
    return diff.diff_cells(diff.normalize(source, types), diff.normalize(target, types), ["o_orderkey"])


def cell_diff_repeated_keys(spark, sf_dir):
    source, target = table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "taxed_lineitem")
    return diff.diff_cells(source, target, ["l_orderkey", "l_linenumber"])


def diff_ambiguous_keys(spark, sf_dir):
    source, target = table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "taxed_lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    return diff.diff_keys(diff.surplus_rows(source, target), keys, diff.AMBIGUOUS)


def diff_missing_extra(spark, sf_dir):
    return diff.diff_missing_extra(*_sides(spark, sf_dir), ["o_orderkey"])


def cell_diff_positional(spark, sf_dir):
    source, target = table(spark, sf_dir, "supplier"), planted(spark, sf_dir, "tgt_supplier")
    # A key, so no rows tie.
    return diff.diff_positional(source, target, ["s_suppkey"], ties=False)


def multiset_diff(spark, sf_dir):
    return diff.diff_multiset(table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "tgt_lineitem"))


def normalize_rows(spark, sf_dir):
    return diff.normalize(planted(spark, sf_dir, "spelled_orders"), SPELLED_TYPES)


def row_counts(spark, sf_dir):
    source, target = planted(spark, sf_dir, "src_orders"), planted(spark, sf_dir, "tgt_orders")
    items = table(spark, sf_dir, "lineitem")
    gone = reconcile.open_table(lambda: table(spark, sf_dir, "no_such_table"))
    return reconcile.row_counts(
        [
            Pair("orders", source, target),
            Pair("lineitem", items, planted(spark, sf_dir, "tgt_lineitem")),
            Pair("customer", table(spark, sf_dir, "customer"), table(spark, sf_dir, "customer")),
            # Another pair of that name.
            Pair("customer", table(spark, sf_dir, "supplier"), table(spark, sf_dir, "supplier")),
            Pair("part", table(spark, sf_dir, "part"), gone),
            Pair("events", table(spark, sf_dir, "events"), table(spark, sf_dir, "events").filter("event_id < 0")),
        ]
    )


def file_counts(spark, sf_dir):
    """Record counts from the footers of files."""
    scope = [("orders", "orders", "orders"), ("customer", "customer", "supplier"), ("part", "part", "no_such_table"), ("events", "events", "events")]
    return reconcile.file_counts(spark, [(name, f"{sf_dir}/{a}.parquet", f"{sf_dir}/{b}.parquet") for name, a, b in scope])


def ordinals_with_ties(spark, sf_dir):
    """Rows numbered in an order in which most of them tie: where each group of equal rows begins and ends.

    Distinct numbers are counted as bits of words of 64, so that not every number is a group.
    """
    keys = ["l_returnflag", "l_linestatus", "l_quantity"]
    numbered = diff.with_ordinals(table(spark, sf_dir, "lineitem").select(*keys), keys)
    words = numbered.groupBy(*keys, F.expr("row_number DIV 64").alias("word")).agg(
        F.min("row_number").alias("first_row"),
        F.max("row_number").alias("last_row"),
        F.bit_count(F.bit_or(F.expr("shiftleft(1L, CAST(row_number % 64 AS int))"))).alias("numbers"),
    )
    return words.groupBy(*keys).agg(
        F.min("first_row").alias("first_row"), F.max("last_row").alias("last_row"), F.sum("numbers").alias("numbers")
    )


def reconcile_report(spark, sf_dir):
    return reconcile.reconcile(
        [
            Pair("orders", planted(spark, sf_dir, "src_orders"), planted(spark, sf_dir, "tgt_orders"), ["o_orderkey"]),
            Pair("lineitem", table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "tgt_lineitem")),
            Pair("customer", table(spark, sf_dir, "customer"), table(spark, sf_dir, "customer"), ["c_custkey"]),
            Pair("part", table(spark, sf_dir, "part"), None),
            Pair("events", table(spark, sf_dir, "events"), table(spark, sf_dir, "events").filter("event_id < 0")),
        ]
    )


def validate_detail(spark, sf_dir):
    """Every difference of a table without a key."""
    pair = Pair("lineitem", table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "tgt_lineitem"))
    return reconcile.differences(pair, diff.surplus_rows(*pair.sides()))


def scope_report(spark, sf_dir):
    """The verdicts of a whole run, read back from its report."""
    def read(name):
        return lambda: table(spark, sf_dir, name)

    scope = [
        reconcile.Table("orders", lambda: planted(spark, sf_dir, "src_orders"), lambda: planted(spark, sf_dir, "tgt_orders"), ["o_orderkey"]),
        reconcile.Table("lineitem", read("lineitem"), lambda: planted(spark, sf_dir, "tgt_lineitem")),
        reconcile.Table("customer", read("customer"), read("customer"), ["c_custkey"]),
        reconcile.Table("supplier", read("supplier"), lambda: planted(spark, sf_dir, "tgt_supplier"), order_by=["s_suppkey"]),
        reconcile.Table("part", read("part"), read("no_such_table"), ["p_partkey"]),
        reconcile.Table("nation", read("no_such_table"), read("nation")),
        reconcile.Table("events", read("events"), lambda: table(spark, sf_dir, "events").drop("props")),
    ]
    root = scratch_path(spark, "scope-report")
    reconcile.run_scope(spark, scope, root, "run-1")
    report = reports.read_report(spark, root, "data_report")
    stamped = F.col("created_on").isNotNull() & (F.col("created_by") == F.current_user())
    return report.select(
        "run_id", "source_dbms", "target_dbms", "table_name", "result_status", "source_record_count",
        "target_record_count", stamped.alias("stamped"),
    )


def key_profile(spark, sf_dir):
    items, orders = table(spark, sf_dir, "lineitem"), planted(spark, sf_dir, "src_orders")
    return union_all(
        [
            catalog.key_profile(items, ["l_orderkey", "l_linenumber"], "lineitem"),
            catalog.key_profile(orders, ["o_orderkey"], "orders"),
            catalog.key_profile(diff.normalize(orders), ["o_orderstatus"], "orders"),
        ]
    )


def key_columns(spark, sf_dir):
    return catalog.key_columns(planted(spark, sf_dir, "constraints"), planted(spark, sf_dir, "usage"))


def column_profile(spark, sf_dir):
    return catalog.profile_columns(planted(spark, sf_dir, "src_orders"))


def declared_profile(spark, sf_dir):
    """The columns of a table as it describes itself, taken for its catalog, beside its data."""
    items = table(spark, sf_dir, "lineitem")
    described = catalog.describe(items, "shop", "dbo", "lineitem")
    no_number = F.lit(None).cast("int")
    information_schema = described.select(
        F.col("database").alias("TABLE_CATALOG"), F.col("schema").alias("TABLE_SCHEMA"), F.col("table").alias("TABLE_NAME"),
        F.col("ordinal").alias("ORDINAL_POSITION"), F.upper("column").alias("COLUMN_NAME"), F.col("type").alias("DATA_TYPE"),
        F.when(F.col("type") == "string", 10).alias("CHARACTER_MAXIMUM_LENGTH"),
        F.when(F.col("type").isin("bigint", "int"), 19).alias("NUMERIC_PRECISION"),
        F.when(F.col("type") == "timestamp_ntz", 6).alias("DATETIME_PRECISION"),
        F.when(F.col("ordinal") == 1, "NO").otherwise("YES").alias("IS_NULLABLE"),
        F.lit(None).cast("string").alias("COLUMN_DEFAULT"), no_number.alias("NUMERIC_SCALE"),
    )
    return catalog.profile_columns(items, catalog.catalog_rows(information_schema))


def analyze_tables(spark, sf_dir):
    return analyze.analyze(planted(spark, sf_dir, "scope"), planted(spark, sf_dir, "catalog"))


def analyze_totals(spark, sf_dir):
    return analyze.analysis_totals(analyze_tables(spark, sf_dir))


def map_types(spark, sf_dir):
    mapped = typemap.map_types(planted(spark, sf_dir, "catalog"))
    return mapped.drop("is_nullable", "default", "length", "scale")


def fit_check(spark, sf_dir):
    return typemap.fit_check(planted(spark, sf_dir, "src_orders"), DECLARED)


def _comparison(spark, sf_dir):
    return schema.compare_schema(typemap.map_types(planted(spark, sf_dir, "catalog")), planted(spark, sf_dir, "actual"))


def schema_mismatch(spark, sf_dir):
    return schema.schema_mismatches(_comparison(spark, sf_dir))


def schema_verdict(spark, sf_dir):
    return schema.schema_verdicts(_comparison(spark, sf_dir))


def extract_filtered(spark, sf_dir):
    return tables.extract(
        table(spark, sf_dir, "orders"),
        columns=["o_orderkey", "o_custkey", "o_totalprice"],
        where=(F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") == "F"),
    )


def convert_rows(spark, sf_dir):
    return convert.convert(planted(spark, sf_dir, "conv_orders"), {"flag": "bit", "note": "xml"})


def _checked(spark, sf_dir):
    return staged.check_rows(planted(spark, sf_dir, "raw_orders"), LOAD_TYPES)


def load_good(spark, sf_dir):
    return _as_text(staged.good_rows(_checked(spark, sf_dir), LOAD_TYPES), "o_orderdate")


def load_rejects(spark, sf_dir):
    return staged.reject_rows(_checked(spark, sf_dir), LOAD_TYPES).drop("file")


def load_result(spark, sf_dir):
    # The rows come from a table, so there is no file and no position in one.
    return staged.load_result(_checked(spark, sf_dir), LOAD_TYPES).drop("file", "first_error_character")


def fine_rejects(spark, sf_dir):
    """Values of which a type would keep only a part."""
    rows = planted(spark, sf_dir, "fine_orders").withColumn("whole", F.col("whole").cast("double"))
    types = {"whole": "int", "cents": "decimal(12,2)"}
    return staged.reject_rows(staged.check_rows(rows, types), types).drop("file")


def load_readback(spark, sf_dir):
    """Rows loaded under audit and read back from the target."""
    root = scratch_path(spark, "load-readback")
    target = migrate.Target("shop", "dbo", "orders", os.path.join(root, "orders"))
    raw = planted(spark, sf_dir, "raw_orders")
    status = migrate.migrate_table(spark, lambda: raw, LOAD_TYPES, target, os.path.join(root, "reports"), "run-1")
    return _as_text(migrate.read_back(spark, target, status), "O_ORDERDATE")


def load_audit(spark, sf_dir):
    """The last state of every table of a run, with what its load counted."""
    root = scratch_path(spark, "load-audit")
    where, reported = os.path.join(root, "tables"), os.path.join(root, "reports")

    def job(name, read, types):
        return migrate.Job(read, types, migrate.Target("shop", "dbo", name, os.path.join(where, name)))

    jobs = [
        job("orders", lambda: planted(spark, sf_dir, "raw_orders"), LOAD_TYPES),
        job("customer", lambda: table(spark, sf_dir, "customer"), {"c_custkey": "bigint", "c_name": "string"}),
        job("part", lambda: table(spark, sf_dir, "no_such_table"), {"p_partkey": "bigint"}),
        # Loaded twice: the second load replaces the first.
        job("supplier", lambda: table(spark, sf_dir, "supplier"), {"s_suppkey": "bigint"}),
    ]
    migrate.migrate_scope(spark, jobs, reported, "run-1")
    migrate.migrate_scope(spark, jobs[-1:], reported, "run-2")
    states = audit.audit_latest(reports.read_report(spark, reported, "audit"))
    counts = reports.read_report(spark, reported, "row_validation").select(
        "run_id", F.col("file").alias("table_name"), "rows_parsed", "rows_loaded", "errors_seen"
    )
    ended = F.col("end_time") >= F.col("start_time")
    return states.join(counts, ["run_id", "table_name"], "left").select(
        "run_id", "table_name", "status", ended.alias("ended"), "rows_parsed", "rows_loaded", "errors_seen"
    )


def staged_rejects(spark, sf_dir):
    """What a load rejects of foreign CSV files with rows of the wrong shape."""
    path = os.path.join(scratch_path(spark, "foreign"), "orders")
    header = ",".join(LOAD_TYPES)
    # A line has neither this separator nor a quote, so it is written as it is.
    planted(spark, sf_dir, "raw_lines").toDF(header).write.options(header="true", sep="\x01").csv(path)
    raw = staged.read_staged_csv(spark, path, list(LOAD_TYPES), numbered=False, multi_line=False)
    checked = staged.with_file_rows(staged.check_rows(raw, LOAD_TYPES))
    rejects = staged.reject_rows(checked, LOAD_TYPES)
    # Which file and row a line is in is the writer's choice; that they are told is not.
    return rejects.withColumn("placed", F.col("file").isNotNull() & (F.col("row_number") >= 1)).drop("file", "row_number")


FOREIGN_TYPES = {"o_orderkey": "bigint", "o_custkey": "int", "note": "string"}


def _foreign_files(spark, sf_dir):
    """Files with escapes and quotes, one for each part."""
    path = os.path.join(scratch_path(spark, "escaped"), "orders")
    rows = planted(spark, sf_dir, "escaped_records")
    heads = rows.select("part").distinct().select(F.lit(-1).cast("bigint").alias("o_orderkey"), "part", F.lit(",".join(FOREIGN_TYPES)).alias("record"))
    placed = rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "o_orderkey")
    placed.select("part", "record").write.partitionBy("part").text(path)
    return path


def _foreign(spark, sf_dir):
    """Their lines, and their records, checked."""
    path = _foreign_files(spark, sf_dir)
    lines = records.read_lines(spark, path)
    parsed = records.parse_records(lines, list(FOREIGN_TYPES), multi_line=True)
    return lines, staged.check_rows(parsed, FOREIGN_TYPES)


def escaped_load(spark, sf_dir):
    """The good rows of delimited files with escapes, quotes and line breaks."""
    return staged.good_rows(_foreign(spark, sf_dir)[1], FOREIGN_TYPES)


def escaped_rejects(spark, sf_dir):
    """The others, and where in their files they stand."""
    lines, checked = _foreign(spark, sf_dir)
    rejects = records.reject_records(checked, lines, FOREIGN_TYPES)
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("int")
    return rejects.withColumn("part", part).drop("file")


def staged_load(spark, sf_dir):
    """The raw rows written as CSV files and loaded back from them."""
    path = os.path.join(scratch_path(spark, "staged"), "orders")
    staged.stage(planted(spark, sf_dir, "raw_orders").select(*LOAD_TYPES), path, "csv")
    raw = staged.read_staged_csv(spark, path, list(LOAD_TYPES))
    return _as_text(staged.good_rows(staged.check_rows(raw, LOAD_TYPES), LOAD_TYPES), "o_orderdate")


def xml_validity(spark, sf_dir):
    return xml.check_xml(planted(spark, sf_dir, "xml_orders"), "doc").drop("doc")


def xml_totals(spark, sf_dir):
    return xml.xml_totals(planted(spark, sf_dir, "xml_orders"), "doc")


XML_TYPES = {"o_orderkey": "bigint", "doc": "variant"}


def _xml_checked(spark, sf_dir):
    rows = planted(spark, sf_dir, "xml_documents").withColumn("_row", F.col("o_orderkey"))
    return staged.check_rows(rows, XML_TYPES)


def load_xml(spark, sf_dir):
    """Documents loaded as values with fields, and some of their fields."""
    return staged.good_rows(_xml_checked(spark, sf_dir), XML_TYPES).selectExpr(
        "o_orderkey", "variant_get(doc, '$.p._id', 'bigint') AS id", "variant_get(doc, '$.p.k', 'bigint') AS custkey",
        "variant_get(doc, '$.p.s', 'string') AS orderstatus", "variant_get(doc, '$.p.i[1]', 'int') AS second_item",
    )


def load_xml_rejects(spark, sf_dir):
    """Documents that are not well-formed."""
    return staged.reject_rows(_xml_checked(spark, sf_dir), {"doc": "variant"}).drop("file", "rejected_record")


def xml_cell_diff(spark, sf_dir):
    """Cells that differ where only columns of well-formed documents count as equal."""
    source, target = planted(spark, sf_dir, "xml_documents"), planted(spark, sf_dir, "xml_spelled")
    pair = Pair("orders", source, target, ["o_orderkey"], xml_columns=["DOC", "NOTE"])
    return reconcile.differences(pair, diff.surplus_rows(*pair.sides()))


def keyword_scan(spark, sf_dir):
    return analyze.scan_keywords(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


def keyword_verdict(spark, sf_dir):
    return analyze.keyword_verdict(table(spark, sf_dir, "documents"), "doc_id", "text", KEYWORDS)


def _case_sides(spark, sf_dir):
    names = ("orders", "customer", "documents")
    source = {n: f"{sf_dir}/{n}.parquet" for n in names}
    target = {**source, "orders": lambda session: planted(session, sf_dir, "tgt_orders")}
    return testcases.session_with(spark, source), testcases.session_with(spark, target)


def test_case_results(spark, sf_dir):
    report = testcases.run_test_cases(spark, CASES, *_case_sides(spark, sf_dir))
    return report.drop("execution_start_time", "execution_end_time")


def test_case_rows(spark, sf_dir):
    """All result rows of some of the cases, with their copies on either side."""
    sides = _case_sides(spark, sf_dir)
    return union_all([testcases.result_rows(number, CASES[number - 1], *sides) for number in ROW_CASES])


def case_file(spark, sf_dir):
    """Cases read from a file and run, and their verdicts read back from the report."""
    root = scratch_path(spark, "case-file")
    cases = [(c.table, c.sql, str(c.ordered).lower()) for c in CASES]
    rows = spark.createDataFrame(cases, "table string, sql string, ordered string").coalesce(1)
    rows.write.options(header="true", escape='"').csv(os.path.join(root, "cases"))
    testcases.run_case_file(spark, os.path.join(root, "cases"), *_case_sides(spark, sf_dir), os.path.join(root, "reports"), "run-1")
    report = reports.read_report(spark, os.path.join(root, "reports"), "test_results")
    return report.select(
        "run_id", "case_no", "source_table_name", "status",
        (F.col("execution_end_time") >= F.col("execution_start_time")).alias("timed"),
    )


def audit_latest(spark, sf_dir):
    return _as_text(audit.audit_latest(planted(spark, sf_dir, "audit")), "start_time", "end_time")


def history_apply(spark, sf_dir):
    start, at = (F.lit(t).cast("timestamp_ntz") for t in (HISTORY_FROM, HISTORY_AT))
    first = history.history_start(diff.normalize(planted(spark, sf_dir, "src_orders")), start)
    state = history.history_apply(first, diff.normalize(planted(spark, sf_dir, "tgt_orders")), at)
    return _as_text(state, history.START, history.END)


def history_rebuild(spark, sf_dir):
    """The history of ten snapshots at once, one of them without a row."""
    taken = spark.range(10).select(F.format_string("2024-01-%d 00:00:00", F.col("id") + 10).alias("taken"))
    state = history.history_rebuild(planted(spark, sf_dir, "snapshots"), "taken", taken)
    return _as_text(state, history.START, history.END)


def object_keywords(spark, sf_dir):
    """Keywords in the code of objects, not in their comments, literals and quoted names."""
    return analyze.scan_keywords(planted(spark, sf_dir, "object_texts"), "object_id", "code", ("merge", "goto", "cursor"), code=True)


def object_verdict(spark, sf_dir):
    verdicts = analyze.keyword_verdict(planted(spark, sf_dir, "object_texts"), "object_id", "code", ("merge", "goto", "cursor"), code=True)
    return verdicts.groupBy("verdict", "remark").agg(F.count("*").alias("objects"), F.sum("hits").alias("hits"))


def key_ranges(spark, sf_dir):
    """Whether reads by key range share the rows of a table evenly, and miss none."""
    items, n = table(spark, sf_dir, "lineitem"), 16
    ranges = tables.key_range_predicates("l_orderkey", tables.key_bounds(items, "l_orderkey", n))
    counts = items.select(F.explode(F.array(*[F.when(F.expr(r), i) for i, r in enumerate(ranges, start=1)])).alias("range_no"))
    counts = counts.dropna().groupBy("range_no").agg(F.count("*").alias("rows"))
    total = items.count()
    covered = F.sum("rows").over(Window.partitionBy(F.lit(0))) == total  # a row per range
    return counts.select("range_no", F.col("rows").between(0.9 * total / n, 1.1 * total / n).alias("even"), covered.alias("covered"))


def catalog_scan(spark, sf_dir):
    """The columns of loaded tables, as the session's own catalog has them."""
    database = f"scan_{uuid.uuid4().hex}"
    nations = migrate.Target(database, "dbo", "nation", bucket_by=("n_regionkey", "n_nationkey"), buckets=2)
    migrate.load(table(spark, sf_dir, "nation"), nations)
    migrate.load(planted(spark, sf_dir, "conv_orders"), migrate.Target(database, "dbo", "orders"))
    try:
        found = catalog.session_catalog(spark, [f"{database}_dbo"])
        return found.select("table", "ordinal", "column", "type", "nullable", F.array_join("bucket_columns", ",").alias("buckets"))
    finally:
        spark.sql(f"DROP DATABASE {nations.container} CASCADE")


def scope_keys_report(spark, sf_dir):
    """A run over a scope whose keys come from a catalog; one key column has a comma in its name."""
    def renamed(name):
        rows = planted(spark, sf_dir, name)
        return rows.toDF("order,key", *rows.columns[1:])

    usage = [("pk_orders", "shop", "dbo", "orders", "order,key", 1), ("pk_items", "shop", "dbo", "items", "l_linenumber", 2),
             ("pk_items", "shop", "dbo", "items", "l_orderkey", 1)]
    keys = catalog.key_lists(
        catalog.constraint_rows(spark.createDataFrame(sorted({(*u[:4], "PRIMARY KEY") for u in usage}),
            "CONSTRAINT_NAME string, TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_TYPE string")),
        catalog.usage_rows(spark.createDataFrame(usage,
            "CONSTRAINT_NAME string, TABLE_CATALOG string, TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string, ORDINAL_POSITION int")),
    )
    sources = {"orders": lambda: renamed("src_orders"), "items": lambda: table(spark, sf_dir, "lineitem")}
    targets = {"orders": lambda: renamed("tgt_orders"), "items": lambda: planted(spark, sf_dir, "taxed_lineitem")}
    scope = spark.createDataFrame([("shop", "dbo", "orders"), ("shop", "dbo", "items")], "database string, schema string, table string")
    found = reconcile.tables_of(scope, lambda *name: sources[name[2]](), lambda *name: targets[name[2]](), keys)
    root = scratch_path(spark, "scope-keys")
    reconcile.run_scope(spark, found, root, "run-1")
    detail = reports.read_report(spark, root, "data_detail")
    return detail.select("table_name", "column_name", "row_key", "status", "source_value", "target_value")


def limited_extract(spark, sf_dir):
    """A limit cuts only where it is asked for, and any rows of the table will do."""
    orders = table(spark, sf_dir, "orders")
    keys = orders.select("o_orderkey")
    few = tables.extract(orders, columns=["o_orderkey"], where="o_orderkey % 2 = 0", limit=10)
    whole = tables.extract(orders, columns=["o_orderkey"], where="o_orderkey % 2 = 0")
    count = F.count("*").alias("rows")
    return (
        few.join(keys, "o_orderkey", "left_semi").agg(count).withColumn("part", F.lit("limited"))
        .unionByName(whole.agg(count).withColumn("part", F.lit("whole")))
    )


def case_tables(spark, sf_dir):
    """The cases of some tables of a file, and their verdicts."""
    root = scratch_path(spark, "case-tables")
    rows = spark.createDataFrame([(c.table, c.sql) for c in CASES], "table string, sql string").coalesce(1)
    rows.write.options(header="true", escape='"').csv(root)
    cases = testcases.read_cases(spark, root, ["customer", "documents"])
    report = testcases.run_test_cases(spark, cases, *_case_sides(spark, sf_dir))
    return report.select("source_table_name", "test_case", "status")


def failed_readback(spark, sf_dir):
    """Of tables to load, those that can be read back afterwards."""
    root = scratch_path(spark, "failed-readback")
    jobs = {
        "orders": (planted(spark, sf_dir, "raw_orders"), LOAD_TYPES),
        "nothing": (planted(spark, sf_dir, "raw_orders").filter("o_orderkey LIKE 'x%'"), LOAD_TYPES),
        "supplier": (table(spark, sf_dir, "supplier"), {"s_suppkey": "bigint"}),
    }
    found = []
    for name, (rows, types) in jobs.items():
        target = migrate.Target("shop", "dbo", name, os.path.join(root, name))
        status = migrate.migrate_table(spark, lambda rows=rows: rows, types, target, os.path.join(root, "reports"), "run-1")
        loaded = migrate.read_back(spark, target, status)
        if loaded is not None:
            found.append(loaded.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit(status).alias("status"), "rows"))
        else:
            found.append(spark.range(1).select(F.lit(name).alias("table_name"), F.lit(status).alias("status"), F.lit(None).cast("bigint").alias("rows")))
    return union_all(found)


def load_files(spark, sf_dir):
    """Delimited files loaded under audit: the counters, and the rejects in the report."""
    path = _foreign_files(spark, sf_dir)
    root = scratch_path(spark, "load-files")
    target = migrate.Target("shop", "dbo", "orders", os.path.join(root, "orders"))
    migrate.load_files(spark, path, FOREIGN_TYPES, target, root, "run-1", multi_line=True)
    rejects = reports.read_report(spark, root, "rejects").agg(F.count("*").alias("rejects"), F.sum("byte_offset").alias("offsets"))
    counts = reports.read_report(spark, root, "row_validation").select("status", "rows_parsed", "rows_loaded", "errors_seen")
    back = spark.read.parquet(target.path).agg(F.count("*").alias("rows"))
    return union_all(
        [
            frame.select(F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("string").alias("value")) for c in frame.columns])))
            for frame in (counts, rejects, back)
        ]
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        cell_diff, cell_diff_summary, cell_diff_types, cell_diff_repeated_keys, validate_detail, scope_report,
        declared_profile, fine_rejects, load_readback, load_audit, staged_rejects, test_case_rows, case_file, cell_diff_positional, diff_missing_extra,
        diff_ambiguous_keys, multiset_diff, normalize_rows, row_counts, reconcile_report, key_profile, key_columns,
        column_profile, analyze_tables, analyze_totals, map_types, fit_check, schema_mismatch, schema_verdict,
        extract_filtered, convert_rows, load_good, load_rejects, load_result, staged_load, xml_validity, xml_totals,
        keyword_scan, keyword_verdict, test_case_results, audit_latest, history_apply, escaped_load, escaped_rejects,
        load_xml, load_xml_rejects, xml_cell_diff, history_rebuild, object_keywords, object_verdict, key_ranges, catalog_scan,
        scope_keys_report, limited_extract, case_tables, failed_readback, load_files, file_counts,
        ordinals_with_ties,
    )
}
