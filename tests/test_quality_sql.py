import csv
import glob

import pytest
from pyspark.errors import AnalysisException

from result_rows import rows
from shelfline import store as st
from shelfline.operators import profile, quality
from shelfline.operators.bounded_sql import SqlBlocked, check_file_name, export_csv, run_sql, run_sql_marked
from shelfline.operators.paging import page

LEDGER = "file_id string, file_name string, dataset string, bytes bigint, downloaded_at timestamp, loaded_at timestamp, row_count bigint, status string"


def ledger(spark, *data):
    from datetime import datetime

    day = datetime(2026, 5, 1)
    return spark.createDataFrame(
        [(i, n, d, b, day if dl else None, day if ld else None, rc, s)
         for i, n, d, b, dl, ld, rc, s in data], LEDGER)


@pytest.fixture
def tables(table):
    return {
        "sales_daily": table("tcin bigint, sales_date date", (1, "2026-04-01"), (2, "2026-05-01")),
        "forecast_weekly": table("tcin bigint, fiscal_week_begin_d string", (1, "2026-04-13"), (2, "5/04/2026")),
        "item_attr": table("tcin bigint, mta_n string", (1, "a")),
        "location_attr": table("location_id bigint, last_remodel_date date", (1, "2000-04-13")),
        "not_a_dataset": table("x int", (1,)),
    }


def test_profile(spark, tables):
    files = ledger(spark, ("1", "a", "sales_daily", 10, True, True, 2, "loaded"),
                   ("2", "b", "sales_daily", 20, True, False, None, "failed"))
    got = {r["dataset"]: r for r in profile.dataset_profile(tables, files).collect()}
    assert set(got) == set(tables) - {"not_a_dataset"}
    assert [str(got["forecast_weekly"][c]) for c in ("min_date", "max_date")] == ["2026-04-13", "2026-05-04"]
    assert got["item_attr"]["date_column"] is None and got["item_attr"]["min_date"] is None
    assert (got["sales_daily"]["file_count"], got["item_attr"]["file_count"]) == (1, 0)
    assert [str(v) for v in profile.business_range(profile.dataset_ranges(tables)).first()] == [
        "2026-04-01", "2026-05-04", "2000-04-13", "2026-05-04", "4"]
    assert profile.ledger_stats(files).first()[:] == (2, 30, 1)
    assert profile.ledger_stats(files.limit(0)).first()[:] == (0, 0, 0)
    described = rows(profile.describe(spark, tables), "table", "column", "type", "row_count")
    assert ("sales_daily", "sales_date", "DATE", 2) in described


def test_ledger_rules(spark):
    bad = ledger(spark, ("1", "a", "d", 1, True, True, None, "loaded"), ("2", "b", "d", 1, False, False, None, "failed"),
                 ("3", "c", "d", 1, False, False, None, "queued"), ("4", "d", "d", 1, True, True, 1, "failed"))
    assert quality.ledger_violations(bad).first()[:] == (1, 1, 1)
    name, status, detail = quality.ledger_consistent(bad).first()
    assert status == "warn" and "1 rows loaded_without_row_count" in detail
    assert quality.ledger_consistent(bad.limit(0)).first()["status"] == "pass"


def test_orphans(spark):
    files = spark.createDataFrame([(f"n{i}.zip",) for i in range(6)], "file_name string")
    known = ledger(spark, ("1", "n0.zip", "d", 1, True, True, 1, "loaded"))
    got = quality.no_orphan_files(files, known).first()
    assert got["status"] == "warn"
    assert got["detail"] == "5 files not in the ledger: n1.zip, n2.zip, n3.zip, and 2 others"
    assert quality.no_orphan_files(files.limit(0), known).first()["status"] == "pass"


def test_duplicates(table, tables):
    twice = table("tcin bigint, d date, note string", (1, "2026-04-01", None), (1, "2026-04-01", None),
                  (2, "2026-04-01", "x"), (None, "2026-04-01", "x"))
    got = quality.no_duplicate_rows(quality.duplicate_rows({"sales_daily": twice.filter("tcin IS NOT NULL")})).first()
    assert (got["status"], got["detail"]) == ("warn", "identical rows: sales_daily: 1 of 3")
    assert quality.no_duplicate_rows(quality.duplicate_rows(tables)).first()["status"] == "pass"
    assert quality.key_duplicates(twice, ["tcin", "d"]).first()[:] == (1, 1, 1)


def test_empty_datasets(tables):
    tables = {**tables, "item_attr": tables["item_attr"].limit(0)}
    got = quality.datasets_have_data(profile.dataset_ranges(tables)).first()
    assert (got["status"], got["detail"]) == ("warn", "3/4 datasets populated; empty: item_attr")


def test_severity(spark):
    def overall(*states):
        checks = spark.createDataFrame([(s,) for s in states], "status string")
        return quality.overall_status(checks).first()[:]

    assert overall("pass", "pass") == ("pass", 2, 0, 0)
    assert overall("pass", "warn") == ("warn", 1, 1, 0)
    assert overall("warn", "fail", "pass") == ("fail", 1, 1, 1)
    assert overall() == ("pass", 0, 0, 0)


def test_bookkeeping_schema(spark):
    required = {n: st.fields(d) for n, d in st.META.items()}
    assert quality.schema_current(spark, required, required).first()["status"] == "pass"
    old = {**required, "_file_ledger": st.fields("file_id string")}
    old.pop("_sync_log")
    got = quality.schema_current(spark, old, required).first()
    assert got["status"] == "fail" and "_sync_log is missing" in got["detail"]


@pytest.mark.parametrize("sql", [
    "INSERT INTO t VALUES (1)", "UPDATE t SET a = 0", "DELETE FROM t", "CREATE TABLE x AS SELECT 1",
    "DROP TABLE t", "ALTER TABLE t ADD COLUMN x INT", "TRUNCATE TABLE t", "SELECT 1; DELETE FROM t",
    "/* sneaky */ DROP TABLE t", "/* multi\nline */ INSERT INTO t VALUES (1)", "-- comment\nDROP TABLE t",
    "SELECT 1 -- ; DROP TABLE x\n; DELETE FROM t", "SET a = 1", "ADD JAR x", "", " ; ",
    "SELECT reflect('java.lang.System', 'exit', 1)", "SELECT try_reflect ('a', 'b')",
    "SELECT 1) q; DROP TABLE t --", "CACHE TABLE t",
])
def test_writes_are_blocked(spark, table, sql):
    table("a bigint", (1,)).createOrReplaceTempView("t")
    with pytest.raises(SqlBlocked):
        run_sql(spark, sql)


@pytest.mark.parametrize("sql", [
    "SELECT 1", "SELECT * FROM t WHERE a = 1", "WITH x AS (SELECT 1 AS a) SELECT a FROM x",
    "SELECT '/* not a comment */' AS s", "SELECT 'has ; in string' AS s", "SELECT 1 AS a; ",
    "SELECT 1 AS a -- trailing", "SELECT a FROM t ORDER BY a DESC LIMIT 5",
])
def test_reads_run(spark, table, sql):
    table("a bigint", (1,)).createOrReplaceTempView("t")
    assert run_sql(spark, sql).count() == 1


def test_bounds(spark, table):
    table("tcin bigint, units bigint", (1, 10), (2, 20), (3, 30)).createOrReplaceTempView("t")
    assert run_sql(spark, "SELECT SUM(units) AS total FROM t").first()[0] == 60
    assert run_sql(spark, "SELECT * FROM t", 2).count() == 2
    with pytest.raises(AnalysisException):
        run_sql(spark, "SELECT nope FROM t")
    for limit in (0, 10_001):
        with pytest.raises(ValueError):
            run_sql(spark, "SELECT 1", limit)


def test_export(spark, table, tmp_path):
    table("tcin bigint, name string", (100, 'a "6"" b'), (200, "x,y"), (300, None)).createOrReplaceTempView("t")
    out = export_csv(spark, "SELECT * FROM t ORDER BY tcin", str(tmp_path), "a.csv")
    assert (out.rows_written, out.columns) == (3, ["tcin", "name"]) and out.bytes_written > 0
    lines = [r for f in glob.glob(f"{out.path}/*.csv") for r in csv.reader(open(f))]
    assert lines == [["tcin", "name"], ["100", 'a "6"" b'], ["200", "x,y"], ["300", ""]]
    bare = export_csv(spark, "SELECT * FROM t", str(tmp_path), "b.csv", header=False, max_rows=2)
    assert bare.rows_written == 2
    assert sum(len(open(f).readlines()) for f in glob.glob(f"{bare.path}/*.csv")) == 2
    with pytest.raises(SqlBlocked):
        export_csv(spark, "DROP TABLE t", str(tmp_path), "c.csv")


@pytest.mark.parametrize("name", ["a/b.csv", "a\\b.csv", ".a.csv", "a.txt", "a\n.csv"])
def test_export_names(name):
    with pytest.raises(ValueError):
        check_file_name(name)


def test_pages(table):
    df = table("a bigint", *[(i,) for i in range(25)])
    first = page(df, ["a"], 0, 10)
    assert rows(first.rows) == [(i,) for i in range(10)]
    assert (first.total, first.has_more, first.next_offset) == (25, True, 10)
    last = page(df, ["a"], 20, 10)
    assert [r[0] for r in last.rows.collect()] == list(range(20, 25))
    assert (last.has_more, last.next_offset) == (False, None)
    beyond = page(df, ["a"], 30, 10)
    assert beyond.rows.count() == 0 and not beyond.has_more
    with pytest.raises(ValueError):
        page(df, ["a"], -1)


def test_cut_results_are_marked(spark, tmp_path):
    spark.range(30).selectExpr("id AS n", "29 - id AS back").createOrReplaceTempView("thirty")
    sql = "SELECT * FROM thirty ORDER BY back"
    cut, whole = run_sql_marked(spark, sql, 7), run_sql_marked(spark, sql, 30)
    assert rows(cut) == [(n, 29 - n, True) for n in range(23, 30)]
    assert whole.count() == 30 and not whole.first()["truncated"]
    assert run_sql(spark, sql, None).count() == 30
    assert run_sql_marked(spark, "SELECT * FROM thirty WHERE n < 0", 5).isEmpty()
    for limit, written, truncated in ((7, 7, True), (30, 30, False), (None, 30, False)):
        out = export_csv(spark, sql, str(tmp_path), "t.csv", max_rows=limit)
        assert (out.rows_written, out.truncated) == (written, truncated)


def test_unread_dates(table):
    tables = {
        "sales_daily": table("tcin bigint, sales_date string", (1, "2026-04-01"), (2, "04/31/2026"), (3, "soon"), (4, None)),
        "forecast_weekly": table("tcin bigint, fiscal_week_begin_d string, last_update_d date", (1, "x", "2026-05-01")),
        "item_attr": table("tcin bigint, note string", (1, "a"))}
    assert rows(profile.unread_dates(tables)) == [
        ("forecast_weekly", "date", "fiscal_week_begin_d", 1, 1), ("forecast_weekly", "snapshot_date", "last_update_d", 1, 0),
        ("sales_daily", "date", "sales_date", 3, 2)]
    with pytest.raises(LookupError):
        profile.unread_dates({"item_attr": tables["item_attr"]})
