import pytest
from pyspark.sql import functions as F

from result_rows import rows
from shelfline.catalog import UnknownDataset
from shelfline.plans.load import refresh_dataset, sync_folder
from shelfline.sources import zipped
from shelfline.sources.listing import classify, dry_run, list_source_files, pending_files
from shelfline.store import Store
from shelfline.streaming.ingest import stream_ingest

HEAD = "TCIN|LOCATION_ID|SALES_DATE|SALE_QUANTITY|SALE_AMOUNT\n"
DAILY = "BV_999000_DAILY_SALES_TCIN_LOC_{}_KW.zip"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def sales(*lines):
    return HEAD + "".join(f"{line}\n" for line in lines)


def test_full_load_then_nothing_new(spark, store, drop):
    drop.put(DAILY.format("04212026"), sales("1|10|2026-04-21|2|4.0", "1|11|2026-04-21|3|6.0",
                                             "2|10|2026-04-21|4|8.0"))
    drop.put("deep/BV_999000_WEEKLY_GM_TCIN_04252026_KW.zip", "TCIN|WEEK_END_DATE|GM\n1|2026-04-25|0.4\n",
             before=[("a.md5", "x")])
    drop.put("a/b/c/d/" + DAILY.format("04222026"), sales("9|9|2026-04-22|9|9"))
    drop.put_raw("notes.txt", b"hello")
    drop.put_raw("BV_1_DAILY_INV_TCIN_LOC_04212026_KW.zip", b"not a zip")
    listed = dry_run(classify(list_source_files(spark, drop.path, 3)).withColumn("file_id", F.col("path")),
                     ["sales_daily"])
    assert rows(listed, "status") == [("dry_run",), ("unknown_pattern",)]
    result = sync_folder(store, drop.path, max_depth=3)
    assert result.counts == {"files_found": 4, "files_new": 3, "files_loaded": 2, "files_failed": 1,
                             "files_skipped": 0, "files_unknown": 1}
    assert store.read("sales_daily").agg(F.sum("sale_quantity")).first()[0] == 9
    assert rows(store.read("gross_margin_item")) == [(1, "2026-04-25", 0.4)]
    ledger = {r["dataset"]: r for r in store.ledger().collect()}
    good, bad = ledger["sales_daily"], ledger["inventory_daily"]
    assert (good["status"], good["parse_method"], good["row_count"]) == ("loaded", "strict", 3)
    assert good["loaded_at"] is not None and str(good["file_date"]) == "2026-04-21"
    assert (bad["status"], bad["parse_method"], bad["loaded_at"]) == ("failed", "failed", None)
    assert bad["error_message"].startswith("parse: ")
    keys = {r["dataset"]: r["primary_key"] for r in store.registry().collect()}
    assert keys["sales_daily"] == ["tcin", "location_id", "sales_date"]

    again = sync_folder(store, drop.path, ["sales_daily"], max_depth=3)
    assert again.counts["files_loaded"] == 0 and again.counts["files_skipped"] == 1
    assert store.read("sales_daily").count() == 3
    assert store.meta("_sync_log").count() == 2
    with pytest.raises(UnknownDataset):
        sync_folder(store, drop.path, ["nope"])


def test_overlapping_files_of_one_run(store, drop):
    # Arrival decides by default: the file that came last wins, whatever its date.
    drop.put(DAILY.format("04232026"), sales("1|10|2026-04-21|1|1", "1|10|2026-04-21|2|1"), at=1000)
    drop.put(DAILY.format("04222026"), sales("1|10|2026-04-21|7|1", "2|10|2026-04-21|5|1"), at=2000)
    sync_folder(store, drop.path)
    assert rows(store.read("sales_daily"), "tcin", "sale_quantity") == [(1, 7), (2, 5)]


def test_overlapping_files_by_file_date(store, drop):
    drop.put(DAILY.format("04232026"), sales("1|10|2026-04-21|1|1", "1|10|2026-04-21|2|1"), at=1000)
    drop.put(DAILY.format("04222026"), sales("1|10|2026-04-21|7|1", "2|10|2026-04-21|5|1"), at=2000)
    sync_folder(store, drop.path, order_by="file_date")
    assert rows(store.read("sales_daily"), "tcin", "sale_quantity") == [(1, 1), (1, 2), (2, 5)]


@pytest.mark.parametrize("order_by, units", [("arrival", [1, 8, 9]), ("file_date", [2, 8, 9])])
def test_late_file(store, drop, order_by, units):
    drop.put(DAILY.format("04232026"), sales("1|10|2026-04-21|2|1", "2|10|2026-04-21|8|1"), at=1000)
    sync_folder(store, drop.path, order_by=order_by)
    drop.put(DAILY.format("04222026"), sales("1|10|2026-04-21|1|1", "3|10|2026-04-21|9|1"), at=2000)
    sync_folder(store, drop.path, order_by=order_by)
    got = store.read("sales_daily")
    assert sorted(r["sale_quantity"] for r in got.collect()) == units
    assert got.columns == ["tcin", "location_id", "sales_date", "sale_quantity", "sale_amount"]


def test_changed_file_loads_again_and_drift_is_reported(store, drop):
    drop.put(DAILY.format("04212026"), sales("1|10|2026-04-21|2|4.0"), at=1000)
    sync_folder(store, drop.path)
    drop.put(DAILY.format("04212026"),
             "TCIN|LOCATION_ID|SALES_DATE|SALE_QUANTITY|PROMO\n1|10|2026-04-21|5|yes\n", at=2000)
    result = sync_folder(store, drop.path)
    assert result.counts["files_loaded"] == 1
    assert result.drift == {"sales_daily": {"added": ["promo"], "removed": ["sale_amount"], "retyped": []}}
    assert rows(store.read("sales_daily"), "sale_quantity", "sale_amount", "promo") == [(5, None, "yes")]


def test_failed_load_keeps_table_and_registry(store, drop):
    drop.put(DAILY.format("04212026"), sales("1|10|2026-04-21|2|4.0"))
    sync_folder(store, drop.path)
    before = store.registry().collect()
    drop.put(DAILY.format("04222026"), "TCIN|WHEN|N\n1|x|2\n")
    drop.put("BV_1_DLY_PO_PLAN_TCIN_04222026_KW.zip", "TCIN|PLAN_DATE|PLANNED_UNITS\n1|2026-05-01|3\n")
    result = sync_folder(store, drop.path)
    assert (result.counts["files_failed"], result.counts["files_loaded"]) == (1, 1)
    failed = store.ledger().filter("status = 'failed'").first()
    assert failed["error_message"].startswith("load: KeyMissing") and failed["parse_method"] == "strict"
    assert store.read("sales_daily").count() == 1
    assert store.registry().filter("dataset = 'sales_daily'").collect() == before


def test_tolerant_files_keep_their_message(store, drop):
    drop.put_raw("README.md", b"x")
    drop.put(DAILY.format("04212026"), (sales("1|10|2026-04-21|2|4.0", "2|10")
                                        + "3|10|2026-04-21|2|4|x|y\n").encode() + b"4|10|2026-04-21|1|\xff\n")
    sync_folder(store, drop.path)
    got = store.ledger().first()
    assert (got["status"], got["parse_method"], got["row_count"]) == ("loaded", "permissive", 3)
    assert "1 rows left out" in got["error_message"] and "short rows" in got["error_message"]
    assert rows(store.read("sales_daily"), "tcin") == [(1,), (2,), (4,)]


def test_full_refresh(store, drop):
    drop.put(DAILY.format("04212026"), sales("1|10|2026-04-21|2|4.0"))
    sync_folder(store, drop.path)
    assert refresh_dataset(store, drop.path, "sales_daily").counts["files_loaded"] == 0
    # A row that no file holds any more goes away with a full refresh.
    stray = store.read("sales_daily").withColumn("tcin", F.lit(77).cast("long"))
    store.upsert("sales_daily", stray, ("tcin", "location_id", "sales_date"))
    assert store.read("sales_daily").count() == 2
    assert refresh_dataset(store, drop.path, "sales_daily", full=True).counts["files_loaded"] == 1
    assert rows(store.read("sales_daily"), "tcin") == [(1,)]
    with pytest.raises(UnknownDataset):
        refresh_dataset(store, drop.path, "nope")


def test_stream_equals_batch(spark, store, drop, tmp_path):
    drop.put(DAILY.format("04212026"), sales("1|10|2026-04-21|2|4.0"), at=1000)
    drop.put("sub/" + DAILY.format("04222026"), sales("1|10|2026-04-22|3|4.0"), at=1500)
    other = Store(spark, str(tmp_path / "streamed"), buckets=4)

    def run():
        query = stream_ingest(other, drop.path, str(tmp_path / "cp"))
        query.awaitTermination()

    run()
    sync_folder(store, drop.path)
    assert rows(other.read("sales_daily")) == rows(store.read("sales_daily"))
    drop.put(DAILY.format("04232026"), sales("1|10|2026-04-21|9|1.0"), at=3000)
    run()
    sync_folder(store, drop.path)
    assert rows(other.read("sales_daily")) == rows(store.read("sales_daily"))
    assert rows(other.ledger(), "file_name", "status") == rows(store.ledger(), "file_name", "status")
    run()
    assert other.meta("_sync_log").count() == 2


def test_pending_files(spark):
    found = spark.createDataFrame(
        [("a", "d", "1"), ("b", "d", "2"), ("c", "d", None), ("e", "d", ""), ("f", None, "1"), ("g", "d", "1")],
        "file_id string, dataset string, fingerprint string")
    ledger = spark.createDataFrame(
        [("a", "loaded", "1"), ("b", "loaded", "old"), ("c", "loaded", "1"), ("e", "loaded", None),
         ("g", "failed", "1")], "file_id string, status string, fingerprint string")
    assert rows(pending_files(found, ledger), "file_id") == [("b",), ("g",)]


def test_all_members_depths_and_odd_headers(spark, store, drop):
    head = "TCIN|LOCATION_ID|SALES_DATE|SALE_QUANTITY|FILE_ID|FILE_DATE|MODIFIED_AT\n"
    drop.put("a/b/c/d/e/" + DAILY.format("04212026"), head + "2|10|2026-04-21|3|f|x|m\n",
             before=[("first.txt", head + "1|10|2026-04-21|2|f|x|m\n"), ("sum.md5", "0")])
    drop.put(DAILY.format("04222026"), head + "3|10|2026-04-22|4|f|x|m\n")
    result = sync_folder(store, drop.path)
    assert (result.counts["files_loaded"], result.counts["files_failed"]) == (2, 0)
    got = store.read("sales_daily")
    assert rows(got, "tcin", "file_id") == [(1, "f"), (2, "f"), (3, "f")]
    assert rows(store.ledger(), "row_count") == [(1,), (2,)]


def test_fractions_widen_a_column_or_are_reported(spark, store, drop):
    head = "TCIN|LOCATION_ID|SALES_DATE|REVENUE|SALE_QTY\n"
    drop.put(DAILY.format("04212026"), head + "1|10|2026-04-21|5|1\n")
    sync_folder(store, drop.path)
    drop.put(DAILY.format("04222026"), head + "1|10|2026-04-22|10.75|2.0\n2|10|2026-04-22|1.5|2.5\n")
    sync_folder(store, drop.path)
    assert rows(store.read("sales_daily"), "revenue", "sale_qty") == [(1.5, None), (10.75, 2), (5.0, 1)]
    assert rows(store.ledger(), "parse_method") == [("ignore_errors",), ("strict",)]


def test_stream_sees_rewritten_and_old_files(store, drop, tmp_path):
    import os
    import time

    from shelfline.streaming.ingest import stream_ingest

    day = DAILY.format("04212026")
    drop.put(day, sales("1|10|2026-04-21|2|4.0"))

    def run():
        stream_ingest(store, drop.path, str(tmp_path / "stream")).awaitTermination()

    run()
    path = drop.put(day, sales("1|10|2026-04-21|7|4.0", "5|10|2026-04-21|1|1.0"))
    os.utime(path, (time.time() + 60, time.time() + 60))
    drop.put(DAILY.format("03222026"), sales("9|10|2026-03-22|1|1.0"), at=time.time() - 30 * 86400)
    run()
    assert rows(store.read("sales_daily"), "tcin") == [(1,), (5,), (9,)]


def _zipped(*members):
    import io
    import warnings
    import zipfile

    out = io.BytesIO()
    with warnings.catch_warnings(), zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        warnings.simplefilter("ignore")  # equal names are legal in an archive
        for name, text in members:
            archive.writestr(name, text)
    return out.getvalue()


@pytest.mark.parametrize("schemes", [zipped.SEEKABLE, ("elsewhere",)])
def test_members_are_read_one_by_one(spark, store, drop, monkeypatch, schemes):
    # A limit that every member exceeds: each is still read, as a stream; whole archives give the same.
    monkeypatch.setattr(zipped, "TASK_BYTES", 10)
    monkeypatch.setattr(zipped, "SEEKABLE", schemes)
    day = [f"{i}|10|2026-04-21|1|{i * 7919 % 1013}" for i in range(5000)]
    whole = [("same.txt", sales(*day[:2000])), ("same.txt", sales(*day[2000:4000])),
             ("other.txt", sales(*day[4000:])), ("blank.txt", " \n\n"), ("x.sha256", "0")]
    drop.put_raw(DAILY.format("04212026"), _zipped(*whole))
    broken = bytearray(_zipped(*[(n, t.replace("2026-04-21", "2026-04-22")) for n, t in whole]))
    place = broken.index(b"other.txt") + 400
    broken[place:place + 8] = bytes(b ^ 0xFF for b in broken[place:place + 8])
    drop.put_raw(DAILY.format("04222026"), bytes(broken))
    drop.put_raw(DAILY.format("04232026"), _zipped(("blank.txt", "\n")))
    result = sync_folder(store, drop.path)
    assert (result.counts["files_loaded"], result.counts["files_failed"]) == (1, 2)
    got = store.read("sales_daily")
    assert rows(got.agg(F.count("*"), F.count_distinct("tcin"), F.max("sales_date"))) == [(5000, 5000, "2026-04-21")]
    assert rows(store.ledger(), "status", "row_count") == [("failed", None), ("failed", None), ("loaded", 5000)]


def test_members_with_different_keys_are_one_file(spark, store, drop):
    other = "TCIN|STORE_ID|SALES_DATE|SALE_QUANTITY\n7|3|2026-04-21|1\n8|3|2026-04-21|x|y\n"
    drop.put_raw(DAILY.format("04212026"), _zipped(
        ("a.txt", sales("1|10|2026-04-21|2|4.0", "2|10")), ("b.txt", other)))
    sync_folder(store, drop.path)
    assert store.ledger().count() == 1
    report = store.meta("_parse_reports").first()
    assert (report["data_lines"], report["short_rows"], report["long_rows"]) == (4, 1, 1)
    found = store.meta("_rejects").select("member", "line_no", "reasons", "line", "dropped")
    assert rows(found.where("member = 'a.txt'")) == [("a.txt", 2, "too few fields", "2|10", False)]


def test_archives_are_written_as_named(spark, tmp_path):
    folder = str(tmp_path / "drop")
    lines = spark.createDataFrame(
        [("a.zip", "m", 1, "one"), ("a.zip", "m", 0, "head"), ("a.zip", "n", 0, "é"), ("b.zip", "m", 0, "x")],
        "file string, member string, line_no long, line string")
    assert rows(zipped.write_archives(lines, folder)) == [("a.zip",), ("b.zip",)]
    import zipfile

    with zipfile.ZipFile(f"{folder}/a.zip") as archive:
        assert {n: archive.read(n).decode() for n in archive.namelist()} == {"m": "head\r\none\r\n", "n": "é\r\n"}
    zipped.write_archives(lines.where("file = 'b.zip'").withColumn("line", F.lit("new")), folder)
    with zipfile.ZipFile(f"{folder}/b.zip") as archive:
        assert archive.read("m") == b"new\r\n"


def test_each_of_a_few_members_has_a_task(spark, drop):
    for n in range(12):
        drop.put(f"f{n:02d}.zip", "A|B\n1|2\n")
    listed = list_source_files(spark, drop.path).select(F.col("path").alias("file_id"))
    archives = zipped.open_archives(listed)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        lines = archives.lines(archives.members)
        assert lines.select(F.spark_partition_id().alias("task"), "line").distinct().count() == 12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_lines_are_packed_in_runs():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({
        "file": ["x", "a", "a", "a", "b"], "member": ["m", "m", "m", "n", "n"], "line": [b"0", b"1", b"", b"22", b"3"]})
    want = [("a", "m", b"1\r\n\r\n"), ("a", "n", b"22\r\n"), ("b", "n", b"3\r\n")]
    assert [(f, m, bytes(t)) for f, m, t in zipped._runs(batch.slice(1))] == want
    with pytest.raises(ValueError):
        list(zipped._runs(pa.RecordBatch.from_pydict({"file": ["a"], "member": ["m"], "line": pa.array([None], pa.binary())})))


def test_deliveries_make_their_lines_once(spark):
    from shelfline.plans.load_queries import _with_heads

    lines = spark.range(4).select(
        F.lit("a.zip").alias("file"), F.format_string("m%d", F.col("id") % 2).alias("member"), F.col("id").cast("string").alias("line"))
    headed = _with_heads(lines, "H").withColumn("line", F.decode("line", "utf-8"))
    assert sorted(map(tuple, headed.collect())) == [
        ("a.zip", "checksum.md5", 0, "0"), ("a.zip", "m0", 0, "\ufeffH"), ("a.zip", "m0", 1, "0"), ("a.zip", "m0", 2, "2"),
        ("a.zip", "m1", 0, "\ufeffH"), ("a.zip", "m1", 1, "1"), ("a.zip", "m1", 2, "3")]
    assert headed._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
