import random

import pytest
from pyspark.sql import functions as F

from result_rows import rows
from shelfline import store as st
from shelfline.operators.upsert import KeyMissing, align_columns, newest_file_rows, upsert_by_key
from shelfline.store import Store

SALES = "tcin bigint, location_id bigint, sale_date date, units_sold bigint"
KEY = ("tcin", "location_id", "sale_date")


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), buckets=4)


def test_reload_changes_nothing(store, table):
    batch = table(SALES, (1, 100, "2026-04-21", 10), (1, 200, "2026-04-21", 20), (2, 100, "2026-04-21", 5))
    for _ in range(3):
        store.upsert("sales_daily", batch, KEY)
        assert store.read("sales_daily").count() == 3
    one = batch.filter("tcin = 1").withColumn("units_sold", F.lit(99).cast("long"))
    store.upsert("sales_daily", one, KEY)
    assert store.read("sales_daily").agg(F.sum("units_sold")).first()[0] == 203


def test_several_rows_per_key_stay(store, table):
    ddl = "tcin bigint, location_id bigint, week_end_date date, reporting_channel string, sales_dollars double"
    batch = table(ddl, (1, 1, "2026-04-25", "STORE", 50.0), (1, 1, "2026-04-25", "ONLINE", 50.0),
                  (2, 1, "2026-04-25", "STORE", 50.0), (2, 1, "2026-04-25", "STORE", 50.0))
    key = ("tcin", "location_id", "week_end_date")
    for _ in range(2):
        store.upsert("sales_weekly", batch, key)
    got = store.read("sales_weekly")
    assert got.count() == 4 and got.agg(F.sum("sales_dollars")).first()[0] == 200.0


def test_only_touched_days_are_rewritten(store, table):
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 1), (1, 1, "2026-04-22", 2)), KEY)
    before = store.read("sales_daily")
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-22", 9)), KEY)
    state = {r["part"]: r["version"] for r in store._current("sales_daily").collect()}
    assert state == {"2026-04-21": 1, "2026-04-22": 2}
    assert rows(store.read("sales_daily"), "units_sold") == [(1,), (9,)]
    # A reader that started earlier keeps its version.
    assert rows(before, "units_sold") == [(1,), (2,)]


def test_crashed_write_stays_invisible(store, table, monkeypatch):
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 1)), KEY)
    with monkeypatch.context() as m:
        m.setattr(Store, "append", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 5), (7, 1, "2026-04-23", 5)), KEY)
    assert rows(store.read("sales_daily"), "units_sold") == [(1,)]
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 6)), KEY)
    assert rows(store.read("sales_daily"), "units_sold") == [(6,)]


def test_null_keys_pile_up_unless_asked(store, table):
    batch = table(SALES, (None, 1, "2026-04-21", 1), (1, 1, None, 2))
    store.upsert("sales_daily", batch, KEY)
    store.upsert("sales_daily", batch, KEY)
    assert store.read("sales_daily").count() == 4
    store.upsert("sales_daily", batch, KEY, null_safe=True)
    assert store.read("sales_daily").count() == 2


def test_missing_key_columns(store, table):
    good = table(SALES, (1, 1, "2026-04-21", 1))
    store.upsert("sales_daily", good, KEY)
    with pytest.raises(KeyMissing):
        store.upsert("sales_daily", good.drop("sale_date"), KEY)
    assert store.read("sales_daily").count() == 1


def test_new_columns(store, table):
    first = table(SALES, (1, 1, "2026-04-21", 1), (2, 1, "2026-04-22", 1))
    store.upsert("sales_daily", first, KEY)
    wider = table(SALES + ", promo_flag string", (1, 1, "2026-04-21", 3, "Y"))
    store.upsert("sales_daily", wider, KEY, evolve=False)
    assert store.read("sales_daily").columns == first.columns
    store.upsert("sales_daily", wider, KEY)
    assert rows(store.read("sales_daily"), "tcin", "promo_flag") == [(1, "Y"), (2, None)]
    store.upsert("sales_daily", first, KEY)
    assert rows(store.read("sales_daily"), "promo_flag") == [(None,), (None,)]
    store.upsert("other", table("tcin bigint, purchase_order_active_f boolean",
                                (1, True), (2, None), (3, False)), ("tcin",))
    assert rows(store.read("other")) == [(1, True), (2, None), (3, False)]


def test_keys_without_dates_use_buckets(store, table):
    items = table("tcin bigint, mta_n string", *[(i, "a") for i in range(50)], *[(i, "b") for i in range(50)])
    store.upsert("item_attr", items, ("tcin",))
    assert {r["part"] for r in store._current("item_attr").collect()} <= {f"b{i:04d}" for i in range(4)}
    store.upsert("item_attr", table("tcin bigint, mta_n string", (7, "c")), ("tcin",))
    got = store.read("item_attr")
    assert got.count() == 99 and rows(got.filter("tcin = 7"), "mta_n") == [("c",)]
    store.clear("item_attr")
    assert store.read("item_attr").count() == 0
    store.upsert("item_attr", table("tcin bigint, mta_n string", (7, "d")), ("tcin",))
    assert rows(store.read("item_attr")) == [(7, "d")]


def test_upsert_twice_is_upsert_once(spark):
    rnd = random.Random(11)
    ddl = "k1 int, k2 string, v int"

    def some(n):
        # A third of the rows share one key.
        return spark.createDataFrame(
            [(0, "hot", rnd.randrange(9)) if i % 3 == 0 else
             (rnd.randrange(6), rnd.choice("abc"), rnd.randrange(9)) for i in range(n)], ddl)

    for _ in range(3):
        target, batch = some(60), some(25)
        once = upsert_by_key(target, batch, ["k1", "k2"])
        twice = upsert_by_key(once, batch, ["k1", "k2"])
        assert rows(once) == rows(twice)
        keys = {r[:2] for r in batch.collect()}
        expected = [tuple(r) for r in target.collect() if r[:2] not in keys]
        expected += [tuple(r) for r in batch.collect()]
        assert rows(once) == sorted(expected, key=repr)


def test_newest_file_wins_like_loading_in_order(spark):
    rnd = random.Random(5)
    files = [(f"f{i}", i % 4) for i in range(6)]
    data = [(rnd.choice([None, 1, 2, 3]), name, stamp, rnd.randrange(99))
            for name, stamp in files for _ in range(6)]
    df = spark.createDataFrame(data, "k int, file string, stamp int, v int")
    table: list = []
    for name, _ in sorted(files, key=lambda f: (f[1], f[0])):
        batch = [r for r in data if r[1] == name]
        keys = {r[0] for r in batch if r[0] is not None}
        table = [r for r in table if r[0] not in keys] + batch
    assert rows(newest_file_rows(df, ["k"], "file", ["stamp"])) == sorted(table, key=repr)


def test_align_columns(table):
    df = table("b string, a int, z int", ("x", 1, 9))
    wanted = st.fields("a bigint, b string, c date")
    got = align_columns(df, wanted)
    assert got.schema.simpleString() == "struct<a:bigint,b:string,c:date>"
    assert rows(got) == [(1, "x", None)]


def test_ledger_and_registry(spark, store):
    row = spark.createDataFrame(
        [("f1", "n", "sales_daily", "2026-01-01 00:00:00", "downloaded", "x" * 5000)],
        "file_id string, file_name string, dataset string, downloaded_at string, status string, "
        "error_message string").withColumn("downloaded_at", F.col("downloaded_at").cast("timestamp"))
    assert store.ledger().count() == 0
    store.add_ledger(row)
    later = row.withColumns({"downloaded_at": F.lit("2026-01-02").cast("timestamp"),
                             "status": F.lit("loaded")})
    store.add_ledger(later)
    got = store.ledger()
    assert len(got.columns) == 13 and got.count() == 1
    only = got.first()
    assert only["status"] == "loaded"
    assert len(only["error_message"]) == 5000

    seen = spark.sql("""SELECT * FROM VALUES
        ('d', map('a', 'BIGINT', 'b', 'TEXT'), array('a'), TIMESTAMP '2026-01-01'),
        ('d', map('a', 'DOUBLE', 'c', 'TEXT'), array('a', 'c'), TIMESTAMP '2026-01-03')
        AS t(dataset, columns, primary_key, seen_at)""")
    latest = st.newest_registry_rows(seen).first()
    assert latest["columns"] == {"a": "DOUBLE", "c": "TEXT"} and latest["primary_key"] == ["a", "c"]
    assert (latest["first_seen"].day, latest["last_seen"].day) == (1, 3)
    drift = st.schema_drift(spark.sql(
        "SELECT map('a','BIGINT','b','TEXT') AS prior, map('a','DOUBLE','c','TEXT') AS new")).first()
    assert (drift["added"], drift["removed"], drift["retyped"]) == (["c"], ["b"], ["a"])


def test_old_ledger_files_gain_columns(spark, tmp_path):
    old = spark.sql("SELECT 'f' AS file_id, 'n' AS file_name, 'd' AS dataset, 'loaded' AS status, "
                    "TIMESTAMP '2026-01-01' AS downloaded_at")
    old.write.parquet(str(tmp_path / "s/_file_ledger"))
    got = Store(spark, str(tmp_path / "s")).ledger()
    assert "parse_method" in got.columns and got.first()["parse_method"] is None


@pytest.mark.parametrize("grain, expected", [("day", [22, 23]), ("month", [21, 22, 23, 24])])
def test_parts_outside_a_range_are_not_read(spark, tmp_path, table, grain, expected):
    store = Store(spark, str(tmp_path / "s"), part_grain=grain)
    store.upsert("sales_daily", table(
        SALES, *[(1, 1, f"2026-04-{d}", d) for d in (21, 22, 23, 24)], (1, 1, "2026-06-01", 61),
        (1, 1, None, 0)), KEY)
    got = store.read("sales_daily", "2026-04-22", "2026-04-23")
    assert sorted(r["units_sold"] for r in got.collect()) == expected
    assert store.read("sales_daily", since="2026-05-02").count() == 1
    assert store.read("sales_daily").count() == 6


def test_a_renamed_date_keeps_rows(store, table):
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 1), (2, 1, "2026-04-21", 2)), KEY)
    other = table(SALES, (1, 1, "2026-04-21", 9)).withColumnRenamed("sale_date", "sales_date")
    store.upsert("sales_daily", other, ("tcin", "location_id", "sales_date"))
    assert rows(store.read("sales_daily"), "tcin", "units_sold") == [(1, 9), (2, 2)]
    with pytest.raises(ValueError):
        store.upsert("sales_daily", table("tcin bigint, n bigint", (1, 1)), ("tcin",))


def test_parts_stay_as_the_table_was_created(spark, store, table):
    keyed = table("a bigint, n bigint", *[(i, i) for i in range(40)])
    store.upsert("t", keyed, ("a",))
    Store(spark, store.root, part_grain="month", buckets=64).upsert("t", keyed, ("a",))
    assert store.read("t").count() == 40
    store.upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 1)), KEY)
    Store(spark, store.root, part_grain="month").upsert("sales_daily", table(SALES, (1, 1, "2026-04-21", 2)), KEY)
    assert rows(store.read("sales_daily"), "units_sold") == [(2,)]


def test_a_second_writer_is_noticed(spark, store, table, monkeypatch):
    batch = table(SALES, (1, 1, "2026-04-21", 1))
    store.upsert("sales_daily", batch, KEY)
    align, calls = st.upsert_by_key, []

    def meanwhile(*args, **how):
        if not calls:
            calls.append(1)
            Store(spark, store.root).upsert("sales_daily", batch.withColumn("units_sold", F.lit(5).cast("long")), KEY)
        return align(*args, **how)

    monkeypatch.setattr(st, "upsert_by_key", meanwhile)
    with pytest.raises(st.TableChanged):
        store.upsert("sales_daily", batch, KEY)
    assert rows(store.read("sales_daily"), "units_sold") == [(5,)]


def test_only_a_missing_folder_is_an_empty_table(spark, tmp_path):
    assert Store(spark, str(tmp_path / "none")).ledger().isEmpty()
    with pytest.raises(Exception):
        Store(spark, "nosuchscheme://x/y").ledger().count()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_leave_out_parts(spark, tmp_path, table):
    from shelfline.operators.inventory import inventory_snapshot, sell_through
    from shelfline.operators.sales import sales_summary, top_skus

    day = table("tcin bigint, location_id bigint, sales_date date, sale_quantity bigint",
                (1, 1, "2026-01-05", 5), (1, 1, "2026-02-05", 6), (2, 1, "2026-03-05", 7), (2, 1, None, 9))
    stock = day.withColumnsRenamed({"sales_date": "report_date_dim", "sale_quantity": "inventory_quantity"})
    for grain in ("day", "month"):
        store = Store(spark, str(tmp_path / grain), part_grain=grain)
        store.upsert("sales_daily", day, ["tcin", "location_id", "sales_date"])
        store.upsert("inventory_daily", stock, ["tcin", "location_id", "report_date_dim"])
        tables = store.tables()
        assert "_part" not in store.read("sales_daily").columns
        for got in (sell_through(tables, "2026-02-03", "2026-03-05"), sales_summary(tables, "week", "2026-02-03"),
                    top_skus(tables, "units", None, "2026-02-28"), inventory_snapshot(tables, "2026-02-10")):
            assert "PartitionFilters: [isnotnull(_part" in _plan(got)
        assert rows(sell_through(tables, "2026-02-03", "2026-03-05"), "tcin", "units_sold") == [(1, 6), (2, 7)]
        assert rows(inventory_snapshot(tables, "2026-02-10"), "tcin", "on_hand") == [(1, 6)]
        assert sales_summary(tables, "week", "2026-02-03").count() == 2


def test_profiles_open_no_data_file(spark, tmp_path, table):
    store = Store(spark, str(tmp_path / "s"))
    batch = table("tcin bigint, location_id bigint, sales_date date, note string",
                  (1, 1, "2026-01-05", "a"), (1, 2, "2026-01-07", None), (1, 3, None, "c"))
    store.upsert("sales_daily", batch, ["tcin", "location_id", "sales_date"])
    assert rows(store.ranges(), "dataset", "date_column", "row_count", "min_date", "max_date") == [
        ("sales_daily", "sales_date", 3, "2026-01-05", "2026-01-07")]
    assert rows(store.describe(), "column", "type", "row_count")[0] == ("location_id", "BIGINT", 3)
    for df in (store.ranges(), store.describe()):
        assert all("/_versions/" in f for f in df.inputFiles())
    store.clear("sales_daily")
    assert rows(store.ranges(), "row_count", "min_date") == [(0, None)]


def test_only_changed_parts_are_compared_again(spark, tmp_path, table):
    ddl, key = "tcin bigint, location_id bigint, sales_date date, a string, b string", ["tcin", "location_id", "sales_date"]
    store = Store(spark, str(tmp_path / "s"))
    # The third row differs only in where its NULL stands.
    store.upsert("sales_daily", table(
        ddl, (1, 1, "2026-01-05", "x", None), (1, 1, "2026-01-05", "x", None), (1, 1, "2026-01-05", None, "x"),
        (2, 1, "2026-01-06", "y", "z")), key)
    assert rows(store.duplicate_rows()) == [("sales_daily", 4, 1)]
    store.upsert("sales_daily", table(ddl, (2, 1, "2026-01-06", "y", "z"), (2, 1, "2026-01-06", "y", "z")), key)
    assert rows(store.duplicate_rows()) == [("sales_daily", 5, 2)]
    assert rows(store.duplicate_rows()) == [("sales_daily", 5, 2)]
    assert rows(store.meta("_row_checks").groupBy("part").count()) == [("2026-01-05", 1), ("2026-01-06", 2)]


def test_newest_ledger_row_stays_in_a_hash_aggregate(spark):
    from shelfline.store import newest_ledger_rows

    events = spark.sql("""SELECT * FROM VALUES
        ('a', 'old', TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-02'), ('a', 'new', TIMESTAMP '2026-01-02', NULL),
        ('b', 'first', TIMESTAMP '2026-01-01', NULL), ('b', 'then', TIMESTAMP '2026-01-01', TIMESTAMP '2026-01-01'),
        ('c', 'same', NULL, NULL), ('c', 'same', NULL, NULL), ('d', 'x', TIMESTAMP '1960-01-01', NULL), ('d', 'y', NULL, NULL)
        AS t(file_id, status, downloaded_at, loaded_at)""")
    got = newest_ledger_rows(events)
    assert rows(got, "file_id", "status") == [("a", "new"), ("b", "then"), ("c", "same"), ("d", "x")]
    assert "SortAggregate" not in _plan(got)


def test_a_batch_that_reads_otherwise_each_time(spark, tmp_path):
    """Its rows are those of one reading, so they fall into the parts that were found."""
    store = Store(spark, str(tmp_path / "store"), buckets=64)
    drawn = F.udf(lambda: random.getrandbits(40), "long").asNondeterministic()
    for n in (8, 8):
        store.upsert("item_attr", spark.range(n).select(drawn().alias("tcin"), F.lit("x").alias("mta_n")), ("tcin",))
    assert store.read("item_attr").count() == 16


def test_a_batch_of_numbered_files_is_not_shuffled(spark, table, tmp_path):
    given = table("k int, file int, v int", (1, 1, 10), (1, 2, 11), (1, 2, 12), (2, 1, 13), (3, 2, 14), (None, 1, 15), (None, 2, 16))
    given.write.parquet(str(tmp_path / "given"))
    found = newest_file_rows(spark.read.parquet(str(tmp_path / "given")), ["k"], "file", [])
    assert rows(found, "v") == [(11,), (12,), (13,), (14,), (15,), (16,)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortAggregate" not in plan
