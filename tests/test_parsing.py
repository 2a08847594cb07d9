import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from result_rows import rows
from shelfline.sources import delimited, zipped


@pytest.fixture
def parse(spark, tmp_path):
    """Read one archive; returns (typed rows, report row)."""

    number = itertools.count()

    def read(text, before=(), inner="data.txt", table=None):
        import zipfile

        path = tmp_path / f"{next(number)}.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for other, content in before:
                archive.writestr(other, content)
            archive.writestr(inner, text)
        files = zipped.read_files(spark, [str(path)])
        lines = zipped.read_zip_lines(files).cache()
        layouts = [x for (x,) in delimited.collect_layouts(zipped.members_of(lines))]
        cells = delimited.text_cells(lines, layouts, ["file_id"])
        types = delimited.choose_types(cells, delimited.column_order(layouts), table)
        typed = delimited.cast_cells(cells, types, ["file_id"])
        report = delimited.parse_report(typed).first()
        return typed.drop("file_id", "_bad", "_lost", "_short", "_long", "_garbled", "_odd"), report

    return read


def kinds(df):
    return delimited.derive_schema(df.schema)


def test_pipe_file_with_sentinel(parse):
    df, report = parse("TCIN|LOCATION ID|SALE DATE|UNITS SOLD|SALES DOLLARS\n"
                       "12345|2750|2026-04-21|10|99.50\n12345|-1|2026-04-21|3|-1\n")
    assert kinds(df) == {"tcin": "BIGINT", "location_id": "BIGINT", "sale_date": "DATE",
                         "units_sold": "BIGINT", "sales_dollars": "DOUBLE"}
    assert df.collect()[1][:] == (12345, -1, dt.date(2026, 4, 21), 3, -1.0)
    assert (report["method"], report["row_count"], report["skipped_rows"]) == ("strict", 2, 0)


@pytest.mark.parametrize("text, expected", [
    ("TCIN\tLOCATION ID\tSNAPSHOT DATE\tON_HAND_UNITS\n1\t2\t2026-04-21\t5\n2\t2\t2026-04-21\t6\n",
     ["BIGINT", "BIGINT", "DATE", "BIGINT"]),
    ("TCIN|LOCATION_ID|ORDER_DATE|OPEN_UNITS|PLANNED_QTY|ORDER_STATUS\n"
     "1|2|2026-04-21|5|10|OPEN\n1|2|2026-04-21|0|10|FULFILLED\n",
     ["BIGINT", "BIGINT", "DATE", "BIGINT", "BIGINT", "TEXT"]),
    ("TCIN|LOCATION_ID|WEEK_END_DATE|FORECAST_UNITS\n1|2|2026-04-25|7\n",
     ["BIGINT", "BIGINT", "DATE", "BIGINT"]),
    ("TCIN|PERIOD_START_DATE|PERIOD_END_DATE|PLANNED_UNITS\n1|2026-04-20|2026-05-03|7\n",
     ["BIGINT", "DATE", "DATE", "BIGINT"]),
    ("TCIN|FISCAL_WEEK_BEGIN_D|DPCI|RATIO\n1|2026-04-20|030-01-0001|1e-3\n",
     ["BIGINT", "TEXT", "TEXT", "DOUBLE"]),
    ("TCIN,A,B\n1,2,x\n", ["BIGINT", "BIGINT", "TEXT"]),
])
def test_types_by_dataset(parse, text, expected):
    df, report = parse(text)
    assert list(kinds(df).values()) == expected
    assert report["method"] == "strict"


def test_header_blanks_and_mark(parse):
    df, _ = parse("﻿TCIN | Sale Date | Units Sold|--|A#B\n1|2026-04-21|4|x|y\n")
    assert df.columns == ["tcin", "sale_date", "units_sold", "col", "a_b"]
    df, _ = parse("﻿TCIN|UNITS\n1|2\n3|4\n")
    assert rows(df) == [(1, 2), (3, 4)]


def test_repeated_headers_are_told_apart(parse):
    df, _ = parse("TCIN|Note|NOTE \n1|a|b\n")
    assert df.first()[:] == (1, "a", "b") and df.columns == ["tcin", "note", "note_2"]


def test_line_ends(parse):
    df, report = parse(b"TCIN|UNITS\r\n1|2\n3|4\r\n\r\n5|6")
    assert rows(df) == [(1, 2), (3, 4), (5, 6)] and report["method"] == "strict"


def test_ragged_lines(parse):
    df, report = parse("TCIN|UNITS\n1|10\n2|extra|junk|here\n3|30\n")
    assert rows(df, "tcin") == [(1,), (2,), (3,)]
    assert (report["method"], report["long_rows"]) == ("strict", 1)
    df, report = parse("TCIN|UNITS\n1|10\n2\n")
    assert rows(df) == [(1, 10), (2, None)]
    assert (report["method"], report["short_rows"]) == ("ignore_errors", 1)


def test_quotes_are_text(parse):
    df, report = parse('TCIN|UNITS|NOTE\n1|10|ok\n2|20|she said "hi\n')
    assert df.collect()[1]["note"] == 'she said "hi' and report["method"] == "strict"
    df, report = parse('TCIN\tNAME\n1\tBone, 6" Height\n2\tB\n3\tC, 6" x 4"\n')
    assert report["method"] == "strict"
    assert rows(df, "name") == [("B",), ('Bone, 6" Height',), ('C, 6" x 4"',)]


def test_null_marks(parse):
    df, _ = parse('TCIN|PURCHASE_ORDER_ACTIVE_F\n1|true\n2|""\n3|false\n')
    assert kinds(df)["purchase_order_active_f"] == "BOOLEAN"
    assert [r[1] for r in df.collect()] == [True, None, False]
    df, _ = parse('TCIN|PARENT_TCIN|X\n1|12345|NULL\n2|""|null\n3|67890|\n')
    assert kinds(df) == {"tcin": "BIGINT", "parent_tcin": "BIGINT", "x": "TEXT"}
    assert [r[1] for r in df.collect()] == [12345, None, 67890]
    assert [r[2] for r in df.collect()] == [None] * 3


def test_hundred_rows_with_inch_marks(parse):
    text = "LOCATION_ID|NAME\n" + "".join(f'{i}|Store {i} 6" wide\n' for i in range(100))
    df, report = parse(text)
    assert (df.count(), report["method"], report["skipped_rows"]) == (100, "strict", 0)


def test_binary_noise_is_never_strict(parse):
    _, report = parse(bytes(range(256)) * 4)
    assert report is None or report["method"] == "permissive"


def test_undecodable_long_rows_are_counted_as_skipped(parse):
    _, report = parse(b"TCIN|NAME\n1|ok\n2|caf\xe9\n3|a|b|c\n")
    assert (report["method"], report["skipped_rows"], report["row_count"]) == ("permissive", 1, 2)
    assert "undecodable" in report["primary_error"]


def test_values_that_do_not_fit_the_table(parse):
    table = T.StructType([T.StructField("tcin", T.LongType()), T.StructField("flag", T.BooleanType())])
    df, report = parse("TCIN|FLAG|SIZE\n1|true|5\n2|maybe|6\n", table=table)
    assert rows(df) == [(1, True, 5), (2, None, 6)]
    assert (report["method"], report["bad_cells"]) == ("ignore_errors", 1)


def test_hinted_casts(parse):
    df, report = parse("TCIN|OPEN_QTY|UNIT_COST|ORDER_DATE\n1|10.0|5|04/21/2026\n"
                       "x|7|abc|2026-4-1\n")
    assert df.collect()[0][:] == (1, 10, 5.0, None)
    assert df.collect()[1][:] == (None, 7, None, dt.date(2026, 4, 1))
    assert report["method"] == "strict"


def test_late_text_makes_the_column_text(parse):
    # Whatever row it stands in, one word makes a column of numbers text.
    text = "TCIN|CODE\n" + "".join(f"{i}|{i}\n" for i in range(12_000)) + "1|12D\n"
    df, report = parse(text)
    assert kinds(df)["code"] == "TEXT" and report["method"] == "strict"


def test_sidecars_are_passed_over(parse):
    df, _ = parse("TCIN|UNITS\n1|2\n", before=[("checksum.md5", "abc"), ("x.SIG", "abc")])
    assert rows(df) == [(1, 2)]


def test_unreadable_archives(spark, tmp_path):
    import io
    import zipfile

    empty = io.BytesIO()
    zipfile.ZipFile(empty, "w").close()
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.txt", "".join(f"{i}|{i * 7919 % 1013}\n" for i in range(300_000)))
    broken = bytearray(whole.getvalue())
    broken[len(broken) // 2] ^= 0xFF
    files = spark.createDataFrame(
        [("empty", empty.getvalue()), ("text", b"not a zip"), ("broken", bytes(broken))],
        "file_id string, content binary")
    errors = zipped.read_zip_lines(files).filter("error IS NOT NULL")
    assert rows(errors, "file_id", "line_no") == [("broken", -1), ("empty", -1), ("text", -1)]


def test_lines_survive_piecewise_reading(spark):
    import io
    import zipfile

    lines = [f"{i}|{'é' * (i % 50)}" for i in range(300_000)]
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("a.txt", "\r\n".join(lines))
    files = spark.createDataFrame([("f", whole.getvalue())], "file_id string, content binary")
    got = zipped.read_zip_lines(files).orderBy("line_no").toPandas()
    assert got["line"].tolist() == lines and got["line_no"].tolist() == list(range(300_000))
    assert got["layout"].nunique() == 1


def test_delimiter_choice(spark):
    heads = ["a\tb|c", "a|b,c", "a,b,c|d", "abc", "a\tb\tc|d|e|f"]
    df = spark.createDataFrame([(h,) for h in heads], "h string")
    got = [r[0] for r in df.select(delimited.sniff_delimiter(F.col("h"))).collect()]
    assert got == ["\t", "|", ",", "|", "|"]


def test_files_with_different_headers_in_one_pass(spark):
    a = delimited.Layout(1, "|", ("tcin", "units"))
    b = delimited.Layout(2, ",", ("units", "note", "tcin"))
    lines = spark.createDataFrame(
        [("x", 1, 1, "7|8"), ("y", 2, 1, "5,hi,6")],
        "file_id string, layout long, line_no long, line string")
    cells = delimited.text_cells(lines, [a, b], ["file_id"])
    assert rows(cells, "file_id", "tcin", "units", "note") == [
        ("x", "7", "8", None), ("y", "6", "5", "hi")]
