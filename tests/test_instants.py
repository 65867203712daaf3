from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from seismark.operators.instants import normalise_instants

SCHEMA = "row_id bigint, src string, txt string, zone string, first boolean, seen timestamp, notation string, epoch_s string"


def run(spark, rows):
    df = spark.createDataFrame([(i, *r, None, None, None)[:8] if len(r) == 5 else (i, *r) for i, r in enumerate(rows)], SCHEMA)
    out = normalise_instants(df, "txt", "src", seen_at="seen", zone="zone", day_first="first")
    return {r["row_id"]: r for r in out.collect()}, out


def local(zone, *parts):
    return int(datetime(*parts, tzinfo=ZoneInfo(zone)).timestamp())


def test_notations_and_zones(spark):
    ny, utc = "America/New_York", None
    cases = [
        ("2019-01-06 03:08:26", ny, local(ny, 2019, 1, 6, 3, 8, 26)),
        ("2019-01-10T20:51", utc, int(datetime(2019, 1, 10, 20, 51, tzinfo=timezone.utc).timestamp())),
        ("1546550679233", ny, 1546550679),
        ("1548007054", ny, 1548007054),
        ("Fri, 01 Feb 2019 16:46:39 GMT", ny, int(datetime(2019, 2, 1, 16, 46, 39, tzinfo=timezone.utc).timestamp())),
        ("Fri, 10 Jan 2025 01:24:34 -0800", ny, int(datetime(2025, 1, 10, 9, 24, 34, tzinfo=timezone.utc).timestamp())),
        ("20190103224029", ny, local(ny, 2019, 1, 3, 22, 40, 29)),
        ("20190106T090826Z", ny, int(datetime(2019, 1, 6, 9, 8, 26, tzinfo=timezone.utc).timestamp())),
        ("April 12, 2023 at 3:55 am", ny, local(ny, 2023, 4, 12, 3, 55)),
        ("July 5, 2021 12:21 PM EDT", ny, int(datetime(2021, 7, 5, 16, 21, tzinfo=timezone.utc).timestamp())),
        ("2019-11-03 01:30:00 EST", ny, int(datetime(2019, 11, 3, 6, 30, tzinfo=timezone.utc).timestamp())),
        ("2019-11-03 01:30:00 EDT", ny, int(datetime(2019, 11, 3, 5, 30, tzinfo=timezone.utc).timestamp())),
        ("2022-06-16 03:33:15 IST", "Asia/Kolkata", local("Asia/Kolkata", 2022, 6, 16, 3, 33, 15)),
        ("01-MAR-2021 02:07:50", ny, local(ny, 2021, 3, 1, 2, 7, 50)),
        ("Friday, December 13, 2024", ny, local(ny, 2024, 12, 13)),
        ("2019-03-10T05:11:01.285793+00:00", ny, int(datetime(2019, 3, 10, 5, 11, 1, tzinfo=timezone.utc).timestamp())),
        ("2019-02-15 13:11:10.223 -0500", ny, int(datetime(2019, 2, 15, 18, 11, 10, tzinfo=timezone.utc).timestamp())),
        ("2019-01-02T19:10:37+1245", ny, int(datetime(2019, 1, 2, 6, 25, 37, tzinfo=timezone.utc).timestamp())),
    ]
    got, _ = run(spark, [("s", text, zone, None, None, None, None) for text, zone, _ in cases])
    assert [got[i]["epoch_s"] for i in range(len(cases))] == [c[2] for c in cases]


def test_unreadable_text(spark):
    texts = [None, "", "  ", "2021-02-29", "0000-00-00 00:00:00", "31/06/2021 08:00", "2022-11", "spring 2021", "25:61", "n/a", "x" * 100_000, "2022-13-05T10:00:00Z"]
    got, _ = run(spark, [("s", t, None, None, None, None, None) for t in texts])
    assert all(r["epoch_s"] is None and r["instant_status"] == "unreadable" for r in got.values())


def test_order_is_declared_or_learned_or_ambiguous(spark):
    rows = [("declared", "03/04/2021 10:00", None, True, None, None, None), ("us", "03/04/2021", None, None, None, None, None), ("none", "03/04/2021", None, None, None, None, None)]
    rows += [("us", f"01/{d}/2021", None, None, None, None, None) for d in range(13, 29)]
    got, _ = run(spark, rows)
    at = lambda i: datetime.fromtimestamp(got[i]["epoch_s"], timezone.utc)
    assert (at(0).month, at(0).day) == (4, 3)
    assert (at(1).month, at(1).day) == (3, 4) and got[1]["instant_status"] == "ok"
    assert got[2]["instant_status"] == "ambiguous"


def test_empty_table_repeated_rows_and_clashing_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert normalise_instants(empty, "txt", "src").count() == 0
    got, out = run(spark, [("s", "2020-01-01", None, None, None, None, None)] * 3)
    assert out.count() == 3 and out.columns.count("notation") == 1 and dict(out.dtypes)["epoch_s"] == "bigint"
    twice = normalise_instants(out, "txt", "src").select(F.col("epoch_s")).distinct().collect()
    assert [r[0] for r in twice] == [1577836800]


def test_long_text_is_read_whole(spark):
    got, _ = run(spark, [("s", " " * 400 + "2021-03-04" + "\t" * 300, None, None, None, None, None), ("s", "2021-03-04" + "." * 300, None, None, None, None, None)])
    assert got[0]["epoch_s"] == int(datetime(2021, 3, 4, tzinfo=timezone.utc).timestamp()) and got[1]["epoch_s"] is None
