from datetime import datetime, timedelta, timezone

import pytest

from casewright.operators.timestamps import normalize_stamps

HOSTS = [("ber", "Europe/Berlin", "dmy"), ("nyc", "America/New_York", "mdy"), ("tyo", "Asia/Tokyo", "ymd"), ("utc", "UTC", "ymd"), ("bad", "Mars/Base", "dmy")]


def us(y, m, d, h=0, mi=0, s=0, f=0, off=0):
    return (datetime(y, m, d, h, mi, s, f, tzinfo=timezone.utc) - timedelta(minutes=off) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("2020-06-22T15:52:27.198Z", None, us(2020, 6, 22, 15, 52, 27, 198000)),
    ("2020-06-22 15:52:27,1234567", "ber", us(2020, 6, 22, 15, 52, 27, 123456, 120)),
    ("  2019-10-27, 01:44 ", "nyc", us(2019, 10, 27, 1, 44, off=-240)),
    ("2021-05-25T10:01:49.423560+05:30", "nope", us(2021, 5, 25, 10, 1, 49, 423560, 330)),
    ("2020-11-11 20:40:40 -0330", None, us(2020, 11, 11, 20, 40, 40, off=-210)),
    ("24.08.2022 15:57:19", "ber", us(2022, 8, 24, 15, 57, 19, off=120)),
    ("05/04/2020 14:40", "nyc", us(2020, 5, 4, 14, 40, off=-240)),
    ("05/04/2020 14:40", "ber", us(2020, 4, 5, 14, 40, off=120)),
    ("20/05/04 14:40:01", "tyo", us(2020, 5, 4, 14, 40, 1, off=540)),
    ("31/31/2022 10:10", "ber", None),
    ("12/25/2022 12:28 AM", "nyc", us(2022, 12, 25, 0, 28, off=-300)),
    ("2023/9/28 1:49 PM", "tyo", us(2023, 9, 28, 13, 49, off=540)),
    ("24-Feb-2020 04:38:01", "utc", us(2020, 2, 24, 4, 38, 1)),
    ("Sat Jul 16 14:21:33 JST 2022", "tyo", us(2022, 7, 16, 14, 21, 33, off=540)),
    ("2021-05-29 03:14:45 EDT", "nyc", us(2021, 5, 29, 3, 14, 45, off=-240)),
    ("2021-05-29 03:14:45 EST", "nyc", us(2021, 5, 29, 3, 14, 45, off=-300)),
    ("2021-05-29 03:14:45 EDT", "ber", None),
    ("2021-05-29 03:14:45 UTC", None, us(2021, 5, 29, 3, 14, 45)),
    ("Fri, 17 Jul 2020 15:03:43 GMT", None, us(2020, 7, 17, 15, 3, 43)),
    ("20250614T063024Z", None, us(2025, 6, 14, 6, 30, 24)),
    # clock changes: twice, and skipped
    ("2023-10-29 02:30:00", "ber", us(2023, 10, 29, 2, 30, off=120)),
    ("2023-03-26 02:30:00", "ber", us(2023, 3, 26, 2, 30, off=60)),
    ("2021-03-14 02:28:30", "nyc", us(2021, 3, 14, 2, 28, 30, off=-300)),
    # without year: the latest that is not after 2024-03-01
    ("Feb 29 10:00:00", "utc", us(2024, 2, 29, 10)),
    ("Mar  5 10:00:00", "utc", us(2023, 3, 5, 10)),
    # numbers
    ("1558170173", None, 1558170173000000), ("#1698267490", None, 1698267490000000), (": 1639298644:30", None, 1639298644000000), ("1695026177.160", None, 1695026177160000), ("1658977789843", None, 1658977789843000), ("1684989743613451", None, 1684989743613451),
    ("133378892803774782", None, 133378892803774782 // 10 - 11644473600000000), ("0x01D6213F47961282", None, 0x01D6213F47961282 // 10 - 11644473600000000),
    # nothing
    ("", "ber", None), (None, "ber", None), ("0", "ber", None), ("#0", "ber", None), ("-", "ber", None), ("unknown", "ber", None), ("0001-01-01T00:00:00Z", None, None), ("1999-12-31T23:59:59Z", None, None), ("2021-02-30 11:04:00", "ber", None), ("2021-02-03 24:00:00", "ber", None), ("2021-02-03 10:00:00", None, None), ("2021-02-03 10:00:00", "nope", None), ("2021-02-03 10:00:00", "bad", None), ("x" * 100_000, "ber", None),
]


def test_cases(spark):
    rows = [(i, s, h, datetime(2024, 3, 1)) for i, (s, h, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, stamp string, src string, until timestamp_ntz")
    hosts = spark.createDataFrame([*HOSTS, ("ber", "UTC", "mdy")], "host string, zone_name string, date_order string")
    out = {r["i"]: r["utc_us"] for r in normalize_stamps(df, "stamp", "src", hosts, "until").collect()}
    wrong = [(CASES[i][:2], CASES[i][2], u) for i, u in out.items() if u != CASES[i][2]]
    assert not wrong and len(out) == len(CASES)


def test_names_of_inner_columns(spark):
    hosts = spark.createDataFrame(HOSTS, "host string, zone_name string, date_order string")
    df = spark.createDataFrame([("2020-06-22T15:52:27Z", "utc", 7, "x", 1), ("1558170173", "utc", 8, "y", 2)], "n string, _s string, f int, _zone string, zone_name int")
    rows = {r["f"]: r for r in normalize_stamps(df, "n", "_s", hosts).collect()}
    assert rows[7]["utc_us"] == us(2020, 6, 22, 15, 52, 27) and rows[8]["utc_us"] == 1558170173000000
    assert rows[7].asDict() | {"utc_us": 0} == {"n": "2020-06-22T15:52:27Z", "_s": "utc", "f": 7, "_zone": "x", "zone_name": 1, "utc_us": 0}


def test_without_limit_and_empty(spark):
    hosts = spark.createDataFrame(HOSTS, "host string, zone_name string, date_order string")
    df = spark.createDataFrame([("Mar  5 10:00:00", "utc")], "stamp string, src string")
    assert normalize_stamps(df, "stamp", "src", hosts).collect()[0]["utc_us"] is None
    assert normalize_stamps(df.limit(0), "stamp", "src", hosts).count() == 0
    with pytest.raises(ValueError):
        normalize_stamps(df.withColumnRenamed("src", "utc_us"), "stamp", "utc_us", hosts)
