from datetime import datetime

import pytest

from casewright.detect.detectors import BY_ID, run_detectors
from casewright.plans import timeline as TL
from casewright.schema import Case

AT = datetime(2015, 1, 5, 10, 30, 15)
# One instant in the layouts that collectors write; BER is Europe/Berlin (dmy), NYC America/New_York (mdy).
LAYOUTS = (
    ("2015-01-05T10:30:15Z", "BER"), ("2015-01-05 11:30:15", "BER"), ("2015-01-05T05:30:15-05:00", "NYC"), ("20150105T103015Z", "NYC"), ("05.01.2015 11:30:15", "BER"), ("05/01/2015 11:30:15", "BER"), ("01/05/2015 5:30:15 AM", "NYC"),
    ("2015/01/05 05:30:15", "NYC"), ("Mon, 05 Jan 2015 10:30:15 GMT", "BER"), ("Mon Jan 5 05:30:15 EST 2015", "NYC"), ("Jan 5, 2015 5:30:15 AM", "NYC"), ("1420453815", "BER"), ("1420453815000", "NYC"), ("1420453815000000", None), ("130649274150000000", "OTHER"), ("0x01D028D297DF9580", "BER"), ("2015-01-05 10:30:15", "OTHER"), ("2015-01-05 10:30:15", None),
)
EVENTS = "event_id int, channel string, timestamp string, computer string"


def hosts(spark):
    return spark.createDataFrame([("BER", "Europe/Berlin", "dmy"), ("NYC", "America/New_York", "mdy"), (None, "UTC", None)], "host string, zone_name string, date_order string")


@pytest.fixture
def case(spark):
    rows = [(7045, "System", stamp, host) for stamp, host in LAYOUTS] + [(7045, "System", stamp, "BER") for stamp in ("0001-01-01T00:00:00Z", "", None, "32.01.2015 10:30:15")]
    return Case(spark, None, {"evtx_events": spark.createDataFrame(rows, EVENTS), "hosts": hosts(spark)})


def test_detector_finds_every_layout(case):
    assert [r["first_seen"] for r in BY_ID["new_service"].run(case).collect()] == [AT] * len(LAYOUTS)
    fused = run_detectors(case, ["new_service", "log_cleared"]).collect()
    assert [r["first_seen"] for r in fused] == [AT] * len(LAYOUTS)


def test_timeline_has_every_layout(case):
    assert [r["ts"] for r in TL.timeline(case).collect()] == [AT] * len(LAYOUTS)


def test_case_without_hosts(spark):
    rows = [(7045, "System", stamp, "BER") for stamp in ("2015-01-05 10:30:15", "1420453815", "Mon, 05 Jan 2015 10:30:15 GMT")]
    case = Case(spark, None, {"evtx_events": spark.createDataFrame(rows, EVENTS)})
    assert [r["timestamp"] for r in case["evtx_events"].collect()] == [AT] * 3
    assert case["evtx_events"].columns[:4] == ["event_id", "channel", "timestamp", "computer"]


def test_lines_without_year(spark):
    rows = [("Jan 5 11:30:15", "BER", datetime(2015, 3, 1)), ("#1420453815", "NYC", datetime(2015, 3, 1))]
    lines = spark.createDataFrame(rows, "timestamp string, host string, collected_at timestamp")
    got = Case(spark, None, {"linux_auth": lines, "hosts": hosts(spark)})["linux_auth"]
    assert [r["timestamp"] for r in got.collect()] == [AT] * 2
