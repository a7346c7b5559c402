from datetime import datetime

import pytest

from casewright.plans.casequeries import QUERIES

AT = datetime(2015, 1, 5, 12, 0)
US = 1_420_459_200_000_000
ROWS = {
    "evtx_events": ("event_id int, channel string, timestamp string, computer string, message string", [(7045, "System", "Mon, 05 Jan 2015 12:00:00 GMT", "SVC-1", "certutil.exe"), (1102, "Security", "1420459200000", "PC", "x")]),
    "auth_events": ("event_id int, timestamp timestamp, user string, src_ip string, workstation string", [(4624, AT, "svc_certutil", "10.0.0.1", "w")]),
    "linux_auth": ("timestamp string, event_type string, user string, src_ip string, message string", [("2015-01-05T12:00:00Z", "ssh_login_success", "svc", None, "CertUtil")]),
    "shell_history": ("command string, timestamp string, user string, shell string", [("certutil svc", "#1420459200", "u", "bash")]),
    "anydesk_events": ("timestamp timestamp, level string, component string, message string", [(AT, "info", "c", "svc up")]),
}
ALL = {"evtx": 2, "auth": 1, "linux_auth": 1, "shell": 1, "anydesk": 1}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("case"))
    for name, (ddl, rows) in ROWS.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{d}/{name}.parquet")
    return d


def test_sources(spark, folder):
    assert {tuple(r) for r in QUERIES["timeline_all_sources"](spark, folder).collect()} == {(s, n, US, US) for s, n in ALL.items()}


@pytest.mark.parametrize("name", ["timeline_all_newest", "timeline_all_top_per_group"])
def test_rows(spark, folder, name):
    got = QUERIES[name](spark, folder).collect()
    assert {s: sum(r["source"] == s for r in got) for s in ALL} == ALL and len(got) == 6


def test_filtered(spark, folder):
    assert sorted(r["source"] for r in QUERIES["timeline_all_filtered"](spark, folder).collect()) == ["anydesk", "auth", "evtx", "linux_auth", "shell"]


def test_histogram(spark, folder):
    assert [r.asDict() for r in QUERIES["activity_all_histogram"](spark, folder).collect()] == [{"bucket_us": US, **ALL, "total": 6}]


def test_correlate(spark, folder):
    assert {r["source"]: r["n_rows"] for r in QUERIES["correlate_all_term"](spark, folder).collect()} == {"evtx_events": 1, "auth_events": 1, "linux_auth": 1, "shell_history": 1}
