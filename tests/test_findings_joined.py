from datetime import datetime

import pytest

from casewright.plans.casequeries import QUERIES

AT = datetime(2015, 1, 5, 12, 0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("case"))
    auth = [(4625, AT, "bob", "CORP", 3, "203.0.113.9")] * 5 + [(4648, AT, "alice", "CORP", 9, "10.0.0.1")] * 10
    spark.createDataFrame(auth, "event_id int, timestamp timestamp, user string, domain string, logon_type int, src_ip string").write.parquet(f"{d}/auth_events.parquet")
    lines = [("2015-01-05T12:00:00Z", "ssh_login_failed", "203.0.113.9")] * 20
    spark.createDataFrame(lines, "timestamp string, event_type string, src_ip string").write.parquet(f"{d}/linux_auth.parquet")
    spark.createDataFrame([("203.0.113.9", "a.exe"), ("198.51.100.7", "b.exe")], "remote_addr string, name string").write.parquet(f"{d}/mem_netscan.parquet")
    return d


def test_sources_of_different_tables_agree(spark, folder):
    got = {r["value"]: r["sources"] for r in QUERIES["findings_multi_source_all"](spark, folder).collect()}
    assert got["203.0.113.9"] == "detect:brute_force + detect:ssh_bruteforce"


def test_addresses_with_findings(spark, folder):
    got = {r["remote_addr"]: (r["n_conns"], r["n_findings"], r["n_logons"]) for r in QUERIES["network_correlation_findings"](spark, folder).collect()}
    assert got == {"203.0.113.9": (1, 2, 1), "198.51.100.7": (1, 0, 0)}


def test_accounts_with_findings(spark, folder):
    got = {r["account"]: r["n_findings"] for r in QUERIES["user_activity_findings"](spark, folder).collect()}
    assert got["alice"] >= 1 and got["bob"] == 0
